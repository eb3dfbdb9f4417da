"""Log search: index choice, term intersection, filters, order and paging."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, tokenize, tokens_of
from . import filters

PAGE = 50


@dataclass(frozen=True)
class Query:
    text: str = ""
    level: str = ""
    service: str = ""
    host: str = ""
    from_time: int = 0
    to_time: int = 0
    fields: Mapping[str, str] = field(default_factory=dict)
    limit: int = 0
    offset: int = 0
    #: ``all``: every token must occur. ``any`` is an extension.
    match: str = "all"


@dataclass(frozen=True)
class Plan:
    """What drives the query (text, level, service or time), its tokens, and the predicate on logs."""

    driver: str
    tokens: tuple[str, ...]
    predicate: Column


def postings(logs: DataFrame) -> DataFrame:
    """(term, ts, id): a row per token of each log."""
    return logs.select(F.explode(tokenize(F.col("message"))).alias("term"), F.col("timestamp").alias("ts"), "id")


def plan(q: Query) -> Plan:
    """The first of text, level, service and time that the query has drives it.

    The driver decides how exact a match is: a level on its own is matched upper-cased but not trimmed, a service on
    its own as it is written; beside another driver both are matched in any case. A text without tokens does not count.
    """
    tokens = tuple(tokens_of(q.text)) if q.text else ()
    driver = "text" if tokens else "level" if q.level else "service" if q.service else "time"
    terms = [filters.within(q.from_time, q.to_time)]
    if driver == "level":
        terms.append(F.col("level") == q.level.upper())
    elif q.level:
        terms.append(filters.level_is(q.level))
    if q.service:
        terms.append(filters.service_is_exactly(q.service) if driver == "service" else filters.service_is(q.service))
    if q.host:
        terms.append(filters.host_is(q.host))
    if q.fields:
        terms.append(filters.fields_are(q.fields))
    return Plan(driver, tokens, reduce(and_, terms))


def has_terms(tokens: tuple[str, ...], match: str = "all") -> Column:
    """Predicate on ``message``. A cheap substring test runs first, so that few messages are split into tokens."""
    join = and_ if match == "all" else or_
    low, wanted = folded(F.col("message")), F.array(*[F.lit(t) for t in tokens])
    cheap = reduce(join, [low.contains(t) for t in tokens])
    # the message is split once, whatever the number of tokens
    exact = F.size(F.array_intersect(tokenize(F.col("message")), wanted)) >= (len(tokens) if match == "all" else 1)
    return F.when(cheap, exact).otherwise(F.lit(False))


def matching_ids(index: DataFrame, tokens: tuple[str, ...], q: Query) -> DataFrame:
    """Ids that have the terms, from a postings table: one scan, one aggregate, no chain of joins."""
    hits = index.where(F.col("term").isin(*tokens) & filters.within(q.from_time, q.to_time, "ts"))
    need = len(tokens) if q.match == "all" else 1
    return hits.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") >= need).select("id")


def hits(logs: DataFrame, q: Query, index: DataFrame | None = None) -> DataFrame:
    """All logs that match, in no order. With ``index`` (postings of the current logs) a text is looked up there."""
    p = plan(q)
    out = logs.where(p.predicate)
    if p.tokens:
        out = out.where(has_terms(p.tokens, q.match)) if index is None else out.join(matching_ids(index, p.tokens, q), "id", "left_semi")
    return out


def page(found: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; a limit of 0 or less is 50, a negative offset is 0."""
    ordered = found.orderBy(F.desc("timestamp"), F.asc("id"))
    return (ordered.offset(offset) if offset > 0 else ordered).limit(limit if limit > 0 else PAGE)


def search(logs: DataFrame, q: Query, index: DataFrame | None = None) -> DataFrame:
    return page(hits(logs, q, index), q.limit, q.offset)


def total_hits(logs: DataFrame, q: Query, index: DataFrame | None = None) -> DataFrame:
    """(total_hits): the count before paging."""
    return hits(logs, q, index).agg(F.count(F.lit(1)).alias("total_hits"))


def by_id(logs: DataFrame, key: str) -> DataFrame:
    return logs.where(F.col("id") == key)


def current_logs(logs: DataFrame, *order: str) -> DataFrame:
    """The last ingested version of each id; ``order`` names the columns that tell the order of ingestion."""
    cols = [c for c in logs.columns if c != "id" and c not in order]
    return logs.groupBy("id").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__v")).select("id", "__v.*")
