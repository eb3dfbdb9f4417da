"""Log records from JSON: one object, an array, or a line each; validated and completed."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hex_id, trim_upper
from ..schemas import LOG

STRINGS = ("id", "level", "service", "host", "message")


def completed(df: DataFrame, now_ns: int | None = None) -> DataFrame:
    """Defaults in order: id (random), timestamp (now), level INFO if empty and then upper-cased and trimmed, service.

    Random ids change whenever the plan runs again: write the rows before using them twice.
    """
    now = F.lit(time.time_ns() if now_ns is None else now_ns)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.withColumns(
        {
            "id": F.when(empty("id"), hex_id()).otherwise(F.col("id")),
            "timestamp": F.when(F.coalesce("timestamp", F.lit(0)) <= 0, now).otherwise(F.col("timestamp")).cast("long"),
            "level": trim_upper(F.when(empty("level"), F.lit("INFO")).otherwise(F.col("level"))),
            "service": F.when(empty("service"), F.lit("default")).otherwise(F.col("service")),
        }
    )


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def typed(values: DataFrame, value: str = "v") -> DataFrame:
    """Columns of the log schema and ``error`` from a variant column.

    A wrong type fails the record, as numbers for strings would otherwise be turned into text silently: strings must
    be strings, the timestamp a whole number, fields an object of strings; null counts as missing. Names are exact.
    """
    v = F.col(value)
    kinds = [(c, _kind(v, f"$.{c}")) for c in (*STRINGS, "timestamp", "fields")]
    error = F.when(v.isNull() | (F.schema_of_variant(v) == "VOID"), "not a JSON object").when(~F.schema_of_variant(v).startswith("OBJECT"), "not a JSON object")
    for c, kind in kinds:
        ok = kind.isin("STRING", "VOID") if c in STRINGS else kind.isin("BIGINT", "VOID") if c == "timestamp" else kind.startswith("OBJECT") | (kind == "VOID")
        error = error.when(~ok, f"{c}: wrong type")
    entries = F.try_variant_get(v, "$.fields", "map<string,variant>")
    error = error.when(F.size(F.map_filter(entries, lambda _, x: ~F.coalesce(F.schema_of_variant(x), F.lit("VOID")).isin("STRING", "VOID"))) > 0, "fields: wrong type")
    error = error.when(F.coalesce(F.try_variant_get(v, "$.message", "string"), F.lit("")) == "", "message is empty")
    cols = {f.name: F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in LOG.fields if f.name != "fields"}
    fields = F.transform_values(entries, lambda _, x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    return values.select(*cols.values(), fields.alias("fields"), error.alias("error"), *[c for c in values.columns if c != value])


def split(records: DataFrame, now_ns: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid records, completed; rejected ones with their error)."""
    return completed(records.where("error is null").drop("error"), now_ns), records.where("error is not null")


def from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """One object per line; blank lines are skipped; lines may have any length."""
    return typed(lines.where(F.trim(F.col(col)) != "").select(F.try_parse_json(F.col(col)).alias("v"), F.col(col).alias("raw")))


def from_bodies(bodies: DataFrame, col: str = "value") -> DataFrame:
    """Whole request bodies, each an array, one object (on several lines too), or an object per line."""
    text = F.trim(F.col(col))
    whole = F.try_parse_json(text)
    array = F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda x: F.to_json(x))
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")
    # the parser stops after one object, so a body of several is told by its lines; a pretty-printed one has none that parse
    by_line = F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    parts = F.when(text.startswith("["), F.coalesce(array, F.array(text))).when(text.startswith("{"), F.when(by_line | whole.isNull(), lines).otherwise(F.array(text))).otherwise(F.array(text))
    raw = bodies.select(F.explode(parts).alias("raw"))
    return typed(raw.select(F.try_parse_json("raw").alias("v"), "raw"))


def read_logs(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Records of files, with ``error``. ``lines`` splits files between tasks; ``bodies`` reads each file whole."""
    if layout == "lines":
        return from_lines(spark.read.text(path))
    return from_bodies(spark.read.text(path, wholetext=True))


def to_json(logs: DataFrame) -> DataFrame:
    """(value): each record as JSON; an empty host and empty fields are left out."""
    slim = logs.withColumns({"host": F.when(F.col("host") != "", F.col("host")), "fields": F.when(F.size("fields") > 0, F.col("fields"))})
    return slim.select(F.to_json(F.struct(*LOG.fieldNames())).alias("value"))
