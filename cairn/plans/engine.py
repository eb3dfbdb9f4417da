"""The engine as an application uses it: a key-value store, and log ingest and search on Parquet tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.durations import parse_duration, parse_interval
from ..operators import histogram, kv
from ..operators.search import Query, by_id, current_logs, has_terms, matching_ids, page, plan, postings
from ..schemas import KV_MUTATION, LOG, POSTING, RECOVERY
from ..sources import json_ingest, wal
from . import stats
from .files import Folder
from .storage import Options, Store

LOGS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG.fields) + ", row long, day date"
POSTINGS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in POSTING.fields)


class Engine:
    """Keys and values. Writes are batches; each flush is one atomic commit."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, auto_compact: bool = False):
        self.spark, self.store, self.auto_compact = spark, Store(spark, root, options), auto_compact

    def put_many(self, rows: Iterable[tuple[bytes, bytes]], batch: str | None = None) -> None:
        self.write(kv.puts(self.spark, rows, time.time_ns()), batch)

    def put(self, key: bytes, value: bytes) -> None:
        self.put_many([(key, value)])

    def delete_many(self, keys: Iterable[bytes], batch: str | None = None) -> None:
        self.write(kv.deletes(self.spark, keys, time.time_ns()), batch)

    def delete(self, key: bytes) -> None:
        self.delete_many([key])

    def write(self, mutations: DataFrame, *batches: str | None) -> None:
        self.store.flush(mutations, *batches)
        if self.auto_compact:
            self.store.compact()

    def recover(self, folder: str, pattern: str = wal.PATTERN) -> DataFrame:
        """Take in the valid prefix of every log segment of a folder that is not in yet, and return the recovery report.

        A segment is known by path, length and checksum: one that came or grew since is taken in, one that is in is
        not read again (versions that are in twice change nothing). What is read is what the report says, even if a
        segment grows meanwhile. Segments are never changed or deleted; a damaged one stays for quarantine.
        """
        report = wal.recovery_report(self.spark, folder, pattern).collect()
        known = self.store.manifest().batches
        new = {f"wal:{r.path}:{r.length}:{r.crc}": r for r in report}
        new = {k: r for k, r in new.items() if k not in known}
        if new:
            rows = wal.read_parts(self.spark, [(r.path, r.bytes_recovered) for r in new.values()])
            self.write(rows.select(*KV_MUTATION.fieldNames()), *new)
        return self.spark.createDataFrame(report, RECOVERY)

    def get(self, key: bytes) -> bytes | None:
        row = self.store.get(key).first()
        return None if row is None else bytes(row["value"])

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 100) -> list[tuple[bytes, bytes]]:
        return [(bytes(r["key"]), bytes(r["value"])) for r in self.store.scan(start, end, limit).collect()]

    def compact(self) -> int:
        return self.store.compact_all()

    def stats(self) -> dict[str, float]:
        return stats.gauges(self.store)

    def metrics(self) -> str:
        return stats.prometheus(self.stats())


class SearchEngine:
    """Logs and their postings under one folder. A batch is visible in whole or not at all.

    Each batch is written to folders of its own, then a numbered file names it; only one writer can create a number, so
    concurrent writers get different ones. The order of versions is (number of the batch, partition and row there). A
    batch id that is in is skipped.

    Queries find candidates first, by postings for a text, else by the predicate, both pruned by day, and then look up
    the versions of those ids only: an older version that matches does not count if a newer one does not.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._log = Folder(spark, f"{self.root}/batches")
        self._known: dict[int, dict] = {}

    def batches(self) -> list[tuple[int, str, str]]:
        """(number, folder, batch id) of each batch, in order. A numbered file never changes, so it is read once."""
        numbers = [int(n) for n in self._log.names() if n.isdigit()]
        for n in numbers:
            if n not in self._known:
                self._known[n] = json.loads(self._log.read(f"{n:012d}"))
        return [(n, self._known[n]["folder"], self._known[n]["batch"]) for n in numbers]

    def ingest(self, records: DataFrame, batch: str | None = None) -> tuple[int, int]:
        """(accepted, rejected) of records as ``json_ingest`` gives them; rejected ones go to quarantine with the error.

        The records are parsed once, into a staging table, where random ids and the order of rows are fixed.
        """
        if batch is not None and any(b == batch for _, _, b in self.batches()):
            return 0, 0
        folder = uuid.uuid4().hex
        stage = f"{self.root}/staging/{folder}"
        records.withColumn("row", F.monotonically_increasing_id()).write.parquet(stage)
        valid, rejected = json_ingest.split(self.spark.read.parquet(stage))
        day = F.date_from_unix_date(F.expr("cast(timestamp div 86400000000000L as int)"))
        logs_at = f"{self.root}/logs/batch={folder}"
        valid.select(*LOG.fieldNames(), "row", day.alias("day")).write.partitionBy("day").parquet(logs_at)
        logs = self.spark.read.schema(LOGS).parquet(logs_at)
        index = postings(logs).repartitionByRange("term", "ts").sortWithinPartitions("term", "ts")
        index.write.option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(f"{self.root}/postings/batch={folder}")
        bad = rejected.select("error", *([c for c in ("raw",) if c in rejected.columns]))
        bad.write.json(f"{self.root}/rejected/batch={folder}")
        counts = logs.count(), rejected.count()
        Folder(self.spark, f"{self.root}/staging").delete(folder)
        while True:
            done = self.batches()
            if batch is not None and any(b == batch for _, _, b in done):
                return 0, 0  # another writer was first; the folders stay unnamed
            number = done[-1][0] + 1 if done else 1
            if self._log.create(f"{number:012d}", json.dumps({"folder": folder, "batch": batch or ""})):
                return counts

    def ingest_json(self, body: str, batch: str | None = None) -> tuple[int, int]:
        return self.ingest(json_ingest.from_bodies(self.spark.createDataFrame([(body,)], "value string")), batch)

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The tables of all batches as one, with ``number``; empty if there are none."""
        done = self.batches()
        base = f"{self.root}/{kind}"
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch string, number long")
        paths = [f"{base}/batch={folder}" for _, folder, _ in done]
        numbers = self.spark.createDataFrame([(folder, n) for n, folder, _ in done], "batch string, number long")
        rows = self.spark.read.schema(f"{schema}, batch string").option("basePath", base).parquet(*paths)
        return rows.join(F.broadcast(numbers), "batch")

    def _versions(self) -> DataFrame:
        return self._read("logs", LOGS).drop("batch")

    def logs(self) -> DataFrame:
        """The current version of each log: an aggregate over all of them, for exports and not for queries."""
        return current_logs(self._versions().drop("day"), "number", "row")

    def index(self) -> DataFrame:
        """Postings of all batches. Older versions of a log may be among them: look its versions up, see ``hits``."""
        return self._read("postings", POSTINGS).select(*POSTING.fieldNames())

    def hits(self, q: Query) -> DataFrame:
        """All current logs that match, in no order."""
        p = plan(q)
        versions = self._versions()
        if p.tokens:
            found = matching_ids(self.index(), p.tokens, q)
        else:
            found = versions.where(p.predicate & within_days(q)).select("id").distinct()
        # found at some version; a newer one may be anywhere, but only of these ids
        newest = current_logs(versions.drop("day").join(found, "id", "left_semi"), "number", "row")
        out = newest.where(p.predicate)
        return out.where(has_terms(p.tokens, q.match)) if p.tokens else out

    def search(self, q: Query) -> dict:
        """One pass: all hits are counted on their way to the page."""
        began = time.time()
        counted = Observation()
        rows = page(self.hits(q).observe(counted, F.count(F.lit(1)).alias("n")), q.limit, q.offset)
        rows = [r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()]
        return {"total_hits": counted.get["n"], "took_ms": (time.time() - began) * 1000, "logs": [json.loads(r) for r in rows]}

    def aggregate(self, q: Query, interval: str = "1m", max_hits: int | None = None) -> dict:
        width = parse_interval(interval)
        buckets = [r.asDict(recursive=True) for r in histogram.histogram(self.hits(q), width, max_hits).collect()]
        return {"interval_ms": width // 1_000_000, "total": sum(b["count"] for b in buckets), "buckets": buckets}

    def get(self, key: str) -> dict | None:
        """The current version of one log; the id is filtered at the scan."""
        row = current_logs(by_id(self._versions().drop("day"), key), "number", "row").first()
        return None if row is None else row.asDict(recursive=True)


def within_days(q: Query) -> Column:
    """The days that a query's range of time meets, for the partitions of the logs."""
    day = lambda ns: F.date_from_unix_date(F.lit(ns // 86_400_000_000_000))
    out = F.lit(True)
    if q.from_time and q.from_time > 0:
        out = out & (F.col("day") >= day(q.from_time))
    if q.to_time and q.to_time > 0:
        out = out & (F.col("day") <= day(q.to_time))
    return out


def since(text: str, now_ns: int | None = None) -> int:
    """Start of a range that ends now; 0 (no bound) for anything but a duration."""
    try:
        return (time.time_ns() if now_ns is None else now_ns) - parse_duration(text)
    except ValueError:
        return 0
