"""Gauges of a store, and their text form for scrapers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Store

#: Buckets of the range of values for percentiles.
BUCKETS = 200


def levels(tables: DataFrame) -> DataFrame:
    """(level, tables, entries, bytes) of a manifest table."""
    return tables.groupBy("level").agg(F.count(F.lit(1)).alias("tables"), F.sum("entry_count").alias("entries"), F.sum("data_size").alias("bytes"))


def overlapping(tables: DataFrame, lo: bytes, hi: bytes) -> DataFrame:
    """Tables whose key range meets [lo, hi], both included."""
    return tables.where(~((F.col("max_key") < F.lit(lo)) | (F.col("min_key") > F.lit(hi))))


def gauges(store: Store) -> dict[str, float]:
    """Counters, bytes, and amplification: written bytes per logical byte, and stored bytes per byte below level 0.

    ``entries_dropped`` counts superseded versions and purged tombstones, by subtraction. Without writes both
    amplifications are 1.
    """
    m = store.manifest()
    c = {k: m.counters.get(k, 0) for k in ("flushes", "compactions", "logical_bytes", "flush_bytes", "compaction_bytes", "compaction_read_bytes", "entries_dropped")}
    disk = sum(t.data_size for t in m.tables)
    below = sum(t.data_size for t in m.tables if t.level > 0)
    out: dict[str, float] = {"manifest_version": m.version, "tables": len(m.tables), "entries": sum(t.entry_count for t in m.tables), "disk_bytes": disk, **c}
    for n in range(7):
        out[f"level{n}_tables"] = sum(t.level == n for t in m.tables)
    out["write_amplification"] = (c["flush_bytes"] + c["compaction_bytes"]) / c["logical_bytes"] if c["logical_bytes"] else 1.0
    out["space_amplification"] = disk / below if below else 1.0
    return out


def prometheus(values: dict[str, float], prefix: str = "cairn_") -> str:
    """One gauge per line, with its type."""
    return "".join(f"# TYPE {prefix}{k} gauge\n{prefix}{k} {v:g}\n" for k, v in values.items())


def latency_percentiles(samples: DataFrame, col: str, percents: tuple[float, ...] = (50, 95, 99, 99.9)) -> DataFrame:
    """Percentiles by index into the sorted samples (no interpolation).

    Samples are counted per value; the range of values is cut into buckets at approximate percentiles, so that running
    counts are taken within a bucket, after the counts of the buckets before it, and no task has all values.
    """
    per = samples.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    cuts = per.agg(F.percentile_approx("x", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    per = per.withColumn("bucket", bucket)
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = per.groupBy("bucket").agg(F.sum("n").alias("m")).select("bucket", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    run = per.join(F.broadcast(counts), "bucket").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("bucket").orderBy("x")))
    at = lambda p: F.min(F.when(F.col("upto") > F.expr(f"total * {round(p * 10)}L div 1000L"), F.col("x")))
    return run.agg(*[at(p).alias(f"p{str(p).replace('.', '_')}") for p in percents])
