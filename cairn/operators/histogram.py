"""Time-bucket histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR = 40


def newest_hits(logs: DataFrame, most: int | None) -> DataFrame:
    """The newest ``most`` logs, or all. A top-k, not a global sort."""
    return logs if most is None else logs.orderBy(F.desc("timestamp"), "id").limit(most)


def by_level(logs: DataFrame, width: int, max_hits: int | None = None) -> DataFrame:
    """(bucket, level, count): buckets of ``width`` ns aligned to the epoch; empty ones are not listed."""
    start = F.expr(f"timestamp div {width}L * {width}L").alias("bucket")
    return newest_hits(logs, max_hits).groupBy(start, "level").agg(F.count(F.lit(1)).alias("count"))


def histogram(logs: DataFrame, width: int, max_hits: int | None = None) -> DataFrame:
    """(timestamp, count, by_level map) in order of time; two levels of aggregation, the second over few rows."""
    per = by_level(logs, width, max_hits)
    pairs = F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit("")).alias("k"), F.col("count").alias("v"))))
    return per.groupBy(F.col("bucket").alias("timestamp")).agg(F.sum("count").alias("count"), F.map_from_entries(pairs).alias("by_level")).orderBy("timestamp")


def counts(logs: DataFrame, width: int, max_hits: int | None = None) -> DataFrame:
    """(bucket, count)."""
    return newest_hits(logs, max_hits).groupBy(F.expr(f"timestamp div {width}L * {width}L").alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def total(logs: DataFrame, width: int, max_hits: int | None = None) -> DataFrame:
    """(total, interval_ms)."""
    return counts(logs, width, max_hits).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).withColumn("interval_ms", F.lit(width // 1_000_000).cast("long"))


def bars(logs: DataFrame, width: int, max_hits: int | None = None) -> DataFrame:
    """(bucket, count, bar): a bar of up to 40 blocks, at least one, in proportion to the largest bucket."""
    c = counts(logs, width, max_hits)
    top = c.agg(F.max("count").alias("__top"))
    bar = F.expr(f"repeat('█', cast(greatest(1, count * {BAR} div __top) as int))")
    return c.join(F.broadcast(top)).select("bucket", "count", bar.alias("bar"))
