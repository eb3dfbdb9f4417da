"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum, to see that a round changed nothing."""
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first()
    return r[0], r[1]


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node with an edge; ``component`` is the smallest node reachable.

    Nulls and loops are ignored. Each round is linear in the edges: minima by partial aggregation, then a join
    which adaptive execution splits where a hub has many edges. The edge table of a round is written to the shared
    folder, so no lineage builds up and lost executors cost one round at most. Nothing is collected but a count
    and a checksum.
    """
    flat = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = written(flat.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "edges")
        drop(now)
        drop(large)
        was, mark, now = mark, _mark(new), new
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
