"""Sharding by proportional stratified interleaving. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, drop, hash32, null_safe, ranked, small_side, with_place, written

SHARDS, SEED, WINDOWS = 24, 17, 64
PLACED = ("shard", "slot")


def _placed(rows: DataFrame, shards: int, rows_per_bucket: int) -> DataFrame:
    """``rows`` (__w window, __g source, __k 32-bit hash, and what tells rows apart) with ``shard`` and ``slot``.

    ``rows`` is a table of slim rows that is read several times. Two ranks, both distributed (see ``ranked``): of the
    shuffled rows within each source of a window, then of their fractions within the window. No task holds a source,
    a window or a shard, only a bucket. What is collected is one count; what is broadcast, a row per window.
    """
    others = [c for c in rows.columns if c not in ("__w", "__g", "__k")]
    strata = rows.withColumn("__s", F.concat_ws("|", F.col("__w").cast("string"), "__g"))
    sizes = written(strata.groupBy("__s", "__w").agg(F.count(F.lit(1)).alias("__of")), "strata")
    windows = sizes.groupBy("__w").agg(F.sum("__of").alias("__n"))
    most = windows.agg(F.coalesce(F.max("__n"), F.lit(0))).first()[0]
    first = ranked(strata, "__s", "__k", others, most, "__r", rows_per_bucket=rows_per_bucket)
    spread = first.join(sizes.drop("__w"), "__s").withColumn("__f", (F.col("__r") - 0.5) / F.col("__of"))
    # fractions are even within a window, so their own range is cut into buckets
    spread = written(spread.withColumn("__u", F.floor(F.col("__f") * F.lit(float(1 << 32))).cast("long")).drop("__of"), "fractions")
    order = ranked(spread, "__w", "__u", ["__f", "__g", "__r"], most, "__p", rows_per_bucket=rows_per_bucket)
    # a window deals on where the last one stopped, so counts stay at most one apart; a row per window
    before = Window.orderBy("__w").rowsBetween(Window.unboundedPreceding, -1)
    starts = windows.select("__w", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__a"))
    order = order.join(F.broadcast(starts.select("__w", "__a", (F.col("__a") + F.col("__n")).alias("__b"))), "__w")

    def ahead(s: Column) -> Column:
        """Rows that a window gives to the shards before ``s``: shard s gets every ``shards``-th row dealt, in one run."""
        a, b, n = F.col("__a"), F.col("__b"), F.lit(shards).cast("long")
        return (F.floor(b / n) - F.floor(a / n)) * s + F.least(b % n, s) - F.least(a % n, s)

    order = order.withColumn("shard", F.size(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: ahead(s) < F.col("__p"))) - 1)
    own = F.col("shard").cast("long")
    held = F.floor((F.col("__a") + (shards - 1) - own) / shards)
    out = written(order.withColumn("slot", (held + F.col("__p") - 1 - ahead(own)).cast("long")).select(*others, *PLACED), "placed")
    drop(sizes, spread)
    return out


def _with_order(placed: DataFrame) -> DataFrame:
    """``placed`` with ``__pos``: how far from the first row (0) to the last (1), by file name and place in the file."""
    files = written(placed.groupBy("__file").agg(F.min("__path").alias("__path"), F.count(F.lit(1)).alias("__n")), "files")
    before = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("__file"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__a"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    return placed.join(small_side(starts), "__file").withColumn("__pos", (F.col("__a") + F.col("__at") + 0.5) / F.col("__all"))


def interleave(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    told_by: Sequence[str] = (),
    in_order: bool = False,
    windows: int = WINDOWS,
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` plus ``shard`` (0..shards-1) and ``slot`` (gapless from 0 within the shard).

    Rows are shuffled by a seeded hash within each source and ranked; row r of a source of n rows gets the fraction
    (2r-1)/2n; all rows are sorted by it and cut into ``shards`` runs whose counts differ by one at most, so every
    prefix and every shard holds each source in its share of the whole, to within a row.

    With ``in_order``, the order of the rows in the files of ``docs`` is the training order: it is cut into
    ``windows``, and each is interleaved and cut by itself: every shard matches the mixture of each window, its slots
    follow the windows, and counts still differ by one at most.

    Only slim rows are ranked: the id, the source and each row's place in the files of ``docs`` (a table that is not
    read from files is written first). Shard and slot join the rows by place: broadcast up to 1 million rows, beyond
    that in one shuffle of the rows.

    The hash takes the id and the columns ``told_by``, by default a hash of all others (with ``in_order`` the place in
    the order instead), so null and repeated ids are spread like others; only rows equal in all of it share a bucket,
    and those may stand for each other. Null sources form one source. A text of any length is read once, for the
    hash; an empty table gives an empty table. Columns named ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop(*PLACED)
    placed = with_place(docs, "documents")
    rows = _with_order(placed) if in_order else placed
    told = [F.col("__pos")] if in_order else [F.col(c) for c in told_by] or [F.xxhash64(*[c for c in docs.columns if c != id_col])]
    window = F.floor(F.col("__pos") * windows).cast("int") if in_order else F.lit(0)
    ties = [c.alias(f"__t{i}") for i, c in enumerate(told)]
    slim = rows.select(window.alias("__w"), null_safe(F.col(source_col)).alias("__g"), hash32(seed, F.col(id_col), *told).alias("__k"), F.col(id_col).alias("__id"), *ties, "__file", "__at")
    slim = written(slim, "slim")
    told = _placed(slim, shards, rows_per_bucket).select("__file", "__at", *PLACED)
    drop(slim)
    return placed.join(small_side(told), ["__file", "__at"]).select(*docs.columns, *PLACED)


def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards; law ``rows``: counts at most one apart.

    Null and empty texts have size 8 and CRC 0. Null and repeated ids, ties of the hash and repeated rows are rows
    like others (ordered by id, size and CRC); very long texts are read once for size and CRC and then left; an empty
    table gives an empty table; columns beside doc_id, text and source are ignored, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = interleave(written(slim, "slim"), told_by=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
         lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
hashed AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
digest AS (SELECT doc_id, source, size, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(size - 8),
         lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]::BIGINT))) AS text_crc32
         FROM hashed, crc),
keyed AS (SELECT *, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, chr(0)) || '|' || size || '|' || text_crc32::BIGINT), 1, 8))::BIGINT AS k FROM digest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY (r - 0.5::DOUBLE) / n, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END, r) - 1 AS p, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, total // 24 AS q, total % 24 AS x FROM placed),
sharded AS (SELECT *, CASE WHEN p < x * (q + 1) THEN p // (q + 1) ELSE x + (p - x * (q + 1)) // greatest(q, 1) END AS shard FROM cut)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (p - (shard * q + least(shard, x)))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM sharded
"""
