"""What the operators share: scratch tables, word rules and distributed ranks."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a bucket of ``ranked``: what a task sorts at least, texts and all.
BUCKET_ROWS = 8192


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset and all runs in one process, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written``."""
    for df in tables:
        if path := getattr(df, "_cairn_path", None):
            delete(df.sparkSession, path)


def from_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of one of its files: a scan with columns chosen and rows filtered, no more."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName().startswith("LogicalRelation") and bool(df.inputFiles())


def with_place(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` with (__path, __file, __at): the file, its hash and the row there, which tell rows apart whatever ids they have.

    The place is the same each time the files are read. Rows that are not read from files are written first.
    """
    if not from_files(df):
        df = written(df, name)
    return df.select("*", F.col("_metadata.file_path").alias("__path"), F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of fewer rows for what runs inside: texts and sets are large, and a batch is held on both sides."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@functools.cache
def lean() -> None:
    """In a worker: memory of large arrays goes back to the system when they are freed (glibc; elsewhere nothing)."""
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
        pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """In a worker, at the end of a task: what small objects have left goes back to the system as well."""
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Each executor collects its garbage, so that heap which earlier work has grown goes back to the system.

    Young collections never shrink a heap; a full one does (G1, Spark's usual collector; others may keep it). It takes
    as long as what is alive is large, which between the steps of a job is little. One task per executor, which is
    where they go while all are idle; on a busy cluster some may be left out. No result depends on it.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is counted, too
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def hash32(seed: int, *cols: Column) -> Column:
    """A seeded 32-bit hash as a BIGINT, from md5, so that other engines give the same order."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def null_safe(col: Column) -> Column:
    """A grouping key in which null is a value of its own."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def ranked(
    df: DataFrame,
    group: str,
    key: str,
    ties: Sequence[str],
    total_rows: int,
    rank: str,
    size: str | None = None,
    before: str | None = None,
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """1-based rank of each row within ``group`` by (``key``, ``ties``), without one task per group.

    ``key`` is a uniform 32-bit hash. The key range is cut into equal buckets of about ``rows_per_bucket`` rows; a
    bucket's rank offset comes from the counts of the buckets before it, and only rows of one (group, bucket) are
    sorted together, so a group with a third of all rows is spread as evenly as any other. Rows of one key share a
    bucket: hash what tells rows apart. With ``size`` and ``before``, also the sum of ``size`` over the rows ranked earlier.
    """
    n = max(1, -(-total_rows // rows_per_bucket))
    cut = df.withColumn("__bucket", F.shiftright(F.col(key) * F.lit(n).cast("long"), 32))
    aggs = [F.count(F.lit(1)).alias("__n")] + ([F.sum(size).alias("__s")] if size else [])
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(group, "__bucket").agg(*aggs).select(
        group,
        "__bucket",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        *([F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s0")] if size else []),
    )
    order = Window.partitionBy(group, "__bucket").orderBy(key, *ties)
    out = cut.join(offsets, [group, "__bucket"]).withColumn(rank, (F.row_number().over(order) + F.col("__n0")).cast("long"))
    if size:
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(before, (F.sum(size).over(upto) - F.col(size) + F.col("__s0")).cast("long"))
    return out.drop("__bucket", "__n0", "__s0")


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (ids and small numbers only), else as it is."""
    return F.broadcast(df) if df.count() <= most else df
