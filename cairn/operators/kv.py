"""Versioned key-value state over mutation tables (key, value, ts, seq, op)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DELETE, KV_MUTATION, MAX_KEY, PUT
from .filters import key_range, live


def _rows(spark: SparkSession, rows: Iterable[tuple[bytes, bytes | None]], op: int, ts: int, seq: int) -> DataFrame:
    out = []
    for i, (key, value) in enumerate(rows):
        if not 1 <= len(key) <= MAX_KEY:
            raise ValueError(f"a key has 1 to {MAX_KEY} bytes; this one has {len(key)}")
        out.append((bytearray(key), bytearray(value or b"") if op == PUT else None, ts, seq + i, op))
    return spark.createDataFrame(out, KV_MUTATION)


def puts(spark: SparkSession, rows: Iterable[tuple[bytes, bytes]], ts: int, seq: int = 0) -> DataFrame:
    return _rows(spark, rows, PUT, ts, seq)


def deletes(spark: SparkSession, keys: Iterable[bytes], ts: int, seq: int = 0) -> DataFrame:
    """Tombstones; a key that is not there may be deleted."""
    return _rows(spark, ((k, None) for k in keys), DELETE, ts, seq)


def checked(mutations: DataFrame) -> DataFrame:
    """Mutations with keys of a valid length; an empty or missing value of a put is empty."""
    ok = F.octet_length("key").between(1, MAX_KEY)
    value = F.when(F.col("op") == PUT, F.coalesce("value", F.lit(b"")))
    return mutations.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit(f"a key has 1 to {MAX_KEY} bytes")).cast("binary"))).withColumn("value", value)


def merge(*sources: DataFrame) -> DataFrame:
    """Mutations of several sources as one table."""
    return reduce(DataFrame.unionByName, sources)


def newest(mutations: DataFrame, key: str = "key", columns: tuple[str, ...] = ("value", "ts", "seq", "op")) -> DataFrame:
    """The last version of each key by (ts, seq), tombstones among them.

    An aggregate rather than a window, so that versions are merged before the shuffle: what moves is a row per key
    and task, and a hot key is no hot partition.
    """
    order = F.struct("ts", "seq")
    best = F.max_by(F.struct(*columns), order)
    return mutations.groupBy(key).agg(best.alias("__v")).select(key, "__v.*")


def current(mutations: DataFrame, key: str = "key") -> DataFrame:
    """The visible state: (key, value, ts, seq, op) of keys whose last version is a put."""
    return live(newest(mutations, key))


def get(mutations: DataFrame, key, column: str = "key") -> DataFrame:
    """No row or one; the key is filtered at the scan."""
    return current(mutations.where(F.col(column) == F.lit(key)), column)


def scan(mutations: DataFrame, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, column: str = "key") -> DataFrame:
    """Keys from ``start`` to ``end``, both included, in byte order. A limit of 0 or less counts as 100."""
    out = current(mutations.where(key_range(start, end, column)), column).orderBy(column)
    return out if limit is None else out.limit(limit if limit > 0 else 100)


def seek(mutations: DataFrame, target: bytes, column: str = "key") -> DataFrame:
    """The visible keys from the first that is not below ``target``."""
    return scan(mutations, start=target, column=column)
