"""Predicates on logs and mutations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DELETE, END_OF_TIME


def same(col: str, value: str) -> Column:
    """Equal but for case; a missing string is empty."""
    return F.upper(F.coalesce(F.col(col), F.lit(""))) == F.upper(F.lit(value))


def level_is(value: str) -> Column:
    return same("level", value)


def service_is(value: str) -> Column:
    return same("service", value)


def service_is_exactly(value: str) -> Column:
    return F.col("service") == value


def host_is(value: str) -> Column:
    return same("host", value)


def within(start: int = 0, end: int = 0, col: str = "timestamp") -> Column:
    """Both ends belong to the range; 0 or less leaves an end open."""
    return F.col(col).between(max(start or 0, 0), end if end and end > 0 else END_OF_TIME)


def fields_are(wanted: Mapping[str, str]) -> Column:
    """All fields equal, case counts; a missing field of a present map is empty."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & F.col("fields").isNotNull() & (F.coalesce(F.element_at("fields", F.lit(k)), F.lit("")) == v)
    return out


def key_range(start: bytes | None = None, end: bytes | None = None, col: str = "key") -> Column:
    """Byte order, both ends inclusive; None leaves an end open."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(col) >= F.lit(start))
    if end is not None:
        out = out & (F.col(col) <= F.lit(end))
    return out


def live(state: DataFrame) -> DataFrame:
    """Without tombstones; only after the newest version of each key is chosen."""
    return state.where(F.col("op") != DELETE)
