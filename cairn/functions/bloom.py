"""A Bloom filter as a table of bit words, built and probed with built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for so many keys at this false-positive rate."""
    bits = max(64, math.ceil(-max(keys, 1) * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(bits / max(keys, 1) * math.log(2)))


def _places(key: Column, bits: int, hashes: int) -> Column:
    a, b = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.shiftright(a, 1) + i * F.shiftright(b, 8), F.lit(bits)))


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the filter's words that have bits set."""
    at = keys.select(F.explode(_places(F.col(key), bits, hashes)).alias("p"))
    return at.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("mask"))


def might_contain(probes: DataFrame, key: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``probes`` with ``maybe``: false means that the key was certainly not added."""
    at = probes.select(key).distinct().select(key, F.explode(_places(F.col(key), bits, hashes)).alias("p"))
    hit = at.join(words, F.expr("p div 64") == words["word"], "left").select(key, (F.expr("coalesce(mask, 0L) & shiftleft(1L, cast(p % 64 as int))") != 0).alias("set"))
    told = hit.groupBy(key).agg(F.every("set").alias("maybe"))
    return probes.join(told, key)
