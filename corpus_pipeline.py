"""The corpus pipeline: each stage takes what its predecessor kept and returns the columns of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, kneser, minhash, mixing, sharding
from cairn.llm.common import give_back, scratch_path, small_side, written


def _relieved(stage: Callable) -> Callable:
    """The stage, on executors that do not hold the heap of earlier stages any more: memory is bounded by stage."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return run


@_relieved
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, each row judged by itself, whatever its id.

    Null and empty texts go; texts of any length are read whole; repeated rows and ids, ties at the threshold (kept)
    and clashing columns are as in ``kneser.quality``; an empty table stays empty.
    """
    out = kneser.with_quality(docs, kneser.trusted_ids(spark, sf_dir)).where("__kept").select(*docs.columns)
    give_back(spark)
    return out


@_relieved
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id.

    Ids are unique; rows that repeat one go or stay together. Rows with a null id stay, as do null and empty texts,
    which link with nothing. Whole texts count, however long. An empty table stays empty; extra columns are kept.
    """
    gone = small_side(written(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id")), "copies"))
    give_back(spark)
    return docs.join(gone, docs["doc_id"] == F.col("__id"), "left_anti")


@_relieved
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row judged by its own text, whatever its id.

    Null and empty texts hold none and stay; long texts are searched whole; repeated rows are judged alike; an empty
    table of either kind removes nothing; extra columns are kept.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_relieved
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the order of the files and of the rows in them is the training order.

    Null and empty texts have no words and are not taken; null ids, null sources and repeated rows are rows like
    others; ties of position are in order of id; an empty table stays empty; extra columns are kept.
    """
    return mixing.mix(docs).drop("position")


@_relieved
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and slot: each shard matches the mixture and follows the training order.

    Null ids, sources and texts and repeated rows are rows like others; an empty table stays empty; columns named
    shard or slot are replaced, others kept.
    """
    return sharding.interleave(docs, in_order=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Perplexities and the forest's candidates are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
