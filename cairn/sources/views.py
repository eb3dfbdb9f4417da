"""Logs and mutations out of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp"),
        F.upper("event_type").alias("level"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("service"),
        F.lit("").alias("host"),
        F.concat_ws(" ", "event_type", "props").alias("message"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("fields"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").cast("string").alias("id"),
        (F.lit(1726830000000000000) + F.col("doc_id") * 5000000000).alias("timestamp"),
        F.upper("lang").alias("level"),
        F.col("source").alias("service"),
        F.concat(F.lit("host-"), F.col("doc_id") % 10).alias("host"),
        F.col("text").alias("message"),
        F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")).alias("fields"),
    )


def event_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last event: puts, and deletes for errors."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.encode(F.col("user_id").cast("string"), "UTF-8").alias("key"),
        F.when(F.col("event_type") != "error", F.encode(F.coalesce("props", F.lit("")), "UTF-8")).alias("value"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).cast("tinyint").alias("op"),
    )
