"""Logs as a stream: ingest in micro-batches, and a histogram with a watermark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Engine, SearchEngine
from ..plans.files import Folder
from ..sources import json_ingest


def read_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New files of one JSON object per line, as records with ``error``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return json_ingest.from_lines(reader.text(folder))


def _batch_id(spark: SparkSession, checkpoint: str, n: int) -> str:
    """Of a micro-batch: the id of its query, which the checkpoint keeps over restarts, and its number."""
    return f"stream-{json.loads(Folder(spark, checkpoint).read('metadata').splitlines()[-1])['id']}-{n}"


def ingest(records: DataFrame, engine: SearchEngine, checkpoint: str, **trigger):
    """Each micro-batch is one batch of the engine. Its id is that of the query and batch, so one that is replayed after
    a failure is skipped, and several streams may write to one engine."""
    start = records.writeStream.foreachBatch(lambda df, n: engine.ingest(df, _batch_id(engine.spark, checkpoint, n)) and None)
    return start.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_mutations(mutations: DataFrame, engine: Engine, checkpoint: str, **trigger):
    """A stream of mutations; each micro-batch is one flush, at most once."""
    start = mutations.writeStream.foreachBatch(lambda df, n: engine.write(df, _batch_id(engine.spark, checkpoint, n)))
    return start.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def histogram(logs: DataFrame, width: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """(bucket, level, count) in update mode. Rows later than the watermark are not counted here; the batch histogram
    counts every row, whenever it came."""
    at = F.timestamp_micros(F.expr("timestamp div 1000"))
    w = F.window("at", width)
    out = logs.withColumn("at", at).withWatermark("at", lateness).groupBy(w, "level").agg(F.count(F.lit(1)).alias("count"))
    return out.select((F.unix_micros("window.start") * 1000).alias("bucket"), "level", "count")
