"""Schemas of logs, postings, key-value mutations, manifests and recovery reports."""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)
POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("id", T.StringType())])
KV_MUTATION = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.ByteType()),
    ]
)
TABLE_META = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("entry_count", T.LongType()),
        T.StructField("data_size", T.LongType()),
        T.StructField("logical_size", T.LongType()),
        T.StructField("min_key", T.BinaryType()),
        T.StructField("max_key", T.BinaryType()),
        T.StructField("created_at", T.LongType()),
    ]
)
RECOVERY = "path string, valid_records long, bytes_recovered long, corruption_detected boolean, corruption_type string, corruption_offset long, file_truncated boolean, length long, crc long"

PUT, DELETE = 1, 2
#: Key lengths are stored in 16 bits by the frame format.
MAX_KEY = 65_535
#: No upper bound given: 2^62 - 1 ns.
END_OF_TIME = (1 << 62) - 1
