"""Reading mutation logs (segments of frames), with a report of what is damaged."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codec import FRAME, MAX_PAYLOAD, decode_entry, encode_frame
from ..schemas import RECOVERY

ROWS = "path string, segment long, position long, key binary, value binary, ts long, op tinyint, seq long"


class Report(dict):
    def __init__(self):
        super().__init__(valid_records=0, bytes_recovered=0, corruption_detected=False, corruption_type=None, corruption_offset=None, file_truncated=False)

    def damaged(self, kind: str, tail: bool) -> None:
        self.update(corruption_detected=True, corruption_type=kind, corruption_offset=self["bytes_recovered"], file_truncated=tail)


def frames(f, size: int, report: Report, upto: int | None = None) -> Iterator[tuple[int, bytes, bytes | None, int, int]]:
    """(offset, key, value, ts, op) of the valid prefix of a segment, a frame at a time; fills ``report``.

    ``file_truncated`` says that the damage is a torn tail, so that the segment may be cut there; damage in the middle
    leaves the segment for quarantine. Nothing is written here. Frames from ``upto`` on are not read.
    """
    while (upto is None or report["bytes_recovered"] < upto) and (head := f.read(FRAME.size)):
        at = report["bytes_recovered"]
        if len(head) < FRAME.size:
            return report.damaged("truncated_tail", True)
        crc, length = FRAME.unpack(head)
        if length > MAX_PAYLOAD or length > size:
            last = at + FRAME.size >= size
            return report.damaged("bad_length" if last else "bad_length_middle", last)
        body = f.read(length)
        if len(body) < length:
            return report.damaged("truncated_tail", True)
        last = at + FRAME.size + length >= size
        if zlib.crc32(body) != crc:
            return report.damaged("bad_crc_tail" if last else "corrupt_middle", last)
        try:
            key, value, ts, op = decode_entry(body)
        except ValueError:
            return report.damaged("decode_error", last)
        yield at, key, value, ts, op
        report["valid_records"] += 1
        report["bytes_recovered"] = at + FRAME.size + length
    return None


def segment_number(path: str) -> int:
    """Segments are ordered by the number in their names, not as text."""
    m = re.search(r"(\d+)\D*$", path.rsplit("/", 1)[-1])
    return int(m[1]) if m else -1


def _open(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    return where.open_input_stream(name, buffer_size=1 << 20), where.get_file_info(name).size


PATTERN = "*.{wal,log}"


def segments(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """(path, length, segment) in order, by Spark's file listing; contents are not read, empty segments not listed."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}").select("path", "length")
    return files.withColumn("segment", F.regexp_extract("path", r"(\d+)[^\d/]*$", 1).try_cast("long")).orderBy("segment")


class _Summed:
    """A file that adds up the checksum of what is read."""

    def __init__(self, f):
        self.f, self.crc = f, 0

    def read(self, n: int) -> bytes:
        data = self.f.read(n)
        self.crc = zlib.crc32(data, self.crc)
        return data


def _recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            report = Report()
            f, size = _open(path)
            with f:
                summed = _Summed(f)
                for _ in frames(summed, size, report):
                    pass
                while summed.read(1 << 20):
                    pass
            rows.append({"path": path, **report, "length": size, "crc": summed.crc})
        yield pa.RecordBatch.from_pylist(rows, schema=_REPORT) if rows else pa.RecordBatch.from_pylist([], schema=_REPORT)


_REPORT = pa.schema([("path", pa.string()), ("valid_records", pa.int64()), ("bytes_recovered", pa.int64()), ("corruption_detected", pa.bool_()), ("corruption_type", pa.string()), ("corruption_offset", pa.int64()), ("file_truncated", pa.bool_()), ("length", pa.int64()), ("crc", pa.int64())])


def recovery_report(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """One row per segment, with its length and checksum."""
    return segments(spark, folder, pattern).select("path").repartition("path").mapInArrow(_recover, RECOVERY)


class _Segment(InputPartition):
    def __init__(self, path: str, upto: int | None):
        super().__init__(0)
        self.path, self.upto = path, upto


_BATCH = pa.schema([("path", pa.string()), ("segment", pa.int64()), ("position", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("ts", pa.int64()), ("op", pa.int8()), ("seq", pa.int64())])


class _Reader(DataSourceReader):
    def __init__(self, parts: list[tuple[str, int | None]]):
        self.parts = parts

    def partitions(self):
        return [_Segment(*p) for p in self.parts]

    def read(self, partition):
        report, n, rows = Report(), segment_number(partition.path), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _BATCH)], schema=_BATCH)
        f, size = _open(partition.path)
        with f:
            for at, key, value, ts, op in frames(f, size, report, partition.upto):
                # position within a segment and the segment's number order versions with one timestamp
                rows.append((partition.path, n, at, key, value, ts, op, (n << 40) + at))
                if len(rows) >= 10_000:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class WalSource(DataSource):
    """``spark.read.format("wal").load(folder)``: the valid prefix of every segment of a folder, a task per segment.

    Option ``pattern`` chooses the segments by name; ``parts`` (JSON, pairs of path and length) reads just those.
    """

    @classmethod
    def name(cls) -> str:
        return "wal"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema):
        from pyarrow import fs

        if "parts" in self.options:
            return _Reader([tuple(p) for p in json.loads(self.options["parts"])])
        path, pattern = self.options["path"], self.options.get("pattern", PATTERN)
        where, name = fs.FileSystem.from_uri(path)
        found = [name]
        if where.get_file_info(name).type == fs.FileType.Directory:
            head, _, ends = pattern.partition("{")
            ends = [head + e for e in ends.rstrip("}").split(",")] if ends else [pattern]
            found = [i.path for i in where.get_file_info(fs.FileSelector(name)) if any(fnmatch(i.base_name, e) for e in ends)]
        scheme = path.split("://")[0] + "://" if "://" in path else ""
        return _Reader([(scheme + p, None) for p in sorted(found, key=segment_number)])


def read_wal(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    spark.dataSource.register(WalSource)
    return spark.read.format("wal").option("pattern", pattern).load(folder)


def read_parts(spark: SparkSession, parts: list[tuple[str, int]]) -> DataFrame:
    """The first bytes of some segments: (path, bytes that hold whole frames), as a recovery report tells them."""
    spark.dataSource.register(WalSource)
    return spark.read.format("wal").option("parts", json.dumps(parts)).load()


def _append(folder: str, first: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        ctx = TaskContext.get()
        where, name = fs.FileSystem.from_uri(folder)
        where.create_dir(name, recursive=True)
        final = f"{name}/wal_{first + ctx.partitionId():06d}.log"
        tmp, n, size = f"{final}.{ctx.taskAttemptId()}.tmp", 0, 0
        with where.open_output_stream(tmp) as out:
            for batch in batches:
                data = b"".join(encode_frame(k, v, ts, op) for k, v, ts, op in zip(*(c.to_pylist() for c in batch.columns)))
                out.write(data)
                n, size = n + batch.num_rows, size + len(data)
        if n:
            where.move(tmp, final)
            yield pa.record_batch([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        else:
            where.delete_file(tmp)

    return write


def write_wal(mutations: DataFrame, folder: str, first: int = 1) -> DataFrame:
    """Append mutations (key, value, ts, op) as segments, one per partition in its order; returns (path, records, bytes).

    A segment appears whole or not at all. Partition order is the order of segments, so sort before if it matters.
    """
    got = mutations.select("key", "value", "ts", "op").mapInArrow(_append(folder, first), "path string, records long, bytes long").collect()
    return mutations.sparkSession.createDataFrame(got, "path string, records long, bytes long")
