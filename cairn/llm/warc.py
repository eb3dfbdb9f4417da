"""WARC: archives written and read as streams, with oversized payloads as (record, chunk number) rows."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, small_side, written

CHUNK, ARCHIVE, BLOCK = 1 << 18, 1 << 30, 1 << 16
#: The chunk of the query on pages.
PAGE_CHUNK = 1 << 12
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = "record_id string, record_type string, refers_to string, chunk_no int, chunk_offset long, data binary, running_digest string, is_last boolean, payload_bytes long, digest_ok boolean"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(key) -> str:
    return f"<urn:record:{'' if key is None else quote(str(key), safe='')}>"


def _key(urn: str) -> str | None:
    return unquote(urn[12:-1]) or None


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class _Archives:
    """The archives that one task writes: a new file after ``ARCHIVE`` bytes, each under a temporary name until whole.

    Names carry the attempt: a second attempt of a task may cut archives elsewhere, and those that the manifest does
    not name are of attempts that did not finish.
    """

    def __init__(self, folder: str, part: int, attempt: int, level: int, most: int):
        self.fs, self.folder = _fs(folder)
        self.part, self.attempt, self.level, self.most = part, attempt, level, most
        self.n, self.out, self.done = 0, None, []
        self.fs.create_dir(self.folder, recursive=True)

    def begin(self, head: str) -> None:
        if self.out is not None and self.bytes >= self.most:
            self.close()
        if self.out is None:
            self.name = f"{self.folder}/part-{self.part:06d}-{self.n:04d}-{self.attempt}.warc.gz"
            self.tmp = f"{self.name}.tmp"
            self.out, self.bytes, self.records, self.n = self.fs.open_output_stream(self.tmp), 0, 0, self.n + 1
            info = "software: cairn\r\nformat: WARC File Format 1.1\r\n"
            self.begin(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{self.part}-{self.n}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}")
            self.end()
            self.records = 0
        self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.put(head.encode())

    def put(self, data: bytes) -> None:
        if z := self.zip.compress(data):
            self.out.write(z)
            self.bytes += len(z)

    def end(self) -> None:
        self.put(b"\r\n\r\n")
        z = self.zip.flush()
        self.out.write(z)
        self.bytes += len(z)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.tmp, self.name)
            self.done.append((self.name, self.records, self.bytes))
            self.out = None


def _writer(folder: str, level: int, most: int):
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, to = TaskContext.get(), None
        to = _Archives(folder, ctx.partitionId(), ctx.taskAttemptId(), level, most)
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                key, uri, digest, size, head, no, last, data = (c[i].as_py() for c in cols)
                if no == 0:
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n"
                    kind = "response" if head is None else "revisit"
                    more = "" if head is None else f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: {_urn(head)}\r\n"
                    to.begin(
                        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {_urn(key)}\r\nWARC-Date: {DATE}\r\n"
                        f"WARC-Target-URI: {quote(uri or 'urn:unknown', safe=':/?#[]@!$&()*+,;=%~-._')}\r\nWARC-Payload-Digest: sha1:{_b32(digest)}\r\n{more}"
                        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + (size if head is None else 0)}\r\n\r\n{http}"
                    )
                if data:
                    to.put(data)
                if last:
                    to.end()
        to.close()
        if to.done:
            names, records, sizes = zip(*to.done)
            yield pa.record_batch([pa.array([scheme + n for n in names]), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return write


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    chunk: int = CHUNK,
    archive_bytes: int = ARCHIVE,
    level: int = 1,
) -> DataFrame:
    """Write one record per row into gzipped archives under ``folder`` (shared storage); returns the manifest.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id is a response and the
    others revisit it; rows that repeat both id and payload of the response are responses too. The payload is cut
    into chunk rows before it leaves the JVM, so the writer holds one chunk at a time and payloads of any length
    stream through. Payloads are strings (UTF-8) or binary; null counts as empty, a null url as urn:unknown, a null
    id sorts lowest and reads back as null. An empty table writes no archive.

    Equal payloads are found by SHA-1 and length with partial aggregation; a hot payload is one row per task. Payloads
    stay where they are read as long as there are 1 million repeated ones at most; beyond that they shuffle by digest.
    Columns of other names are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    binary = dict(pages.dtypes)[payload_col] == "binary"
    payload = F.coalesce(F.col(payload_col), F.lit(b"")) if binary else F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    told = rows.join(small_side(written(heads, "heads")), ["digest", "size"], "left").withColumn("head", F.when(~F.col("head").eqNullSafe(F.col("key")), F.col("head")))
    n = F.when(F.col("head").isNull(), F.greatest(F.lit(0), F.expr(f"(size - 1) div {chunk}"))).otherwise(0).cast("int")
    cut = told.withColumn("last_no", n).withColumn("no", F.explode(F.sequence(F.lit(0), F.col("last_no"))))
    data = F.when(F.col("head").isNull(), F.substring("payload", F.col("no") * chunk + 1, chunk))
    cut = cut.select("key", "uri", "digest", "size", "head", "no", (F.col("no") == F.col("last_no")).alias("last"), data.alias("data"))
    manifest = cut.mapInArrow(_writer(folder + "/archives", level, archive_bytes), MANIFEST)
    manifest.write.parquet(folder + "/manifest")
    return spark.read.schema(MANIFEST).parquet(folder + "/manifest")


class _Stream:
    """Decompressed bytes of a file of gzip members (or plain), a block at a time."""

    def __init__(self, f):
        self.f, self.buf, self.at = f, b"", 0
        self.raw = f.read(BLOCK)
        self.z = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        got = b""
        while not got:
            if not self.raw and not (raw := self.f.read(BLOCK)):
                return False
            raw = self.raw or raw
            if self.z is None:
                got, self.raw = raw, b""
                continue
            got = self.z.decompress(raw, 4 * BLOCK)
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            else:
                self.raw = self.z.unconsumed_tail
        self.buf, self.at = self.buf[self.at :] + got, 0
        return True

    def line(self) -> bytes | None:
        while (end := self.buf.find(b"\r\n", self.at)) < 0:
            if not self.more():
                return None
        got, self.at = self.buf[self.at : end], end + 2
        return got

    def take(self, n: int) -> bytes:
        while len(self.buf) - self.at < n and self.more():
            pass
        got = self.buf[self.at : self.at + n]
        self.at += len(got)
        return got

    def head(self) -> dict[str, str] | None:
        out: dict[str, str] = {}
        while (x := self.line()) is not None:
            if not x:
                if out:
                    return out
                continue
            k, _, v = x.decode("utf-8", "replace").partition(":")
            out[k.strip().lower()] = v.strip()
        return out or None


def records(f, chunk: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """Chunk rows of an open archive, in the order of ``CHUNKS``; holds one chunk at a time.

    ``running_digest`` is the SHA-1 (base32) of the payload up to and with the chunk. A revisit gives one row with
    the length and digest of the full payload that its headers state.
    """
    s = _Stream(f)
    while head := s.head():
        left = int(head.get("content-length", 0))
        kind = head.get("warc-type")
        if kind not in ("response", "revisit", "resource"):
            while left and (got := s.take(min(left, BLOCK))):
                left -= len(got)
            continue
        rid, refers = _key(head["warc-record-id"]), _key(head["warc-refers-to"]) if "warc-refers-to" in head else None
        told = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        length = left
        if head.get("content-type", "").startswith("application/http"):
            size = left
            http: dict[str, str] = {}
            while (x := s.line()) is not None:
                left -= len(x) + 2
                if not x or left <= 0:
                    break
                k, _, v = x.decode("latin-1").partition(":")
                http[k.strip().lower()] = v.strip()
            length = int(http.get("content-length", size)) if kind == "revisit" else left
        if kind == "revisit":
            # a block of its own, if it has one, is not the payload
            while left > 0 and (got := s.take(min(left, BLOCK))):
                left -= len(got)
            yield rid, kind, refers, 0, 0, None, told, True, length, None
        else:
            sha, no, at = hashlib.sha1(), 0, 0
            while True:
                data = s.take(min(left, chunk))
                if left and not data:
                    raise EOFError(f"archive ends within record {rid}")
                left -= len(data)
                sha.update(data)
                now = _b32(sha.copy().digest())
                yield rid, kind, refers, no, at, data if with_data else None, now, not left, length, None if left or not told else now == told
                no, at = no + 1, at + len(data)
                if not left:
                    break


def _reader(chunk: int, with_data: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CHUNKS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _fs(path)
                rows, held = [], 0
                with fs.open_input_stream(name) as f:
                    for row in records(f, chunk, with_data):
                        rows.append(row)
                        held += len(row[5] or b"") + 200
                        if held > 4 << 20:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return read


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The archives of a manifest (column ``path``) as chunk rows, see ``records``. Archives are spread over tasks."""
    n = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(n, "path").mapInArrow(_reader(chunk, with_data), CHUNKS)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and report each record from its last chunk row.

    Chunks are small enough that larger pages have several. See ``write_archives`` for nulls, empty and very long
    payloads, ties, repeated rows, empty tables and other columns.
    """
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), chunk=PAGE_CHUNK)
    got = read_archives(manifest, PAGE_CHUNK, with_data=False).where("is_last")
    return got.select(
        F.col("record_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("running_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        (F.col("chunk_no") + 1).alias("chunks"),
    )


#: Base32 of the digest: 8 groups of 5 bits from each half of 20 hex digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
q AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(x, 10 * i + 1, 10))::BIGINT) AS five FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to,
       (CASE WHEN page_id = top THEN greatest(0, (n - 1) // 4096) ELSE 0 END + 1)::INTEGER AS chunks FROM q
"""
