"""Leveled storage of mutations: immutable Parquet tables under a versioned manifest."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import entry_size
from ..operators import kv
from ..operators.filters import key_range
from ..schemas import DELETE, KV_MUTATION, TABLE_META
from .files import Folder

LEVELS = 7


@dataclass(frozen=True)
class Options:
    """Sizes as in the storage engine's defaults, but for tables: those suit a file of a distributed store."""

    table_bytes: int = 128 << 20
    bloom_rate: float = 0.01
    l0_trigger: int = 4
    level1_bytes: int = 10 << 20
    #: Manifest versions that stay readable; files that none of them names may be removed.
    keep_versions: int = 5
    #: A folder younger than this may be of a write that is not committed yet; it is never removed.
    vacuum_age_s: int = 86_400

    def level_bytes(self, level: int) -> int:
        return self.level1_bytes * 10 ** (level - 1)


@dataclass
class Table:
    id: int
    level: int
    path: str
    entry_count: int
    data_size: int
    logical_size: int
    min_key: str
    max_key: str
    created_at: int

    def overlaps(self, lo: str | None, hi: str | None) -> bool:
        """Keys as hex, whose order is that of the bytes."""
        return not (lo is not None and self.max_key < lo or hi is not None and self.min_key > hi)


@dataclass
class Manifest:
    version: int = 0
    next_id: int = 1
    tables: list[Table] = field(default_factory=list)
    #: Batches that are in, so that a repeated one is skipped.
    batches: dict[str, int] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    def level(self, n: int) -> list[Table]:
        return sorted((t for t in self.tables if t.level == n), key=lambda t: (t.id,) if n == 0 else (t.min_key, t.id))

    def dump(self) -> str:
        return json.dumps({**self.__dict__, "tables": [t.__dict__ for t in self.tables]})

    @classmethod
    def parse(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(**{**d, "tables": [Table(**t) for t in d["tables"]]})


@dataclass(frozen=True)
class Compaction:
    level: int
    target: int
    inputs: tuple[Table, ...]
    bottom: bool


class Conflict(RuntimeError):
    """Another writer committed this manifest version first."""


def pick(manifest: Manifest, options: Options) -> Compaction | None:
    """What to compact next: all of level 0 once it has enough flushes, else the first table of the level that
    exceeds its target most, with what it overlaps below. The last level is never moved further."""
    levels = {n: manifest.level(n) for n in range(LEVELS)}
    if len({t.path.rsplit("/", 1)[0] for t in levels[0]}) >= options.l0_trigger:
        return _with_overlaps(manifest, 0, levels[0])
    scores = {n: sum(t.data_size for t in levels[n]) / options.level_bytes(n) for n in range(1, LEVELS - 1)}
    worst = max(scores, key=lambda n: scores[n])
    return _with_overlaps(manifest, worst, levels[worst][:1]) if scores[worst] > 1.0 else None


def _with_overlaps(manifest: Manifest, level: int, chosen: list[Table]) -> Compaction:
    lo, hi = min(t.min_key for t in chosen), max(t.max_key for t in chosen)
    below = [t for t in manifest.level(level + 1) if t.overlaps(lo, hi)]
    lo, hi = min([lo, *(t.min_key for t in below)]), max([hi, *(t.max_key for t in below)])
    deeper = any(t.overlaps(lo, hi) for n in range(level + 2, LEVELS) for t in manifest.level(n))
    # tombstones may go only if no older version of their keys lies below; above, versions are newer
    return Compaction(level, level + 1, tuple(chosen + below), not deeper)


class Store:
    """Mutations in levels. Writers commit by creating the next manifest file, which only one of them can do."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or Options()
        #: Read without Bloom filters, to measure what they save.
        self.bypass_bloom = False
        self._log = Folder(spark, f"{self.root}/manifest")

    # -- manifest

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self._log.names() if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, version: int | None = None) -> Manifest:
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        return Manifest.parse(self._log.read(f"{version:020d}.json")) if version else Manifest()

    def _commit(self, m: Manifest) -> Manifest:
        m.version += 1
        if not self._log.create(f"{m.version:020d}.json", m.dump()):
            raise Conflict(f"version {m.version} exists")
        return m

    # -- tables

    def _write(self, rows: DataFrame, level: int, m: Manifest, files: int | None = None) -> list[Table]:
        """Sorted, range-partitioned Parquet files with Bloom filters on the key; one table per file."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        by = ("key", F.desc("ts"), F.desc("seq"))
        # level 0 may hold many versions of a hot key: those are split too; below, keys are unique
        ordered = rows.repartitionByRange(*by) if level == 0 else rows.repartitionByRange(files or 1, "key")
        writer = ordered.sortWithinPartitions(*by).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_rate))
        # sized by the number of keys that a file turns out to hold
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(folder)
        stats = (
            self.spark.read.schema(KV_MUTATION)
            .parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(entry_size(F.col("key"), F.col("value"))).alias("logical"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"))
            .orderBy("lo")
            .collect()
        )
        out, now = [], time.time_ns()
        for r in stats:
            out.append(Table(m.next_id, level, r["path"], r["n"], r["size"], r["logical"], r["lo"], r["hi"], now))
            m.next_id += 1
        return out

    def flush(self, mutations: DataFrame, *batches: str | None) -> Manifest:
        """Append mutations as level-0 tables. If all their batch ids are in already nothing is done, so retries are safe."""
        m = self.manifest()
        batches = [b for b in batches if b is not None]
        if batches and all(b in m.batches for b in batches):
            return m
        tables = self._write(kv.checked(mutations), 0, m)
        m.tables += tables
        m.batches |= {b: m.version + 1 for b in batches}
        for k, v in (("flushes", 1), ("logical_bytes", sum(t.logical_size for t in tables)), ("flush_bytes", sum(t.data_size for t in tables))):
            m.counters[k] = m.counters.get(k, 0) + v
        return self._commit(m)

    def mutations(self, start: bytes | None = None, end: bytes | None = None, version: int | None = None) -> DataFrame:
        """All stored mutations that may fall in the range: files are pruned by the manifest, row groups by Parquet."""
        lo, hi = start.hex().upper() if start is not None else None, end.hex().upper() if end is not None else None
        paths = [t.path for t in self.manifest(version).tables if t.overlaps(lo, hi)]
        if not paths:
            return self.spark.createDataFrame([], KV_MUTATION)
        rows = self.spark.read.schema(KV_MUTATION).option("parquet.filter.bloom.enabled", str(not self.bypass_bloom).lower()).parquet(*paths)
        return rows.where(key_range(start, end))

    def current(self, version: int | None = None) -> DataFrame:
        return kv.current(self.mutations(version=version))

    def get(self, key: bytes, version: int | None = None) -> DataFrame:
        return kv.current(self.mutations(key, key, version))

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int | None = None, version: int | None = None) -> DataFrame:
        return kv.scan(self.mutations(start, end, version), start, end, limit)

    # -- compaction

    def compact(self) -> Compaction | None:
        """One compaction, if one is due: newest versions only, without tombstones where nothing lies below."""
        m = self.manifest()
        work = pick(m, self.options)
        if work is None:
            return None
        rows = self.spark.read.schema(KV_MUTATION).parquet(*[t.path for t in work.inputs])
        merged = kv.newest(rows)
        if work.bottom:
            merged = merged.where(F.col("op") != DELETE)
        size = sum(t.data_size for t in work.inputs)
        tables = self._write(merged, work.target, m, max(1, -(-size // self.options.table_bytes)))
        gone = {t.id for t in work.inputs}
        m.tables = [t for t in m.tables if t.id not in gone] + tables
        n_in, n_out = sum(t.entry_count for t in work.inputs), sum(t.entry_count for t in tables)
        for k, v in (("compactions", 1), ("compaction_read_bytes", size), ("compaction_bytes", sum(t.data_size for t in tables)), ("entries_dropped", n_in - n_out)):
            m.counters[k] = m.counters.get(k, 0) + v
        self._commit(m)
        return work

    def compact_all(self) -> int:
        n = 0
        while self.compact():
            n += 1
        return n

    def vacuum(self) -> int:
        """Remove files that none of the last versions names, and older manifests; returns the number of folders removed.

        What a running write has made but not committed yet is told by its age and stays.
        """
        versions = self.versions()
        kept = versions[-self.options.keep_versions :]
        named = {t.path.rsplit("/", 2)[-2] for v in kept for t in self.manifest(v).tables}
        data, n, now = Folder(self.spark, f"{self.root}/data"), 0, time.time()
        for name in data.names():
            if name not in named and now - data.fs.getFileStatus(data.of(name)).getModificationTime() / 1000 >= self.options.vacuum_age_s:
                data.delete(name)
                n += 1
        for v in versions[: -self.options.keep_versions]:
            self._log.delete(f"{v:020d}.json")
        return n

    def tables(self, version: int | None = None) -> DataFrame:
        """The manifest as a DataFrame."""
        rows = [(t.id, t.level, t.path, t.entry_count, t.data_size, t.logical_size, bytearray.fromhex(t.min_key), bytearray.fromhex(t.max_key), t.created_at) for t in self.manifest(version).tables]
        return self.spark.createDataFrame(rows, TABLE_META)
