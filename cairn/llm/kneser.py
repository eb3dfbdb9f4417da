"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, from_files, lean, scratch_path, small_batches, small_side, trim, with_place, written

ORDER = 6
#: Bytes that no UTF-8 text holds.
START, END = b"\xfe", b"\xff"
QUANTILE, LEAST_DOCS = 0.995, 50
#: Bytes at the language's own mean that are added to each text, so that a text of one word is not judged by chance.
PRIOR = 64
#: Rows of a shard of the model, shards at least, and splits of the documents that meet a shard in one task.
SHARD_ROWS, SHARDS, SPLITS = 1_000_000, 8, 64
#: Bytes of trusted texts for each shard in which their windows are counted.
SHARD_BYTES = 1 << 25
#: Distinct windows of a split that a task gathers before it sends them.
GATHERED = 2_000_000
_PIECE = 1 << 19


def _pieces(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(bytes, row of each segment, where each segment begins): about 512 kB at a time, long texts in several segments.

    A text is its UTF-8 bytes after five start marks and before an end mark. A segment repeats the last five bytes of
    the one before as its context, so that each window of six bytes occurs once.
    """
    ctx = ORDER - 1
    held, rows, begins, size = [], [], [], 0
    for row, text in enumerate(texts):
        data = START * ctx + (text.as_py() or "").encode("utf-8", "surrogatepass") + END
        for at in range(0, len(data) - ctx, _PIECE):
            part = data[at : at + _PIECE + ctx]
            held.append(part)
            rows.append(row)
            begins.append(size)
            size += len(part)
            if size >= _PIECE:
                yield b"".join(held), np.array(rows), np.array(begins)
                held, rows, begins, size = [], [], [], 0
    if held:
        yield b"".join(held), np.array(rows), np.array(begins)


def _windows(data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every six-byte window as a number, and whether it lies within one segment."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(x) - ORDER + 1
    k = np.zeros(n, np.uint64)
    for j in range(ORDER):
        k = (k << np.uint64(8)) | x[j : j + n]
    inside = np.ones(n, bool)
    for j in range(1, ORDER):
        b = begins[1:] - j
        inside[b[b < n]] = False
    return k, inside


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[starts], np.add.reduceat(c, starts)


def _count(shards: int):
    """Counts of the windows of a task's texts, added up before they leave it: sorted, in a packed pair per shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        parts, rows = [], 0

        def out(k, c):
            of = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)
            rows = [(i, _packed(k[of == i]), _packed(c[of == i])) for i in range(shards) if (of == i).any()]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

        for batch in batches:
            for data, _, begins in _pieces(batch.column(0)):
                k, inside = _windows(data, begins)
                k, c = np.unique(k[inside], return_counts=True)
                parts.append((k, c.astype(np.int64)))
                rows += len(k)
                if rows > GATHERED // 2:
                    parts = [_add(parts)]
                    rows = len(parts[0][0])
                    if rows > GATHERED // 4:
                        yield out(*parts[0])
                        parts, rows = [], 0
        if parts:
            yield out(*_add(parts))
        trim()

    return count


def _merged(shard: pa.Table) -> pa.Table:
    """The counts of a shard, added up a few parts at a time."""
    lean()
    parts, rows = [], 0
    for keys, counts in zip(shard.column("keys"), shard.column("counts")):
        parts.append((_unpacked(keys.as_py(), np.uint64), _unpacked(counts.as_py(), np.int64)))
        rows += len(parts[-1][0])
        if rows > GATHERED:
            parts = [_add(parts)]
            rows = 0
    k, c = _add(parts)
    return pa.table([pa.array(k.astype(np.int64)), pa.array(c)], ["k", "c"])


def train(texts: DataFrame) -> DataFrame:
    """The model as a table (level, ctx, k, v): k null, v = log weight of the lower order after ctx; else v = log p(k).

    ``texts`` has one column. The counts of all six-byte windows of all texts are added up, by shard; everything below
    follows from them by joins and sums over that table: the counts of lower orders are continuation counts (how
    many different bytes stand before; at the start of a text, where only the mark can, plain counts), each order has its three discounts from its counts of counts, and each
    probability is interpolated with the next lower order's, down to a uniform byte.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    counts = texts.mapInArrow(_count(max(2 * SHARDS, -(-size // SHARD_BYTES))), "shard int, keys binary, counts binary")
    level = written(counts.groupBy("shard").applyInArrow(_merged, "k long, c long"), "ngrams")
    tables = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        own = F.col("k").bitwiseAND((1 << 8 * n) - 1).alias("k")
        first = F.shiftright("k", 8 * (n - 1)) == START[0]
        counts = tables[n + 1].groupBy(own).agg(F.count(F.lit(1)).alias("c"), F.sum("c").alias("plain"))
        tables[n] = written(counts.select("k", F.when(first, F.col("plain")).otherwise(F.col("c")).alias("c")), "ngrams")
    out, lower, used = None, None, []
    for n in range(1, ORDER + 1):
        t = tables[n]
        n1, n2, n3, n4 = (x or 0 for x in t.agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        d = [min(max(x, 0.05), 0.95 * (i + 1)) for i, x in enumerate(d)]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        ctx = F.shiftright("k", 8)
        contexts = written(t.groupBy(ctx.alias("ctx")).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("g")), "contexts")
        p = t.withColumn("ctx", ctx).join(contexts, "ctx").withColumn("own", (F.col("c") - cut) / F.col("total"))
        if lower is None:
            p = p.withColumn("p", F.col("own") + F.col("g") / 256)
        else:
            p = p.withColumn("low", F.col("k").bitwiseAND((1 << 8 * (n - 1)) - 1)).join(lower, "low").withColumn("p", F.col("own") + F.col("g") * F.col("lp"))
        p = written(p.select("k", "ctx", "p"), "probs")
        used += [t, contexts, p]
        lower = p.select(F.col("k").alias("low"), F.col("p").alias("lp"))
        rows = p.select(F.lit(n).alias("level"), "ctx", "k", F.log("p").cast("float").alias("v")).unionByName(contexts.select(F.lit(n).alias("level"), "ctx", F.lit(None).cast("long").alias("k"), F.log("g").cast("float").alias("v")))
        out = rows if out is None else out.unionByName(rows)
    model = written(out, "model")
    drop(*used)
    return model


class Shard:
    """Part of the model in sorted arrays."""

    def __init__(self, level: np.ndarray, ctx: np.ndarray, k: np.ndarray, is_ctx: np.ndarray, v: np.ndarray):
        self.probs, self.weights = {}, {}
        for n in range(1, ORDER + 1):
            a, b = (level == n) & ~is_ctx, (level == n) & is_ctx
            for where, keys, to in ((a, k, self.probs), (b, ctx, self.weights)):
                kk, vv = keys[where].astype(np.uint64), v[where]
                o = np.argsort(kk)
                to[n] = (kk[o], vv[o])
        self.floor = np.float32(np.log(1 / 256))

    @staticmethod
    def find(table, k):
        keys, v = table
        if not len(keys):
            return np.zeros(len(k), bool), np.zeros(len(k), np.float32)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return keys[at] == k, v[at]

    def exact(self, k: np.ndarray, n: int = ORDER) -> np.ndarray:
        """log p of windows of n bytes, by search and back-off."""
        if n == 0:
            return np.full(len(k), self.floor)
        found, v = self.find(self.probs[n], k)
        v = v.copy()
        if not found.all():
            rest = k[~found]
            low = self.exact(rest & np.uint64((1 << 8 * (n - 1)) - 1), n - 1)
            seen, g = self.find(self.weights[n], rest >> np.uint64(8))
            v[~found] = low + np.where(seen, g, np.float32(0))
        return v


def _of_shard(k, shards: int):
    """The shard of a window: by the two bytes before its last, which all its contexts of two bytes or more share."""
    return ((k >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)


def _packed(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: of sorted keys the high ones are almost constant."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 3)


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _runs(batch: pa.RecordBatch, split: int) -> Iterator[tuple[str, int, int]]:
    """(split, first row, row after the last) of a batch's runs of rows of one split."""
    names, at = batch.column(split).to_pylist(), 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[at]:
            yield names[at], at, i
            at = i


def _distinct(shards: int):
    """The distinct windows of each split, sorted, in a blob per shard."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(split, parts):
            k = np.unique(np.concatenate(parts))
            of = _of_shard(k, shards)
            blobs = [(i, k[of == i]) for i in range(shards)]
            rows = [(split, i, _packed(x)) for i, x in blobs if len(x)]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["split", "shard", "keys"])

        lean()
        now, parts, rows = None, [], 0
        for batch in batches:
            for split, a, b in _runs(batch, 1):
                if split != now and parts:
                    yield out(now, parts)
                    parts, rows = [], 0
                now = split
                for data, _, begins in _pieces(batch.column(0).slice(a, b - a)):
                    k, inside = _windows(data, begins)
                    parts.append(np.unique(k[inside]))
                    rows += len(parts[-1])
                    if rows > GATHERED:
                        parts = [np.unique(np.concatenate(parts))]
                        rows = len(parts[0])
                        if rows > GATHERED // 2:
                            yield out(now, parts)
                            parts, rows = [], 0
        if parts:
            yield out(now, parts)
        trim()

    return distinct


def _joined(windows: pa.Table, model: pa.Table) -> pa.Table:
    """The windows of some splits with the log probability of each, from the shard of the model that has all they need."""
    k = model.column("k")
    shard = Shard(*(model.column(c).to_numpy() for c in ("level", "ctx")), k.fill_null(0).to_numpy(), k.is_null().to_numpy(), model.column("v").to_numpy())
    logs = [_packed(shard.exact(_unpacked(x.as_py(), np.uint64)).astype(np.float32)) for x in windows.column("keys")]
    return pa.table([windows.column("group"), windows.column("split"), windows.column("keys"), pa.array(logs, pa.binary())], ["group", "split", "keys", "logs"])


def _table(folder: str, split: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows and log probabilities of a split, sorted, from the shared folder: only the row groups that hold it."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(folder)
    files = [i.path for i in where.get_file_info(fs.FileSelector(name)) if i.path.endswith(".parquet")]
    got = ds.dataset(files, format="parquet", filesystem=where).to_table(["keys", "logs"], filter=ds.field("split") == split)
    if not got.num_rows:
        raise RuntimeError(f"no probabilities for {split}: its files were not read in the same splits again")
    k = np.concatenate([_unpacked(x, np.uint64) for x in got.column("keys").to_pylist()])
    v = np.concatenate([_unpacked(x, np.float32) for x in got.column("logs").to_pylist()])
    order = np.argsort(k, kind="stable")
    return k[order], v[order]


def _summed(folder: str, groups: int):
    """The log probability and the number of windows of each row, after its other columns; (text, split, group) come first."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        now, keys, logs = None, None, None
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for split, a, b in _runs(batch, 1):
                if split != now:
                    keys, logs = _table(f"{folder}/group={batch.column(2)[a].as_py()}", split)
                    now = split
                for data, rows, begins in _pieces(batch.column(0).slice(a, b - a)):
                    k, inside = _windows(data, begins)
                    of = np.repeat(rows + a, np.diff(np.append(begins, len(data))))[: len(k)][inside]
                    u, back = np.unique(k[inside], return_inverse=True)
                    total += np.bincount(of, logs[np.searchsorted(keys, u)][back].astype(float), batch.num_rows)
                    n += np.bincount(of, minlength=batch.num_rows)
            yield pa.record_batch([*batch.columns[3:], pa.array(total), pa.array(n)], [*batch.schema.names[3:], "logp", "n"])
        keys = logs = None
        trim()

    return score


def perplexities(docs: DataFrame, model: DataFrame, text_col: str = "text", shard_rows: int = SHARD_ROWS, shards: int = SHARDS, splits: int = SPLITS) -> DataFrame:
    """Each row of ``docs`` but for its text, with (logp, n, perplexity): perplexity is per byte over the whole text.

    A join of two counts tables, by shard: each split of the files (what one task reads) gathers its distinct windows;
    they go, packed, to the shard of the model that holds all their contexts, a part of at most ``splits`` splits per
    task; the probabilities come back to a table in the shared folder, from which the task that reads the split
    again takes those of its own and adds them up per row. The model is never collected or broadcast and the texts
    are never shuffled, whatever the size of either; orders one and two (65,792 rows at most) are in each shard.

    ``docs`` is read twice, so rows that are not read from files are written first. Each row is judged by itself.
    """
    if not from_files(docs):
        docs = written(docs, "documents")
    at = F.concat_ws(":", F.input_file_name(), F.expr("input_file_block_start()"))
    base = docs.select(F.col(text_col).alias("__text"), at.alias("split"), *[c for c in docs.columns if c != text_col])
    own = [(c, t) for c, t in docs.dtypes if c != text_col]
    shards = max(shards, -(-model.count() // shard_rows))
    windows = written(base.select("__text", "split").mapInArrow(_distinct(shards), "split string, shard int, keys binary"), "windows")
    groups = max(1, -(-windows.select("split").distinct().count() // splits))
    group = F.pmod(F.xxhash64("split"), F.lit(groups)).cast("int").alias("group")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    middle = (F.coalesce(F.shiftright("k", 8), F.col("ctx")).bitwiseAND(0xFFFF) % shards).cast("int")
    parts = model.withColumn("shard", F.explode(F.when(F.col("level") <= 2, every).otherwise(F.array(middle)))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = windows.select(group, "shard", "split", "keys").groupBy("group", "shard")
    joined = sent.cogroup(parts.groupBy("group", "shard")).applyInArrow(_joined, "group int, split string, keys binary, logs binary")
    folder = scratch_path(docs.sparkSession, "probabilities")
    joined.sortWithinPartitions("group", "split").write.option("parquet.block.size", 1 << 20).option("compression", "none").partitionBy("group").parquet(folder)
    drop(windows)
    schema = ", ".join(f"`{c}` {t}" for c, t in [*own, ("logp", "double"), ("n", "long")])
    out = base.select("__text", "split", group, *[c for c, _ in own]).mapInArrow(_summed(folder, groups), schema)
    # an empty text has its end mark only
    return out.withColumn("perplexity", F.when(F.col("n") > 1, F.exp(-F.col("logp") / F.col("n"))))


def _judged(base: DataFrame, trusted: DataFrame, quantile: float, prior: float, **sizes) -> DataFrame:
    """The rows of ``base`` (doc_id, text, lang and others) but for their texts, with perplexity, score, threshold, kept."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    with small_batches(base.sparkSession):
        model = train(base.join(small_side(ids.where(~held)), "doc_id", "left_semi").select("text"))
        told = written(perplexities(base, model, "text", **sizes), "perplexities")
    drop(model)
    by = told.join(small_side(ids.where(held)), "doc_id", "left_semi").where("perplexity is not null")
    mean = lambda: F.sum("logp") / F.sum("n")
    score = lambda m: F.exp(-(F.col("logp") + prior * m) / (F.col("n") + prior))
    langs = by.groupBy("lang").agg(mean().alias("m"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS).select(F.col("lang").alias("l"), "m")
    every = by.agg(mean().alias("all_m"))

    def scored(rows: DataFrame) -> DataFrame:
        with_means = rows.join(F.broadcast(every)).join(small_side(langs, 100_000), rows["lang"].eqNullSafe(langs["l"]), "left")
        return with_means.withColumn("score", F.when(F.col("perplexity").isNotNull(), score(F.coalesce("m", "all_m", F.lit(0.0)))))

    q = lambda: F.percentile_approx("score", quantile, 10_000)
    held_back = written(scored(by).select("l", "score"), "held")
    per = held_back.groupBy("l").agg(q().alias("t"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_DOCS).select(F.col("l").alias("tl"), "t")
    out = scored(told)
    out = out.join(small_side(per, 100_000), out["lang"].eqNullSafe(per["tl"]), "left").join(F.broadcast(held_back.agg(q().alias("all_t"))))
    threshold = F.coalesce("t", "all_t", F.lit(float("inf")))
    others = [c for c in base.columns if c != "text"]
    return out.select(*others, "perplexity", "score", threshold.alias("threshold"), F.coalesce(F.col("score") <= threshold, F.lit(False)).alias("kept"))


def quality(
    docs: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    prior: float = PRIOR,
    **sizes,
) -> DataFrame:
    """(doc_id, lang, perplexity, score, threshold, kept) for each row of ``docs``.

    ``trusted`` holds the ids of trusted rows. A fifth of those (by a hash of the id) is held back; the model counts
    the whole texts of all others. ``score`` is the perplexity of the text and ``prior`` more bytes at the mean of
    its language's held-back rows. A language's threshold is the ``quantile`` of the held-back rows' scores in it; a
    language with fewer than 50 of them (null is a language too) has mean and threshold of all held-back rows, and
    without any, every text that has words is kept. A row is kept if its score is at most its threshold. ``sizes``
    (see ``perplexities``) change no result.

    Every row is judged by its own text, whatever its id: null ids (never trusted) and repeated ones each give a row,
    and repeated rows are judged alike. Null and empty texts have no perplexity and are not kept; texts of any length
    are read whole, a piece at a time. Empty tables give an empty result. Columns of other names are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return _judged(base, trusted, quantile, prior, **sizes)


def with_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **params) -> DataFrame:
    """``docs`` with ``__kept``, see ``quality``: rows are told apart by their place in the files of ``docs``."""
    placed = with_place(docs, "documents")
    base = placed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), "__file", "__at")
    judged = _judged(base, trusted, params.pop("quantile", QUANTILE), params.pop("prior", PRIOR), **params)
    gone = written(judged.where("not kept").select("__file", "__at", F.lit(False).alias("__kept")), "rejected")
    told = placed.join(small_side(gone), ["__file", "__at"], "left")
    return told.select(*docs.columns, F.coalesce("__kept", F.lit(True)).alias("__kept"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that ``labels`` marks as of good quality."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of the trusted ones; see ``quality`` for nulls, empty and very long texts, ties at
    the threshold, repeated rows, empty tables and other columns."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark, sf_dir))
