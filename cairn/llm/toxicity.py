"""Toxicity by a convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, lean, small_batches, small_side, trim, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 8
SLOTS = sum(WIDTHS) * FILTERS
PAD = max(WIDTHS) - 1
#: Labelled rows and their characters that a shard of the fit has, about; a task holds one shard.
SHARD_ROWS, SHARD_CHARACTERS = 8192, 32_000_000
EPOCHS, BATCH, RATE, LEAST_TEXTS = 8, 32, 0.01, 3
#: Passes over all shards, where there are several; pieces of the embedding that are averaged apart.
ROUNDS, SLICES = 3, 64
#: Words that a worker remembers.
REMEMBERED = 200_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits (all that is not ASCII counts as a letter)."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split() if text else []


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself, its beginnings of 3 to 6 bytes and its last 4, so that inflected forms share some."""
    marked = b"<" + word + b">"
    parts = {b"=" + marked, *(marked[: n + 1] for n in (3, 4, 5, 6) if n < len(word)), marked[-5:]}
    return [xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) + 1 for p in sorted(parts)]


_FEATURES = 6


class Words(dict):
    """word -> its number; the buckets of words not yet fetched wait in ``new``. Number 0 is the padding."""

    def __init__(self):
        super().__init__()
        self.n, self.new = 1, [[0] * _FEATURES]

    def __missing__(self, word: bytes) -> int:
        f = features(word)
        self.new.append(f + [0] * (_FEATURES - len(f)))
        self[word] = got = self.n
        self.n += 1
        return got

    def fetched(self) -> np.ndarray:
        rows, self.new = np.array(self.new, np.int64).reshape(-1, _FEATURES), []
        return rows

    def of(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))


class Net:
    """Embedding, filters of each width, and the output layer."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.conv = np.concatenate([r.normal(0, 1 / np.sqrt(w * DIM) * 3, (DIM, w * FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        # never negative: filters gather signs of label 1, and a text without any has the lowest score
        self.out = np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.emb[0] = 0

    def parts(self) -> list[np.ndarray]:
        return [self.emb, self.conv, self.bias, self.out, self.base]

    def slots(self, feats: np.ndarray) -> np.ndarray:
        """What each word adds to each place of each filter."""
        return self.emb[feats].sum(axis=1) @ self.conv

    def maps(self, slots: np.ndarray, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Filter outputs at each word; 0 at the padding between texts."""
        n, out, at = len(ids), [], 0
        for k, w in enumerate(WIDTHS):
            m = self.bias[k * FILTERS : (k + 1) * FILTERS] + slots[ids, at : at + FILTERS]
            for j in range(1, w):
                m[: n - j] += slots[ids[j:], at + j * FILTERS : at + (j + 1) * FILTERS]
            at += w * FILTERS
            out.append(m)
        m = np.concatenate(out, axis=1)
        np.maximum(m, 0, out=m)
        m[~real] = 0
        return m

    def logits(self, slots: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        ids, real, begins = laid_out(texts)
        top = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        doc = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(ids))))
        # a text of any length goes by a stretch at a time, so the maps stay small
        step = 100_000
        for a in range(0, len(ids), step):
            m = self.maps(slots, ids[a : a + step + PAD], real[a : a + step + PAD])[:step]
            d = doc[a : a + len(m)]
            starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            top[d[starts]] = np.maximum(top[d[starts]], np.maximum.reduceat(m, starts, axis=0))
        # a text without words says nothing
        return np.where([len(t) > 0 for t in texts], (top @ self.out + self.base[0]).astype(float), np.nan)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows of all texts with padding between, which of them are words, and where each text begins."""
    begins = np.concatenate(([0], np.cumsum([len(t) + PAD for t in texts])))
    ids, real = np.zeros(begins[-1], np.int64), np.zeros(begins[-1], bool)
    for t, b in zip(texts, begins):
        ids[b : b + len(t)] = t
        real[b : b + len(t)] = True
    return ids, real, begins[:-1]


def seen_in(texts: list[np.ndarray], feats: np.ndarray) -> np.ndarray:
    """In how many texts each bucket is."""
    seen = np.zeros(BUCKETS, np.int32)
    for t in texts:
        own = np.zeros(BUCKETS, bool)
        own[feats[t]] = True
        seen += own
    return seen


def rates(passes: int) -> list[float]:
    return [RATE * (1 - k / passes) for k in range(passes)]


def fit(
    texts: list[np.ndarray],
    labels: np.ndarray,
    feats: np.ndarray,
    seed: int | Sequence[int] = 5,
    epochs: int = EPOCHS,
    net: Net | None = None,
    rare: np.ndarray | None = None,
    share: float | None = None,
    steps: Sequence[float] | None = None,
) -> Net:
    """Adam on the logistic loss, classes weighed alike; a step moves the buckets it has a gradient for. Buckets seen in fewer than three texts are left out, since
    they could only serve to learn texts by heart.

    For a shard of the texts, ``net`` is where to go on from, ``rare`` and ``share`` (of label 1) are those of all
    texts, and ``steps`` are the rates of the passes.
    """
    net, r = net or Net(seed), np.random.default_rng(seed)
    rare = seen_in(texts, feats) < LEAST_TEXTS if rare is None else rare
    feats = np.where(rare[feats], 0, feats)
    net.emb[rare] = 0
    share = labels.mean() if share is None else share
    weigh = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step, n_maps = 0, len(WIDTHS) * FILTERS
    for rate in rates(epochs) if steps is None else steps:
        order = r.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids, real, begins = laid_out([texts[i] for i in rows])
            words, ids = np.unique(ids, return_inverse=True)
            f = feats[words]
            e = net.emb[f].sum(axis=1)
            maps = net.maps(e @ net.conv, ids, real)
            top = np.maximum.reduceat(maps, begins, axis=0)
            p = 1 / (1 + np.exp(-(top @ net.out + net.base)))
            g = ((p - labels[rows]) * weigh[rows] / len(rows)).astype(np.float32)
            d_top = g[:, None] * net.out * (top > 0)
            # the place of each maximum, the first of equals
            doc = np.repeat(np.arange(len(rows)), np.diff(np.append(begins, len(ids))))
            pos, col = np.nonzero((maps == top[doc]) & (maps > 0))
            cell, first = np.unique(doc[pos] * n_maps + col, return_index=True)
            pos, col, doc = pos[first], col[first], cell // n_maps
            back = d_top[doc, col]
            d_slots, slot_at = np.zeros((len(words), SLOTS), np.float32), 0
            for k, w in enumerate(WIDTHS):
                own = col // FILTERS == k
                for j in range(w):
                    np.add.at(d_slots, (ids[np.minimum(pos[own] + j, len(ids) - 1)], slot_at + j * FILTERS + col[own] % FILTERS), back[own])
                slot_at += w * FILTERS
            used = np.flatnonzero(d_slots.any(axis=1))
            moved, place = np.unique(f[used], return_inverse=True)
            d_emb = np.zeros((len(moved), DIM), np.float32)
            np.add.at(d_emb, place.ravel(), np.repeat(d_slots[used] @ net.conv.T, _FEATURES, axis=0))
            d_emb[moved == 0] = 0
            grads = [d_emb, e.T @ d_slots, np.bincount(col, back, n_maps).astype(np.float32), (top * g[:, None]).sum(axis=0), g.sum(keepdims=True)]
            step += 1
            for q, d, (m, v), own in zip(net.parts(), grads, moments, (moved, *[slice(None)] * 4)):
                m[own] = first = 0.9 * m[own] + 0.1 * d
                v[own] = second = 0.999 * v[own] + 0.001 * (d * d)
                q[own] -= (rate / (1 - 0.9**step)) * first / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            np.maximum(net.out, 0.01, out=net.out)
    return net


class Scorer:
    """Scores texts in a worker; remembers words, up to a bound."""

    def __init__(self, net: Net):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.words, self.slots = Words(), np.empty((0, SLOTS), np.float32)

    def logits(self, texts: Iterator[str | None]) -> np.ndarray:
        out, held, size = [np.empty(0)], [], 0
        for text in texts:
            held.append(self.words.of(text))
            size += len(held[-1])
            if size > 50_000:
                out.append(self._run(held))
                held, size = [], 0
        if held:
            out.append(self._run(held))
        return np.concatenate(out)

    def _run(self, texts: list[np.ndarray]) -> np.ndarray:
        self.slots = np.concatenate((self.slots, self.net.slots(self.words.fetched())))
        out = self.net.logits(self.slots, texts)
        if len(self.slots) > REMEMBERED:
            self.clear()
        return out


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the best F1 of label 1; halfway to the score below."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + max(labels.sum(), 1))
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f1))
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1e-6)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: crc32 of the id as text divides by 5; a null id is one."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, seed: int, positives: int, negatives: int, characters: int):
    """Fewer rows for the fit, for callers who ask for that: those with the lowest hash of the id, as long as their
    texts fit into ``characters``. The query takes all rows.

    An id with several labels is toxic if one says so; of several texts with one id the first in their order counts.
    Ids and lengths of at most ``positives + negatives`` rows come to the driver first, so it never holds more text.
    """
    known = _known(labels)
    order = F.xxhash64(F.lit(seed), "doc_id")
    some = [known.where(f"toxic = {k}").orderBy(order, "doc_id").limit(n) for k, n in ((1, positives), (0, negatives))]
    ids = docs.sparkSession.createDataFrame(some[0].unionByName(some[1]).collect(), "doc_id long, toxic int")
    own = docs.join(F.broadcast(ids), "doc_id")
    lengths = own.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(order, "doc_id").collect()
    kept, left = [], characters
    for r in lengths:
        if r.n <= left:
            kept.append((r.doc_id,))
            left -= r.n
    kept = docs.sparkSession.createDataFrame(kept, "doc_id long")
    texts = own.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    return texts.select("doc_id", "toxic", "t.text", "t.lang").orderBy("doc_id").toArrow()


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): an id with several labels is toxic if one says so."""
    return labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


_PACKED = "shard int, toxic binary, learn binary, cut binary, langs array<string>, lengths binary, ids binary, feats binary, seen binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shard from rows (shard, toxic, learn, cut, lang, text) in order of shards: words by number, the
    buckets of each word, and in how many texts to learn from a bucket is, as far as that matters."""
    lean()
    schema = pa.schema([(c, pa.int32() if c == "shard" else pa.list_(pa.string()) if c == "langs" else pa.binary()) for c in (x.split()[0] for x in _PACKED.split(", "))])

    def packed() -> pa.RecordBatch:
        feats, learn = words.fetched(), np.array([r[1] for r in rows], bool)
        seen = np.minimum(seen_in([t for t, k in zip(texts, learn) if k], feats), LEAST_TEXTS)
        arrays = (
            np.array([r[0] for r in rows], np.int8), learn, np.array([r[2] for r in rows], bool),
            np.array([len(t) for t in texts], np.int32), np.concatenate(texts), feats.astype(np.uint16), seen.astype(np.uint8),
        )
        b = [a.tobytes() for a in arrays]
        return pa.record_batch([[v] for v in (shard, *b[:3], [r[3] for r in rows], *b[3:])], schema=schema)

    shard = None
    for batch in batches:
        text = batch.column(5)
        for i, (k, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
            if k != shard:
                if shard is not None:
                    yield packed()
                shard, rows, texts, words = k, [], [], Words()
            rows.append(row)
            texts.append(words.of(text[i].as_py()).astype(np.int32))
    if shard is not None:
        yield packed()
    trim()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, texts, feats, toxic, learn, cut, langs) of each row of ``_pack``."""
    kinds = {"toxic": np.int8, "learn": bool, "cut": bool, "lengths": np.int32, "ids": np.int32, "feats": np.uint16}
    for batch in batches:
        for i in range(batch.num_rows):
            c = {k: np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in kinds.items()}
            texts = np.split(c["ids"], np.cumsum(c["lengths"])[:-1])
            yield batch.column("shard")[i].as_py(), texts, c["feats"].reshape(-1, _FEATURES).astype(np.int64), c["toxic"], c["learn"], c["cut"], batch.column("langs")[i].as_py()


_PARTS = "slice int, shard int, part binary"


def _parts(shard: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(len(arrays)), pa.int32()), pa.array([shard] * len(arrays), pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())], ["slice", "shard", "part"])


def _sliced_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, seen in zip(*(c.to_pylist() for c in batch.columns)):
            yield _parts(shard, np.split(np.frombuffer(seen, np.uint8), SLICES))


def _sum_seen(parts: list[bytes], k: int) -> bytes:
    return sum(np.frombuffer(p, np.uint8).astype(np.int64) for p in parts).tobytes()


def _mean_change(parts: list[bytes], k: int) -> bytes:
    """A bucket's change is the mean over the shards that changed it, that of the other layers the mean over all."""
    total, n = 0.0, 0
    for p in parts:
        d = np.frombuffer(p, np.float32).reshape(-1, DIM if k < SLICES else 1).astype(float)
        total, n = total + d, n + ((d != 0).any(axis=1, keepdims=True) if k < SLICES else 1)
    return (total / np.maximum(n, 1)).tobytes()


def _gathered(parts: DataFrame, combine: Callable[[list[bytes], int], bytes]) -> list[bytes]:
    """The slices of all shards, combined on the executors in order of shards: what the driver gets has the size of one."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        k = table.column("slice")[0].as_py()
        return pa.table({"slice": pa.array([k], pa.int32()), "part": pa.array([combine(table.column("part").to_pylist(), k)], pa.binary())})

    got = parts.groupBy("slice").applyInArrow(one, "slice int, part binary").collect()
    return [r.part for r in sorted(got, key=lambda r: r.slice)]


def _changes(model) -> Callable:
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        net, rare, share, seed, steps = model.value
        for shard, texts, feats, y, learn, _, _ in _unpacked(batches):
            own = fit([t for t, k in zip(texts, learn) if k], y[learn], feats, [*seed, shard], net=copy.deepcopy(net), rare=rare, share=share, steps=steps)
            rest = np.concatenate([(a - b).ravel() for a, b in zip(own.parts()[1:], net.parts()[1:])])
            yield _parts(shard, [*np.split(own.emb - net.emb, SLICES), rest])
        trim()

    return change


def _fit_all(shards: DataFrame, n_shards: int, share: float, seed: int) -> Net:
    """The net fitted on every row of ``shards`` (see ``_pack``).

    One shard is passed over ``EPOCHS`` times by one task. Several are fitted at once, each from the same net, and the
    net goes on by the mean of their changes, ``ROUNDS`` times over all.
    """
    spark, net = shards.sparkSession, Net(seed)
    rare = np.concatenate([np.frombuffer(b, np.int64) for b in _gathered(shards.select("shard", "seen").mapInArrow(_sliced_seen, _PARTS), _sum_seen)]) < LEAST_TEXTS
    net.emb[rare] = 0
    for k, steps in enumerate([rates(EPOCHS)] if n_shards == 1 else [[x] for x in rates(ROUNDS)]):
        model = spark.sparkContext.broadcast((net, rare, share, (seed, k), steps))
        got = _gathered(shards.mapInArrow(_changes(model), _PARTS), _mean_change)
        change, net = [np.frombuffer(b) for b in got], copy.deepcopy(net)
        net.emb += np.concatenate(change[:-1]).reshape(net.emb.shape).astype(np.float32)
        at = 0
        for p in net.parts()[1:]:
            p += change[-1][at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        model.unpersist()
    return net


def _logits_of_cut(model) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for _, texts, feats, y, _, cut, langs in _unpacked(batches):
            slots = np.concatenate([net.slots(f) for f in np.array_split(feats, -(-len(feats) // 50_000))])
            own = np.flatnonzero(cut)
            ends = np.cumsum([len(texts[i]) for i in own]) // 50_000
            for rows in np.split(own, np.flatnonzero(np.diff(ends)) + 1):
                if len(rows):
                    z = net.logits(slots, [texts[i] for i in rows])
                    yield pa.record_batch([pa.array([langs[i] or "" for i in rows], pa.string()), pa.array(y[rows], pa.int32()), pa.array(z, pa.float64())], ["lang", "toxic", "z"])

    return score


def best_cuts(scores: DataFrame, group: str) -> dict[str, float]:
    """``best_cut`` of each value of ``group`` over all rows of ``scores`` (``group``, toxic, z), on the executors.

    Equal scores are one row; prefix sums go by stretches of the scores, so no group is one task.
    """
    t = scores.groupBy(group, "z").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    t = t.withColumn("__at", F.floor(F.col("z") * 16))
    # the sums of a stretch: how many rows lie above it and how many of the group are toxic
    above = Window.partitionBy(group).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    parts = t.groupBy(group, "__at").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    parts = parts.select(group, "__at", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"__{c}") for c in ("n", "hits")], F.sum("hits").over(Window.partitionBy(group)).alias("__all"))
    upto = Window.partitionBy(group, "__at").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.sum("hits").over(upto) + F.col("__hits")) / (F.sum("n").over(upto) + F.col("__n") + F.greatest(F.col("__all"), F.lit(1)))
    best = t.join(parts.select(group, "__at", "__n", "__hits", "__all"), [group, "__at"]).select(group, "z", f1.alias("f1"))
    best = best.groupBy(group).agg(F.max(F.struct("f1", "z")).alias("b")).select(group, F.col("b.z").alias("__best"))
    below = t.join(F.broadcast(best), group).groupBy(group, "__best").agg(F.max(F.when(F.col("z") < F.col("__best"), F.col("z"))).alias("next"))
    return {r[group]: (r["__best"] + r["next"]) / 2 if r["next"] is not None else r["__best"] - 1e-6 for r in below.collect()}


def train(
    docs: DataFrame, labels: DataFrame, seed: int = 5, shard_rows: int = SHARD_ROWS, shard_characters: int = SHARD_CHARACTERS, sample: tuple[int, int, int] | None = None
) -> tuple[Net, float, float, dict[str, float]]:
    """(net, cut, share of label 1, cut by language) from all labelled rows.

    ``docs``: doc_id, text, lang; ``labels``: doc_id, toxic, without held-out rows. Of several texts with one id the
    first in their order counts. A fifth of the ids, by a hash, sets the cuts: one over all, at which a score is 0.5,
    and one per language that has 20 rows of either label in that fifth. The others are what the net is fitted on, in
    shards by a hash of the id (see ``_fit_all``): as many as their rows and characters need, whatever the cluster, so
    reruns agree. The language serves for its cut only, never for a score. ``sample``: (positives, negatives,
    characters) of the rows to learn from, where a caller wants fewer, see ``_sample``; None takes all.
    """
    spark = docs.sparkSession
    if sample:
        docs = spark.createDataFrame(_sample(docs, labels, seed, *sample)).select("doc_id", "text", "lang")
    known = small_side(_known(labels))
    part = lambda name, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("doc_id")), F.lit(n)).cast("int")
    # lengths alone go through this join
    ids = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("characters")).join(known, "doc_id")
    ids = ids.groupBy("doc_id", "toxic").agg(F.sum("characters").alias("characters")).withColumn("fifth", part("cut", 5) == 0)
    counts = ids.groupBy("fifth", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("characters").alias("characters")).collect()
    total, toxic = sum(r.n for r in counts), sum(r.n for r in counts if r.toxic)
    if not 0 < toxic < total:
        # nothing to learn from: every score is the share of label 1
        net = Net(seed)
        net.out[:] = 0
        share = float(toxic > 0)
        return net, 20.0 - 40.0 * share, share, {}
    # both labels in both parts, or all rows in either part
    apart = len(counts) == 4
    to_learn = {r.toxic: r.n for r in counts if not r.fifth} if apart else {1: toxic, 0: total - toxic}
    n_shards = max(1, -(-total // shard_rows), -(-sum(r.characters for r in counts) // shard_characters))
    rows = docs.join(known, "doc_id").withColumn("fifth", part("cut", 5) == 0)
    rows = rows.withColumns({"shard": part("shard", n_shards), "learn": ~F.col("fifth") | F.lit(not apart), "cut": F.col("fifth") | F.lit(not apart)})
    first = Window.partitionBy("shard", "doc_id").orderBy("text", "lang")
    rows = rows.repartition(4 * n_shards, "shard").withColumn("__first", F.row_number().over(first)).where("__first = 1")
    with small_batches(spark, 256):
        shards = written(rows.select("shard", "toxic", "learn", "cut", "lang", "text").mapInArrow(_pack, _PACKED), "shards")
    with small_batches(spark, 1):
        net = _fit_all(shards, n_shards, to_learn[1] / sum(to_learn.values()), seed)
        scores = written(shards.mapInArrow(_logits_of_cut(spark.sparkContext.broadcast(net)), "lang string, toxic int, z double"), "cuts").where("not isnan(z)")
    cut = best_cuts(scores.withColumn("every", F.lit("")), "every").get("", 0.0)
    enough = scores.groupBy("lang").agg(F.sum("toxic").alias("n"), F.count(F.lit(1)).alias("of")).where("n >= 20 and of - n >= 20").select("lang")
    by = best_cuts(scores.join(enough, "lang"), "lang")
    drop(shards)
    return net, cut, toxic / total, by


_scorers: dict = {}


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, net, cut, share = model.value
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(net)
        for batch in batches:
            z = _scorers[mark].logits(t.as_py() for t in batch.column(1)) - cut
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(np.where(np.isnan(z), share, 1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.float64())], ["doc_id", "lang", "score"])

    return score


def toxic_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang, lang_threshold, flagged) for each row of ``docs``.

    The classifier is fitted on all labelled rows that are not held out, on the executors, see ``train``; scoring reads
    each whole text once, however long, and shuffles nothing. ``score`` depends on the text alone; ``predicted``
    is 1 from 0.5 on; ``flagged`` uses the threshold calibrated for the row's language (0.5 where a language has none,
    null too), from the threshold on.

    Null and empty texts and others without words score the share of label 1 in the rows of the fit. A row with a null
    id counts as held out. Repeated rows are scored alike. Without labels of both kinds all rows score near 0 (or near
    1 if all known are toxic). An empty table gives an empty result; columns of other names are ignored. Reruns agree.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    net, cut, share, by = train(base, labels.where(~held_out(F.col("doc_id"))), seed, **params)
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, net, cut, share))
    out = base.mapInArrow(_scored(model), "doc_id long, lang string, score double")
    threshold = F.lit(0.5)
    for lang, c in sorted(by.items()):
        threshold = F.when(F.coalesce("lang", F.lit("")) == lang, float(1 / (1 + np.exp(cut - c)))).otherwise(threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang", threshold.alias("lang_threshold"), (F.col("score") >= threshold).alias("flagged"))


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the threshold of each one's language and whether it is flagged by that; see ``toxic_scores``."""
    return toxic_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
