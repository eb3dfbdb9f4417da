"""MinHash near-duplicates by an LSH forest: sorted signature orders, longest-common-prefix neighbours, adaptive depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, lean, small_batches, small_side, trim, written
from .components import connected
from .shingles import HASHES, fingerprint, forget, shingle_set, signature, similar

TREES, FIRST, DEPTH, LEAST, REGION = 32, 3, 8, 3, 6
PERCENT = 75
#: Rows and shingles of a block of a dense group; a task compares two blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1_000_000
#: Ids of which this many may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 2_000_000

#: The order in which each tree sorts the signature: its first DEPTH places.
ORDERS = np.stack([np.random.default_rng(1000 + t).permutation(HASHES)[:DEPTH] for t in range(TREES)])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    for batch in batches:
        ids, n, fp, sig = batch.column(0), [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            fp.append(fingerprint(s) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fp", "sig"])
    forget()
    trim()


def _rows_of(trees: range):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                if not part.num_rows:
                    continue
                sigs = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u2").reshape(-1, HASHES)
                rep, comp = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                for t in trees:
                    keys = np.ascontiguousarray(sigs[:, ORDERS[t]]).tobytes()
                    key = pa.Array.from_buffers(pa.binary(2 * DEPTH), len(rep), [None, pa.py_buffer(keys)]).cast(pa.binary())
                    yield pa.record_batch([pa.array(np.full(len(rep), t, np.int32)), key, pa.array(rep), pa.array(comp)], ["tree", "key", "rep", "comp"])

    return rows


def neighbours(keys: np.ndarray, comp: np.ndarray, least: int = LEAST, region: int = REGION) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of candidates among rows sorted by key (n, 1 + depth), the tree first.

    A row and the next are candidates if they share ``least`` places: the neighbour with the longest common prefix.
    Rows further apart are if the region that shares their common prefix has at most ``region`` rows; in a denser
    one the prefix has to be longer, so the depth adapts to each region. Pairs of one component are left out.
    """
    n = len(keys)
    if n < 2:
        return np.empty(0, int), np.empty(0, int)
    same = np.cumprod(keys[1:] == keys[:-1], axis=1)
    shared = same.sum(axis=1) - 1  # -1: not the same tree
    depth = keys.shape[1] - 1
    # for each depth, the number of rows in the run around each row
    sizes = np.ones((depth + 1, n), np.int32)
    for d in range(least, depth + 1):
        starts = np.flatnonzero(np.concatenate(([True], shared < d)))
        lens = np.diff(np.append(starts, n))
        sizes[d] = np.repeat(lens, lens)
    left, right, low = [], [], shared.copy()
    for k in range(1, min(region, n)):
        if k > 1:
            low = np.minimum(low[:-1], shared[k - 1 :])
        i = np.flatnonzero(low >= least)
        if not len(i):
            break
        if k > 1:
            i = i[sizes[low[i], i] <= region]
        i = i[comp[i] != comp[i + k]]
        left.append(i)
        right.append(i + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in a sorted stream; the last rows of a batch are looked at again with the next."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH).astype(np.int32)
        now = (np.column_stack((tree, key)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False))
        if kept is not None:
            now = tuple(np.concatenate(x) for x in zip(kept, now))
        i, j = neighbours(now[0], now[2])
        kept = tuple(x[-REGION:] for x in now)
        if len(i):
            rep = now[1]
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            pairs = np.unique(np.column_stack((a, b)), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in half the places: at a similarity of 0.75 fewer do once in 200,000 pairs."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), ">u2").reshape(-1, HASHES) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= HASHES // 2))


def _verified(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(*(np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3)), percent) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return verify


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, set) of (rep, fp, text) where the text has that fingerprint: of rows that share an id only the one meant."""
    for batch in batches:
        sets = [shingle_set(text.as_py()) for text in batch.column(2)]
        own = pa.array([bool(len(s)) and fingerprint(s) == fp for s, fp in zip(sets, batch.column(1).to_pylist())], pa.bool_())
        yield pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set"]).filter(own)
    forget()
    trim()


def _sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set): the full shingle sets of some representatives."""
    wanted = small_side(written(reps.select("rep", "fp").join(small_side(ids, BROADCAST_IDS), "rep", "left_semi"), "wanted"), BROADCAST_IDS)
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(wanted, "rep")
    return texts.select("rep", "fp", "text").mapInArrow(_sets, "rep long, set binary")


def _links(docs: DataFrame, reps: DataFrame, trees: range, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Confirmed links (a, b) between representatives of different components, from the neighbours in ``trees``."""
    rows = reps.select("rep", "comp", "sig").mapInArrow(_rows_of(trees), "tree int, key binary, rep long, comp long")
    # ties of a key are split by rep: a region of a third of all rows is many tasks
    rows = rows.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    pairs = written(rows.mapInArrow(_candidates, "a long, b long").distinct(), "candidates")
    sigs = reps.select("rep", "sig")
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    good = written(both.mapInArrow(_promising, "a long, b long"), "promising")
    drop(pairs)
    ids = good.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    ids = written(ids, "ids")
    sets = written(_sets_of(docs, reps, ids, id_col, text_col), "sets")
    full = good.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = written(full.mapInArrow(_verified(percent), "a long, b long").distinct(), "links")
    drop(sets, good, ids)
    return links


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, rep, comp) for each tree: the tree and its first LEAST places as a number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u2").reshape(-1, HASHES).astype(np.int64)
        for t in range(TREES):
            region = np.full(len(sigs), t, np.int64)
            for place in ORDERS[t][:LEAST]:
                region = (region << 16) | sigs[:, place]
            yield pa.record_batch([pa.array(region), batch.column(0), batch.column(1)], ["region", "rep", "comp"])


def linked(comp: np.ndarray, side: np.ndarray | None, sigs: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Index pairs of links that join the components of a block, or of two blocks told by ``side``.

    Every pair of rows (of either side, if given) that no earlier link or ``comp`` joins is compared: signatures as in
    ``_promising``, then the full sets, by lists of the rows that hold each shingle. Rows whose places are those of
    the most rows come first, so an original is linked with its copies before the copies are compared.
    """
    n = len(comp)
    size = np.array([len(s) for s in sets])
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    held = row[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of))
    starts = np.concatenate(([0], ends[:-1]))
    parts = np.split(of, np.cumsum(size)[:-1])
    usual = np.zeros(n, np.int64)
    for place in range(HASHES):
        _, value, count = np.unique(sigs[:, place], return_inverse=True, return_counts=True)
        usual += count[value]
    at, left, out = comp.copy(), np.ones(n, bool), []
    for x in np.argsort(-usual, kind="stable"):
        left[x] = False
        others = left & (at != at[x])
        if side is not None:
            others &= side != side[x]
        y = np.flatnonzero(others)
        y = y[(sigs[y] == sigs[x]).sum(axis=1) >= HASHES // 2]
        if not len(y):
            continue
        common = np.bincount(np.concatenate([held[starts[s] : ends[s]] for s in parts[x]]), minlength=n)[y]
        for k in y[100 * common >= percent * (size[x] + size[y] - common)]:
            if at[k] != at[x]:
                at[at == at[k]] = at[x]
                out.append((x, k))
    return out


def _linked(percent: int):
    def link(block: pa.Table) -> pa.Table:
        rep, comp, side = (block.column(k).to_numpy() for k in ("rep", "comp", "block"))
        sigs = np.frombuffer(b"".join(block.column("sig").to_pylist()), ">u2").reshape(-1, HASHES).astype(np.uint16)
        sets = [np.frombuffer(s, np.uint64) for s in block.column("set").to_pylist()]
        pairs = linked(comp, side if block.column("i")[0] != block.column("j")[0] else None, sigs, sets, percent)
        pairs = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table([pa.array(rep[pairs[:, 0]]), pa.array(rep[pairs[:, 1]])], ["a", "b"])

    return link


def _dense(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of components (``reps`` has rep, comp, sig) from regions in which ``neighbours`` compares few rows.

    A region is a tree's rows that share LEAST places; one with more than REGION rows of several components is dense.
    Components that meet in dense regions form a group, whose rows of such regions are compared completely: they are
    dealt to blocks, and each pair of blocks is a task.
    """
    every = reps.select("rep", "comp", "sig").mapInArrow(_regions, "region long, rep long, comp long")
    found = every.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    found = written(found.where((F.col("n") > REGION) & (F.col("low") < F.col("high"))).select("region", "low"), "dense")
    rows = written(every.join(small_side(found), "region").select("rep", "comp", "low").distinct(), "members")
    groups = written(connected(rows.select("comp", "low").distinct(), "comp", "low").toDF("comp", "group"), "groups")
    rows = written(rows.select("rep", "comp").distinct().join(small_side(groups), "comp"), "members")
    sets = _sets_of(docs, reps, rows.select("rep"), "doc_id", "text").groupBy("rep").agg(F.first("set").alias("set"))
    rows = written(rows.join(reps.select("rep", "sig"), "rep").join(sets, "rep"), "sets")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.length("set")) / (8 * BLOCK_SHINGLES)))
    counts = rows.groupBy("group").agg(blocks.cast("int").alias("blocks"))
    dealt = rows.join(small_side(counts), "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", "sig", "set")
    links = written(dealt.groupBy("group", "i", "j").applyInArrow(_linked(percent), "a long, b long"), "links")
    drop(found, groups, rows)
    return links


def _joined(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` with the components that ``links`` between representatives join."""
    comps = reps.select("rep", "comp")
    lift = links.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b")
    roots = connected(lift.select("ca", "cb"), "ca", "cb").toDF("comp", "root")
    return reps.join(roots, "comp", "left").select("fp", "rep", F.coalesce("root", "comp").alias("comp"), "sig")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``, by the forest named above.

    1. One pass over the whole texts gives each its set size, a 128-bit fingerprint of the set and 64 minima.
       Rows with equal sets share a representative (the smallest id), found by partial aggregation, so that copies
       cost a row each and no pair.
    2. Each tree sorts all representatives by 8 of the minima in an order of its own (a range sort, in which equal
       keys are split by id) and takes neighbours with the longest common prefix, see ``neighbours``. The first
       three trees run alone; what they link is one component, and the other 29 trees only compare rows of
       different components, so a group of thousands gives a few pairs a row rather than all pairs.
    3. Candidates whose signatures agree are confirmed on full shingle sets made from the whole texts.
    4. Where more rows share 3 places than the neighbours cover, and several components are left among them, all
       rows of different components are compared, see ``_dense``.
    5. Components of the confirmed links; ``kept`` marks the smallest id of each.

    The candidate search is probabilistic: a pair at the limit, alone in its region, shares 3 places in one tree of
    32 at least with a chance of over 0.999; neighbours that fall on two range partitions miss each other in that
    tree only, unless their region is dense. Every link returned is exact.

    Null and empty texts have 0 shingles and link with nothing; texts of any length count whole. Rows with a null id
    are kept, with a null component. Rows that repeat an id are judged each by its own text: their sets have
    representatives of their own, and a set is confirmed on the text that has its fingerprint. Of equal sets the smallest
    id stands for all. Ids are integers. Empty tables give an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        every, final = _components(base, percent)
    out = every.drop("sig").join(final, "fp", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components(base: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures (doc_id, n_shingles, fp, sig) of all rows, and the root of each set (fp, root)."""
    every = written(base.mapInArrow(_signatures, "doc_id long, n_shingles long, fp binary, sig binary"), "signatures")
    heads = every.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    reps = written(heads.select("fp", F.col("m.doc_id").alias("rep"), F.col("m.doc_id").alias("comp"), F.col("m.sig").alias("sig")), "reps")
    first = _links(base, reps, range(FIRST), percent, "doc_id", "text")
    joined = written(connected(first), "joined")
    now = reps.drop("comp").join(joined.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    now = written(now.select("fp", "rep", "comp", "sig"), "reps")
    drop(reps, first, joined)
    rest = _links(base, now, range(FIRST, TREES), percent, "doc_id", "text")
    # links of the first trees stand for their whole component; the later ones join components
    more = written(_joined(now, rest), "reps")
    drop(now, rest)
    dense = _dense(base, more, percent)
    final = written(_joined(more, dense).select("fp", F.col("comp").alias("root")), "roots")
    drop(more, dense)
    return every, final


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; see ``near_duplicates`` for nulls, empty and very long texts, ties, repeated rows and empty tables."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over all pairs that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(a.n) + min(b.n) - count(*))),
reach(node, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.b, r.c FROM reach r JOIN p ON p.a = r.node WHERE r.c < p.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, s.s
"""
