"""Embedding near-duplicates by a forest of random-projection trees with spill overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, written
from .components import connected

COSINE = 0.9
TREES, LEAF, SPILL = 12, 800, 0.1
#: Rows that the trees' thresholds are fitted on, at most; every row is indexed.
SAMPLE = 8192
#: A leaf of more rows is compared in blocks of this many, a pair of blocks per task.
BLOCK = 2000


class Tree:
    """Random directions, one per level, and a threshold with a spill margin per node.

    A node with at least 16 sample rows is split at their median; rows within the margin, which holds ``spill`` of
    the sample, go both ways. Deeper nodes are split at their nearest fitted ancestor's mean, with its margin, so every
    level spills and the depth may grow with the table while the model stays as small as the sample.
    """

    def __init__(self, sample: np.ndarray, depth: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :depth] if depth <= dim else rng.normal(size=(dim, depth))
        at = sample @ self.axes
        self.cuts: list[tuple[np.ndarray, np.ndarray]] = []
        nodes = [np.arange(len(sample))]
        means, margins = [at.mean(axis=0) if len(at) else np.zeros(depth)], [0.0]
        for level in range(depth):
            cut, margin, below, below_means, below_margins = np.empty(len(nodes)), np.array(margins), [], [], []
            fitted = False
            for k, (rows, mean) in enumerate(zip(nodes, means)):
                x = at[rows, level]
                if len(rows) >= 16:
                    fitted = True
                    mean = at[rows].mean(axis=0)
                    cut[k] = np.median(x)
                    margin[k] = np.quantile(np.abs(x - cut[k]), spill)
                else:
                    cut[k] = mean[level]
                below += [rows[x < cut[k]], rows[x >= cut[k]]]
                below_means += [mean, mean]
                below_margins += [margin[k], margin[k]]
            if not fitted:
                break
            self.cuts.append((cut, margin))
            nodes, means, margins = below, below_means, below_margins
        self.means, self.margins = np.array(means), np.array(margins)
        self.depth = depth

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that each row of ``x`` is in."""
        at = x @ self.axes
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.depth):
            if level == len(self.cuts):
                anchor = node.copy()
            if level < len(self.cuts):
                cut, margin = (x[node] for x in self.cuts[level])
            else:
                cut, margin = self.means[anchor, level], self.margins[anchor]
            d = at[row, level] - cut
            near = np.abs(d) <= margin
            right = d >= 0
            row, node = np.concatenate((row, row[near])), np.concatenate((2 * node + right, 2 * node[near] + ~right[near]))
            if level >= len(self.cuts):
                anchor = np.concatenate((anchor, anchor[near]))
        return row, node


def _unit(batch_col: pa.Array, dim: int) -> np.ndarray:
    x = batch_col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(trees, dim: int):
    """Rows to their leaves; each carries the codes of all its leaves, so that a pair counts in its first one only."""
    model = trees

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2), dim)
            rows, codes = [], []
            for t, tree in enumerate(model.value):
                r, leaf = tree.leaves(x)
                rows.append(r)
                codes.append((np.int64(t) << np.int64(50)) + leaf)
            row, code = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            ends = np.searchsorted(row, np.arange(len(x) + 1))
            of_row = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code))
            at = pa.array(row)
            yield pa.record_batch([pa.array(code), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), of_row.take(at)], ["leaf", "rep", "copies", "v", "leaves"])

    return route


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, over links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(dim: int, cosine: float):
    """Links within a group (leaf, block pair): partial link counts per row, and a spanning set of edges."""

    def compare(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        col = lambda k: g.column(k).combine_chunks() if isinstance(g.column(k), pa.ChunkedArray) else g.column(k)
        leaf, lo, hi = g.column("leaf")[0].as_py(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
        block = col("block").to_numpy()
        rep, copies = col("rep").to_numpy(), col("copies").to_numpy()
        x = _unit(col("v"), dim)
        lists = col("leaves")
        lens = lists.value_lengths().to_numpy(zero_copy_only=False)
        codes = np.full((len(rep), lens.max()), -1, np.int64)
        codes[np.arange(codes.shape[1]) < lens[:, None]] = lists.flatten().to_numpy()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        found_i, found_j = [], []
        for s in range(0, len(left), 500):
            part = left[s : s + 500]
            i, j = np.nonzero(x[part] @ x[right].T >= cosine - 1e-9)
            i, j = part[i], right[j]
            keep = rep[i] < rep[j] if lo == hi else rep[i] != rep[j]
            i, j = i[keep], j[keep]
            for p in range(0, len(i), 20_000):
                a, b = i[p : p + 20_000], j[p : p + 20_000]
                # exactly as two vectors alone would give it, whatever the block
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[ok], b[ok]
                first = np.full(len(a), np.iinfo(np.int64).max)
                for k in range(codes.shape[1]):
                    mine = codes[a, k]
                    shared = (codes[b] == mine[:, None]).any(axis=1) & (mine >= 0)
                    first = np.where(shared, np.minimum(first, mine), first)
                ok = first == leaf
                found_i.append(a[ok])
                found_j.append(b[ok])
        i, j = (np.concatenate(x) if x else np.empty(0, int) for x in (found_i, found_j))
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        # components by the smallest rep: number rows in order of rep
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), int)
        place[order] = np.arange(len(rep))
        root = rep[order[_roots(len(rep), place[i], place[j])[place]]]
        has = links > 0
        return pa.table({"rep": rep[has], "links": links[has].astype(np.int64), "root": root[has]})

    return compare


def near_vectors(
    table: DataFrame,
    cosine: float = COSINE,
    trees: int = TREES,
    leaf: int = LEAF,
    spill: float = SPILL,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    seed: int = 7,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    1. Equal vectors are one row with a count (partial aggregation), whatever their number.
    2. A forest is fitted on at most ``sample`` of them, on the driver; its depth follows the table's size, so that
       leaves stay near ``leaf`` rows. Every vector is routed to its leaves, rows near a split to both sides.
    3. Within a leaf all rows are compared in double precision; a leaf that stays large is cut into blocks, and a
       task gets two of them. A pair in several leaves counts in the first. Out come counts per row and a spanning
       set of links, never the pairs.
    4. Components of those links.

    Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different
    lengths never link (one forest per length); components of any finite size count, as vectors are scaled by the
    largest first. Rows with a null id have a null component and are kept. Ids are taken as unique integers; repeated
    rows count as other vectors. An empty table gives an empty result; columns of other names are ignored, whatever
    those are. Recall against brute force is measured in the tests; no link below ``cosine`` is returned, one at it is.
    """
    base = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if "float" in dict(table.dtypes)[vec_col] else "array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists("v", lambda e: e != 0)
    fit = base.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())
    reps = written(fit.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    spark, partials, kind = table.sparkSession, None, dict(reps.dtypes)["v"]
    lengths = [r[0] for r in reps.select(F.size("v")).distinct().collect()]
    for dim in sorted(lengths):
        own = reps.where(F.size("v") == dim)
        total = own.count()
        some = own.orderBy(F.xxhash64(F.lit(seed), "rep"), "rep").limit(sample).select("v").toArrow()
        x = _unit(some.column(0).combine_chunks(), dim)
        depth = max(0, int(np.ceil(np.log2(total / leaf))))
        model = spark.sparkContext.broadcast([Tree(x, depth, spill, seed * 1000 + t) for t in range(trees)])
        rows = own.select("rep", "copies", "v").mapInArrow(_route(model, dim), f"leaf long, rep long, copies long, v {kind}, leaves array<long>")
        rows = written(rows, "leaves")
        blocks = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select("leaf", F.expr(f"cast((n + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks"))
        cut = rows.join(blocks, "leaf").withColumn("block", F.pmod(F.hash("rep"), F.col("blocks")))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi"))))
        grouped = cut.withColumn("p", pair).select("leaf", "p.lo", "p.hi", "block", "rep", "copies", "v", "leaves").groupBy("leaf", "lo", "hi")
        got = grouped.applyInArrow(_compare(dim, cosine), "rep long, links long, root long")
        got = written(got, "links")
        drop(rows)
        partials = got if partials is None else partials.unionByName(got)
    if partials is None:
        partials = spark.createDataFrame([], "rep long, links long, root long")
    comps = connected(partials.select("rep", "root"), "rep", "root").toDF("rep", "component")
    counts = partials.groupBy("rep").agg(F.sum("links").alias("links"))
    told = reps.join(counts, "rep", "left").join(comps, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    ok = fit.join(told, "v").select("vec_id", "links", "component")
    rest = base.where(~(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = ok.unionByName(rest)
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; see ``near_vectors`` for nulls, zero and non-finite vectors, ties, repeated rows and empty tables."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
ok AS MATERIALIZED (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(node, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.c FROM reach r JOIN p ON p.a = r.node WHERE r.c < p.b)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id)::BIGINT AS n_links, min(r.c) AS component_id, v.vec_id = min(r.c) AS kept
FROM v JOIN reach r ON r.node = v.vec_id GROUP BY v.vec_id
"""
