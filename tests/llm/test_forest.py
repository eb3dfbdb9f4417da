import numpy as np
import pytest

from cairn.llm import forest

from .test_components import roots


def brute(rows, cosine=0.9):
    links, counts = [], {i: 0 for i, _ in rows}
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    for a in range(len(ok)):
        for b in range(a):
            (i, x), (j, y) = ok[a], ok[b]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((i, j))
                counts[i] += 1
                counts[j] += 1
    up = roots(links)
    return {i: (counts[i], up.get(i, i)) for i, _ in rows}, len(links)


def vectors(seed=3, dim=16):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dim) for _ in range(300)]
    for k in range(30):  # groups around a centre
        centre = r.normal(size=dim)
        rows += [centre + r.normal(size=dim) * s for s in r.uniform(0.05, 0.5, 12)]
    dense = r.normal(size=dim)
    rows += [dense + 0.1 * r.normal(size=dim) for _ in range(250)]
    rows += [rows[0]] * 100
    out = [(int(i), np.float32(v).tolist()) for i, v in zip(r.permutation(len(rows)) + 10, rows)]
    return out + [(1, None), (2, [0.0] * dim), (3, [float("nan")] * dim), (4, [None] + [1.0] * (dim - 1)), (5, [float("inf")] * dim), (6, []), (7, [1.0, 2.0]), (8, [2.0, 4.0])]


@pytest.fixture(scope="module")
def rows():
    return vectors()


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, i) for i, v in rows], "vec_id long, embedding array<float>, label int, rep long")


def test_recall_against_brute_force(spark, rows, monkeypatch):
    want, n = brute(rows)
    for block in (2000, 40):
        monkeypatch.setattr(forest, "BLOCK", block)
        got = {r.vec_id: r for r in forest.near_vectors(table(spark, rows), leaf=60).collect()}
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got.values()) / 2
        assert 0.95 * n <= found <= n
        assert all(got[i].n_links <= want[i][0] for i in got)
        assert np.mean([got[i].component_id == want[i][1] for i in got]) >= 0.99
        for i in range(1, 7):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[8].n_links == 1 and got[8].component_id == 7 and not got[8].kept


def test_one_leaf_is_exact(spark, rows):
    want, _ = brute(rows)
    got = forest.near_vectors(table(spark, rows), leaf=5000).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_empty_and_repeated(spark):
    assert forest.near_vectors(table(spark, [])).count() == 0
    got = forest.near_vectors(table(spark, [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (5, 1, True), (5, 1, True)]


def test_depth_beyond_the_sample():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 8))
    t = forest.Tree(x[:200], 6, 0.05, 1)
    row, leaf = t.leaves(x)
    assert len(np.unique(leaf)) > 40 and set(row) == set(range(4000)) and np.bincount(leaf).max() < 400


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.1e200, 1e200]), (3, [1e-200, 1e-200]), (4, [1.0, 0.2]), (5, [0.2, 1.0]), (6, [-1e300, 1e300]), (7, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (0, 5), 6: (0, 6), 7: (1, 4)}


def test_every_level_spills():
    r = np.random.default_rng(2)
    x = r.normal(size=(6000, 32))
    t = forest.Tree(x[:100], 7, 0.1, 3)
    row, leaf = t.leaves(x)
    assert len(t.cuts) < 7 and len(row) > 6000 * 1.08**7 and len(np.unique(np.stack((row, leaf)), axis=1).T) == len(row)
