import random

import numpy as np
import pytest

from cairn.llm import minhash
from cairn.llm.shingles import shingle_set, signature, similar

from .test_components import roots


def words(text):
    out = []
    for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            out.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    return out


def shingles(text):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    links = set()
    for ks in where.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in links:
                    s, t = sets[a][1], sets[b][1]
                    n = len(s & t)
                    if 100 * n >= 75 * (len(s) + len(t) - n):
                        links.add((a, b))
    up = roots([(sets[a][0], sets[b][0]) for a, b in links])
    return {i: (len(s), up.get(i, i)) for i, s in sets}


def fixture(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def near(base, rate):
        return [rng.choice(vocabulary) if rng.random() < rate else w for w in base]

    texts = [text(rng.randint(1, 200)) for _ in range(150)]
    for _ in range(40):  # pairs at every similarity
        base = text(rng.randint(20, 300))
        texts += [base, near(base, rng.uniform(0, 0.06))]
    boiler = text(120)  # a long passage that many texts share, not enough to link them all
    texts += [boiler + text(rng.randint(5, 200)) for _ in range(120)]
    dense = text(300)  # a large group of near copies
    texts += [near(dense, 0.015) for _ in range(250)]
    texts += [texts[3]] * 60 + [t[:4] for t in texts[:5]]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    return [(i, rng.choice([" ", "\n", "  \t"]).join(t)) for i, t in zip(ids, texts)] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "ABC DEF"), (9005, "abc def"), (9006, "abc\xa0def")]


def test_components_equal_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, comp int").repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    want = brute(rows)
    assert {i: r.n_shingles for i, r in got.items()} == {i: n for i, (n, _) in want.items()}
    wrong = [i for i in want if got[i].component_id != want[i][1]]
    assert len(wrong) <= 0.01 * len(want), wrong
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    for i in (9001, 9002, 9003, 9006):
        assert got[i].component_id == i
    assert got[9005].component_id == 9004


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (2, "A B C D E F"), (7, "w " * 200_000)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (7, 1, 7, True)], key=str)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_rows_that_share_an_id(spark):
    """Each is judged by its own text: a set of one is never confirmed on the other's."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "x " * 9), (5, base), (5, "other words that are not in the base text at all"), (7, base + " more"), (9, "other words that are not in the base text at all")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (5, 7, 5), (5, 56, 5), (7, 57, 5), (9, 7, 5)]


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e", "A b C d e f A b C d e f", "é\xa0x \x0b y\x0cz\rq"])
def test_sets(text):
    assert len(shingle_set(text)) == len(shingles(text))


def test_similar_is_exact():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ({rng.randrange(40) for _ in range(rng.randint(0, 40))} for _ in range(2))
        want = bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
        assert similar(np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)) == want


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40_000, dtype=np.uint64)
    same = (signature(np.unique(base)) == signature(np.unique(base[:30_000]))).mean()
    assert 0.5 < same < 0.95


def test_neighbours_adapt_to_density():
    keys = np.array([[0, 1, 1, 1, i // 4, i] + [i] * 3 for i in range(40)] + [[0, 2, 2, 2, 9, 9, 9, 9, 9], [0, 2, 2, 2, 9, 9, 9, 9, 9], [1, 2, 2, 2, 9, 9, 9, 9, 9]])
    i, j = minhash.neighbours(keys, np.arange(len(keys)))
    pairs = set(zip(i.tolist(), j.tolist()))
    assert {(k, k + 1) for k in range(39)} <= pairs  # every next neighbour
    assert (0, 3) in pairs and (2, 4) not in pairs  # further only in small regions
    assert (40, 41) in pairs and (41, 42) not in pairs
    assert not len(minhash.neighbours(keys, np.zeros(len(keys)))[0])


def test_copies_of_one_original_that_do_not_link_to_each_other(spark):
    """Thousands of copies, each edited on its own, against all pairs by a matrix product."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    texts = [base] + [[word() if rng.random() < 0.02 else w for w in base] for _ in range(3000)]
    ids = list(range(1, len(texts) + 1))
    rng.shuffle(ids)
    sets = [shingles(" ".join(t)) for t in texts]
    seen = {s: k for k, s in enumerate(sorted(sets[0]))}
    held = np.zeros((len(sets), len(seen)), np.float32)
    for i, s in enumerate(sets):
        held[i, [seen[x] for x in s if x in seen]] = 1
    size = np.array([len(s) for s in sets])
    common = held @ held.T  # words that two copies got alike are too rare to count
    a, b = np.nonzero(100 * common >= 75 * (size[:, None] + size[None, :] - common))
    up = roots([(ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist()) if x < y])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    wrong = [i for i in ids if got[i] != up.get(i, i)]
    assert len(up) > 2000 and not wrong, (len(wrong), len(up))


@pytest.mark.parametrize("sides", [False, True])
def test_blocks_are_compared_completely(sides):
    rows = [(i, t) for i, t in fixture(2) if shingles(t)]
    sets = [shingle_set(t) for _, t in rows]
    n = len(sets)
    side = np.arange(n) % 2 if sides else None
    got = roots(minhash.linked(np.arange(n), side, np.array([signature(s) for s in sets]).astype(np.uint16), sets))
    want = roots([(a, b) for a in range(n) for b in range(a) if (not sides or (a - b) % 2) and similar(sets[a], sets[b])])
    assert got == want and len(want) > 300
