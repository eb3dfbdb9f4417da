import math
import random
from collections import Counter, defaultdict

import pytest

from cairn.llm import kneser


N, PAD, LAST = kneser.ORDER, kneser.START * (kneser.ORDER - 1), kneser.END


def brute(texts):
    """Interpolated modified Kneser-Ney by the book: p(window) for any window of bytes."""
    counts = {N: Counter()}
    for t in texts:
        data = PAD + t.encode() + LAST
        for i in range(len(data) - N + 1):
            counts[N][data[i : i + N]] += 1
    for n in range(N - 1, 0, -1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
        for k in counts[n]:
            if k[:1] == kneser.START:
                counts[n][k] = sum(c for long, c in counts[n + 1].items() if long[1:] == k)
    cuts, totals, gammas = {}, {}, {}
    for n in range(1, N + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (of[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
        cuts[n] = [min(max(x, 0.05), 0.95 * (i + 1)) for i, x in enumerate(d)]
        totals[n], lost = defaultdict(int), defaultdict(float)
        for k, c in counts[n].items():
            totals[n][k[:-1]] += c
            lost[k[:-1]] += cuts[n][min(c, 3) - 1]
        gammas[n] = {k: lost[k] / totals[n][k] for k in lost}

    def p(k):
        n = len(k)
        if n == 0:
            return 1 / 256
        low = p(k[1:])
        if k[:-1] not in totals[n]:
            return low
        c = counts[n].get(k, 0)
        own = (c - cuts[n][min(c, 3) - 1]) / totals[n][k[:-1]] if c else 0
        return own + gammas[n][k[:-1]] * low

    return p


def told(p, text):
    """(log probability, number of windows) of a text."""
    data = PAD + (text or "").encode() + LAST
    logs = [math.log(p(data[j : j + N])) for j in range(len(data) - N + 1)]
    return sum(logs), len(logs)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["das", "haus", "the", "house", "é", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]


SIZES = [{}, {"shard_rows": 60}, {"shards": 1, "splits": 1}]


@pytest.mark.parametrize("sizes", SIZES)
def test_perplexity_is_that_of_the_book(spark, texts, sizes, tmp_path):
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = brute(texts)
    assert abs(sum(p(b"house"[-N + 1 :] + bytes([b])) for b in range(256)) - 1) < 1e-9
    probe = [*texts[:5], "QQQ!!", "the the the", "", None, "z" * 3000, "\x02\x03"]
    rows = [(i, t, "l", i * 2) for i, t in enumerate(probe)] + [(3, "other", "l", 0), (None, "x", "l", 0), (None, "y", "l", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, split int").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d").select("doc_id", "text", "lang")
    got = kneser.perplexities(docs, model, **sizes)
    assert got.columns == ["doc_id", "lang", "logp", "n", "perplexity"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, -1 if r.perplexity is None else r.perplexity) for r in got.collect())
    want = sorted((i is None, i or 0, told(p, t)[1], math.exp(-told(p, t)[0] / told(p, t)[1]) if t else -1) for i, t, *_ in rows)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-4)


def test_texts_are_not_shuffled_and_the_model_is_not_sent(spark, texts, tmp_path):
    spark.createDataFrame([(1, texts[0], "l")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    model = kneser.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    plan = kneser.perplexities(spark.read.parquet(f"{tmp_path}/d"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Broadcast" not in plan


def test_long_texts_go_in_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kneser, "_PIECE", 50)
    got = Counter()
    text = "".join(chr(97 + i % 26) for i in range(333))
    for data, _, begins in kneser._pieces(pa.array([text, "ab", None])):
        k, inside = kneser._windows(data, begins)
        got.update(k[inside].tolist())
    want = Counter()
    for t in (text, "ab", ""):
        data = PAD + t.encode() + LAST
        want.update(int.from_bytes(data[i : i + N], "big") for i in range(len(data) - N + 1))
    assert got == want


@pytest.mark.parametrize("sizes", SIZES)
def test_decisions_equal_brute_force(spark, texts, sizes, monkeypatch):
    """kept, for every row, from perplexities by the book: null ids, repeated ids and empty texts among them."""
    monkeypatch.setattr(kneser, "LEAST_DOCS", 3)
    rng = random.Random(9)
    rows = [(i, t, "de" if i % 2 else None) for i, t in enumerate(texts)] + [(100, "#!$%&" * 30, "de"), (101, None, "de"), (102, "", "xx"), (None, texts[0], "de"), (None, "QQ!", "de"), (3, texts[3], "de"), (3, "ZZZZ", "de"), (103, "das haus " * 2000, "xx")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (7,)], "doc_id long")
    got = kneser.quality(docs, trusted, **sizes)
    assert got.columns == ["doc_id", "lang", "perplexity", "score", "threshold", "kept"]
    held = {i for i in range(40) if spark.sql(f"select pmod(xxhash64({i}L), 5)").first()[0] == 0}
    p = brute([t for i, t, _ in rows if i is not None and i < 40 and i not in held])
    logs = [(i, t, lang, *told(p, t)) for i, t, lang in rows]
    back = [x for x in logs if x[0] in held and x[1]]
    by = {lang: [x for x in back if x[2] == lang] for lang in {x[2] for x in back}}
    means = {lang: sum(x[3] for x in own) / sum(x[4] for x in own) for lang, own in by.items() if len(own) >= 3}
    every = sum(x[3] for x in back) / sum(x[4] for x in back)
    score = lambda x: math.exp(-(x[3] + kneser.PRIOR * means.get(x[2], every)) / (x[4] + kneser.PRIOR))
    top = lambda own: sorted(map(score, own))[math.ceil(kneser.QUANTILE * len(own)) - 1]
    cuts = {lang: top(by[lang]) for lang in means}
    want = sorted((x[0] is None, x[0] or 0, x[4], bool(x[1]) and score(x) <= cuts.get(x[2], top(back)) * (1 + 1e-6)) for x in logs)
    seen = sorted((r.doc_id is None, r.doc_id or 0, r.perplexity or 0, r.kept) for r in got.collect())
    count = lambda rows: Counter((a, b, k) for a, b, _, k in rows)
    assert count(seen) == count(want) and len(held) >= 6
    assert not any(k for _, i, _, k in seen if i in (100, 101, 102))
    none = kneser.quality(docs, trusted.where("false"), **sizes)
    assert [r.kept for r in none.where("doc_id = 100").collect()] == [True] and kneser.quality(docs.where("false"), trusted, **sizes).count() == 0


def test_each_row_by_itself(spark, texts):
    rows = [(i, t, "l", 7) for i, t in enumerate(texts)] + [(900, "#" * 200, "l", 8), (900, texts[2], "l", 10), (None, "#" * 200, "l", 9), (None, texts[1], "l", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __n int")
    got = kneser.with_quality(docs, spark.createDataFrame([(i,) for i in range(40)], "doc_id long"))
    assert got.columns == [*docs.columns, "__kept"] and got.count() == len(rows)
    assert {r["__n"]: r["__kept"] for r in got.where("__n > 7").collect()} == {8: False, 9: False, 10: True, 11: True}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = kneser.op2_kneser_ney_quality(spark, sf).join(labels, "doc_id").groupBy("quality").avg("score").collect()
    by = kneser.op2_kneser_ney_quality(spark, sf).join(labels, "doc_id").selectExpr("quality", "cast(kept as int) k").groupBy("quality").avg("k").collect()
    kept = {x[0]: x[1] for x in by}
    assert len(r) == 2 and kept[1] >= 0.97 and kept[0] <= 0.4
