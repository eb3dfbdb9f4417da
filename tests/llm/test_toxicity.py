import math
import random
import zlib

import numpy as np

from cairn.llm import toxicity as t


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:  # inflected forms of one stem, most of them seen once
            words.insert(rng.randrange(len(words) + 1), "zonk" + rng.choice("aeiou") + rng.choice("mnrst"))
        docs.append((i, " ".join(words).capitalize() + ".", rng.choice(["xx", "yy"]), "s"))
        if i % 10:
            labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    truth = {i: y for i, _, y in labels}
    docs += [(None, docs[0][1], "xx", "s"), (9000, None, None, None), (9001, "", "xx", "s"), (9002, "word " * 300_000, "xx", "s"), (9003, "word " * 300_000 + "zonkam", "xx", "s"), (3, docs[3][1], "xx", "s")]
    base = spark.createDataFrame([(*d, 5.0) for d in docs], "doc_id long, text string, lang string, source string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    rows = t.toxic_scores(base, lab).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.flagged == (r.score >= r.lang_threshold)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    hits = sum(p and y for p, y in held)
    assert 2 * hits / (sum(p for p, _ in held) + sum(y for _, y in held)) >= 0.8
    by = {r.doc_id: r.score for r in rows}
    assert by[9000] == by[9001] < 0.5 and by[9002] < 0.5 < by[9003]
    # labels of held-out rows change nothing
    held_ids = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    turned = spark.createDataFrame([(i, q, 1 - y if i in set(held_ids) else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in t.toxic_scores(base, turned).collect()}
    assert again == by


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.toxic_scores(docs, none).first().predicted == 0
    assert t.toxic_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).first().predicted == 1
    assert t.toxic_scores(docs.where("false"), none).count() == 0


def test_scores_do_not_depend_on_the_batch():
    net = t.Net(3)
    net.emb *= 10
    texts = ["a bb ccc", "", "x " * 120_000, "d e", None, "ccc"]
    together = t.Scorer(net).logits(texts)
    alone = [t.Scorer(net).logits([x])[0] for x in texts]
    assert np.allclose(together, alone, atol=1e-4, equal_nan=True) and np.isnan(together[[1, 4]]).all()


def test_scores_equal_brute_force():
    """Every filter at every place, one word after the other."""
    net = t.Net(4)
    net.emb *= 8
    net.bias += np.linspace(-0.3, 0.3, len(net.bias)).astype(np.float32)
    for text in ("Ab c de, fgh!", "x", "one two  three four five\nsix é 7"):
        words = [net.emb[t.features(w)].sum(axis=0) for w in t.words_of(text)]
        z, at = float(net.base[0]), 0
        for k, width in enumerate(t.WIDTHS):
            for f in range(t.FILTERS):
                best = 0.0
                for i in range(len(words)):
                    m = net.bias[k * t.FILTERS + f]
                    for j in range(width):
                        if i + j < len(words):
                            m += words[i + j] @ net.conv[:, at + j * t.FILTERS + f]
                    best = max(best, float(m))
                z += best * float(net.out[k * t.FILTERS + f])
            at += width * t.FILTERS
        assert abs(t.Scorer(net).logits([text])[0] - z) < 1e-3


def test_labels_and_texts_that_disagree(spark):
    """An id with two labels or two texts gives the same sample each time; the bounds hold."""
    docs, labels = corpus(3, 300)
    docs += [(i, "other text zonkam", "xx", "s") for i in range(1, 100)]
    labels += [(i, 1, 1) for i in range(1, 60)]
    base = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = t._sample(base, lab, 5, 50, 60, 10**6).to_pylist()
    b = t._sample(base.repartition(7), lab.repartition(3), 5, 50, 60, 10**6).to_pylist()
    assert a == b and len(a) == 110 and len({r["doc_id"] for r in a}) == 110
    few = t._sample(base, lab, 5, 50, 60, 2000).to_pylist()
    assert 0 < sum(len(r["text"]) for r in few) <= 2000


def test_gradient_lowers_the_loss():
    docs, labels = corpus(5, 200)
    words = t.Words()
    texts = [words.of(d[1]) for d in docs]
    y = np.array([int("zonk" in d[1].lower()) for d in docs])
    feats = words.fetched()
    net = t.fit(texts, y, feats, epochs=6)
    z = t.Scorer(net).logits(d[1] for d in docs)
    assert ((z > t.best_cut(z, y)) == y).mean() > 0.95


def test_best_cut():
    assert 0.3 < t.best_cut(np.array([0.1, 0.3, 0.5, 0.9]), np.array([0, 0, 1, 1])) < 0.5


def test_every_labelled_row_counts(spark):
    """A third of the toxic rows, those with the highest hash of the id, have a sign of their own."""
    rng = random.Random(7)
    order = {r.id: r.at for r in spark.range(5000).selectExpr("id", "row_number() over (order by xxhash64(5, id)) as at").collect()}
    docs, labels = [], []
    for i in range(5000):
        toxic = int(i % 10 < 7)
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(6)]
        if toxic:
            words[rng.randrange(6)] = "zonk" if order[i] <= 3600 else "quux"
        docs.append((i, " ".join(words), "xx"))
        labels.append((i, toxic))
    rows = t.toxic_scores(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(r.predicted, docs[r.doc_id][1]) for r in rows if r.held_out]
    for sign, least in (("zonk", 0.95), ("quux", 0.95)):
        own = [p for p, text in held if sign in text]
        assert len(own) > 50 and sum(own) / len(own) >= least
    clean = [p for p, text in held if "zonk" not in text and "quux" not in text]
    assert sum(clean) / len(clean) <= 0.05


def test_several_shards(spark):
    """Shards learn together, whatever the partitions; labels of held-out rows change nothing."""
    docs, labels = corpus(9, 1500)
    truth = {i: y for i, _, y in labels}
    base = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = t.toxic_scores(base.repartition(5), lab.repartition(3), shard_rows=300).collect()
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert 2 * sum(p and y for p, y in held) / (sum(p for p, _ in held) + sum(y for _, y in held)) >= 0.8
    turned = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels], "doc_id long, quality int, toxic int")
    again = t.toxic_scores(base, turned, shard_rows=300).collect()
    before = {r.doc_id: r.score for r in rows}
    assert len(again) == len(rows) and all(math.isclose(r.score, before[r.doc_id], abs_tol=1e-6) for r in again)


def test_best_cuts_equal_those_of_one_list(spark):
    r = np.random.default_rng(3)
    rows = [(g, int(r.random() < p), float(np.round(r.normal(p, 1), d))) for g, p, d in (("a", 0.3, 6), ("b", 0.6, 1), ("c", 0.0, 3), ("d", 1.0, 0)) for _ in range(400)]
    got = t.best_cuts(spark.createDataFrame(rows, "lang string, toxic int, z double"), "lang")
    for g in "abcd":
        own = [(z, y) for k, y, z in rows if k == g]
        assert math.isclose(got[g], t.best_cut(*(np.array(x) for x in zip(*own))), abs_tol=1e-9)
