import random

from cairn.llm import decontam as d


def brute(pattern, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
        prev = cur
    return min(prev)


def test_myers_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert d.myers(p, t, 999)[0] == brute(p, t)
        k = rng.randint(0, 20)
        got = d.myers(p, t, k)
        assert (got is None) == (brute(p, t) > k)


def test_pieces_cover_the_item():
    k, parts = d.pieces("x" * 103, 0.08)
    assert len(parts) == k + 1 == 9 and "".join(p for _, p in parts) == "x" * 103


def noisy(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("abcdefgh")
        elif kind == 1:
            t.insert(i, rng.choice("abcdefgh"))
        else:
            del t[i]
    return "".join(t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(6, 30))) for i in range(12)] + [(50, None), (51, "too short"), (None, text(9)), (3, text(12)), (52, "-- !"), (53, "")]
    docs = []
    for i in range(60):
        own = items[rng.choice([*range(12), 14, 15])][1]
        own = noisy(rng, own, rng.randint(0, len(own) // 8)) if i % 3 else ""
        own = own.upper().replace(" ", ",\n ") if i % 2 else own
        docs.append((i, f"{text(rng.randint(0, 40))}. {own} {text(rng.randint(0, 40))}", "x"))
    docs += [(70, "it is Too-short!", "x"), (71, "itistoo short", "x"), (72, text(40_000) + " " + items[5][1], "x"), (73, "too shortest", "x")]
    docs += [(60, None, "x"), (61, "", "x"), (None, items[0][1], "x"), (1, docs[1][1], "x")]
    base = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for doc, raw, _ in docs:
        n = d.normalized(raw or "")
        if len(n) > 10_000:
            want.add((doc, 5, 0))
            continue
        for item, t in items:
            t = d.normalized(t or "")
            if t and (f" {t} " in f" {n} " if len(t) < d.LEAST_CHARS else brute(t, n) <= int(len(t) * d.BUDGET)):
                want.add((doc, item, 0 if len(t) < d.LEAST_CHARS else brute(t, n)))
    for block in (d.BLOCK_CHARS, 300):
        rows = d.leaks(base, bench, block_chars=block).collect()
        best = {}
        for r in rows:
            best[r.doc_id, r.item_id] = min(r.edits, best.get((r.doc_id, r.item_id), 99))
        assert {(a, b, e) for (a, b), e in best.items()} == want and len(want) > 15
    assert {(70, 51, 0), (72, 5, 0)} <= want and {i for _, i, _ in want} >= {None, 3} and {a for a, *_ in want} >= {None}
    kept = d.without_leaks(base, bench)
    # each row by its own text: of two rows with one id only that with the item goes
    leaking = {a for a, _, _ in want}
    assert kept.columns == base.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in docs if i not in leaking)
    two = spark.createDataFrame([(1, items[0][1]), (1, "clean"), (None, items[0][1]), (None, None)], "doc_id long, text string")
    assert sorted(map(str, d.without_leaks(two, bench).collect())) == sorted(map(str, two.where("text is null or text = 'clean'").collect()))


def test_spans_are_in_the_text(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    raw = "Intro: é — " + item.upper().replace(" ", " * ") + "! The end. And again: " + item
    f = d.Finder([(1, item)])
    got = list(f.find(raw))
    assert len(got) == 2 and [raw[a:b] for _, _, _, a, b in got] == [item.upper().replace(" ", " * "), item]
    assert list(d.Finder([]).find(raw)) == [] and d.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_and_repeated_items():
    assert [h[0] for h in d.Finder([(1, "Paris is the capital")]).find("They say Paris is the capital.")] == [1]
    assert not list(d.Finder([(1, "aris is the capital")]).find("They say Paris is the capital."))
    one, two = "the first of two long items that share an id", "another long item with the same id as before"
    assert sorted(h[0] for h in d.Finder([(1, one), (1, two)]).find(f"{one}. {two}.")) == [1, 1]
    assert [h[0] for h in d.Finder([(1, one), (1, two)]).find(one)] == [1]
    assert len(list(d.Finder([(1, two)], least_chars=500).find(two[:-1]))) == 0
