import hashlib
import random
from collections import Counter

import pytest

from cairn.llm import sharding


def key(*told):
    return int(hashlib.md5("|".join([str(sharding.SEED), *(chr(0) if x is None else str(x) for x in told)]).encode()).hexdigest()[:8], 16)


def brute(rows, shards):
    """rows: (id, source, tie); the first shards hold one row more."""
    by = {}
    for i, s, t in rows:
        by.setdefault("n" if s is None else "v" + s, []).append((i, t))
    line = []
    for s, ids in by.items():
        ids.sort(key=lambda x: (key(*x), x[0] is not None, x[0] or 0, x[1]))
        line += [((r + 0.5) / len(ids), s, r, i) for r, (i, _) in enumerate(ids)]
    runs = [(s, k) for s in range(shards) for k in range(len(rows) // shards + (s < len(rows) % shards))]
    return [(i, s, shard, slot) for (_, s, _, i), (shard, slot) in zip(sorted(line), runs)]


@pytest.mark.parametrize("bucket", [3, 50_000])
@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_shards_equal_brute_force(spark, n, bucket):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)] + ([(2, "a"), (2, "a"), (None, "b"), (None, None)] if n > 5 else [])
    rows = [(i, s, rng.randrange(9)) for i, s in rows]
    df = spark.createDataFrame([(i, s, "x" * 30_000 if i == 3 else "x", 1, t) for i, s, t in rows], "doc_id long, source string, text string, shard int, tie int")
    got = sharding.interleave(df, 24, told_by=("tie",), rows_per_bucket=bucket)
    assert got.columns == ["doc_id", "source", "text", "tie", "shard", "slot"]
    got = [(r.doc_id, "n" if r.source is None else "v" + r.source, r.shard, r.slot) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 24), key=str)
    counts = Counter(s for *_, s, _ in got)
    assert not n or max(counts.values()) - (min(counts.values()) if len(counts) == 24 else 0) <= 1
    mix = Counter((s, g) for _, g, s, _ in got)
    for (s, g), k in mix.items():
        assert abs(k - counts[s] * sum(x[1] == g for x in got) / len(got)) <= 2


def test_null_and_repeated_ids_are_spread(spark):
    """Rows without an id, or with one id, are not one bucket: their hashes differ with the rest of the row."""
    df = spark.createDataFrame([(None if i % 2 else 7, "a", str(i)) for i in range(500)], "doc_id long, source string, text string")
    got = sharding.interleave(df, 4, rows_per_bucket=10)
    assert got.count() == 500 and {r["count"] for r in got.groupBy("shard").count().collect()} == {125}
    a, b = (sorted(map(str, sharding.interleave(df, 4, rows_per_bucket=10).collect())) for _ in range(2))
    assert a == b


def test_shards_follow_the_order_of_the_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i // 2, "abc"[min(2, int(3 * rng.random() ** (1 + i / 300)))], i) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, source string, n int").repartitionByRange(5, "n").sortWithinPartitions("n").write.parquet(f"{tmp_path}/d")
    got = sharding.interleave(spark.read.parquet(f"{tmp_path}/d"), 6, in_order=True, windows=10).collect()
    assert sorted(r.n for r in got) == list(range(1000))
    by = {}
    for r in sorted(got, key=lambda r: r.slot):
        by.setdefault(r.shard, []).append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and [r.slot for r in by[0]] == list(range(len(by[0])))
    for own in by.values():
        window = [r.n // 100 for r in own]
        assert window == sorted(window)
        for w in range(10):  # the mixture of each window, in each shard
            for s in "abc":
                share = sum(r.source == s for r in got if r.n // 100 == w) / 6
                assert abs(sum(r.source == s for r in own if r.n // 100 == w) - share) <= 2


def test_native(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string").repartition(2)
    plan = sharding.interleave(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
