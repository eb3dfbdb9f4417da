import hashlib
import math
import random
import re

import pytest

from cairn.llm import mixing


def key(i, n):
    return int(hashlib.md5(f"{mixing.SEED}|{chr(0) if i is None else i}|{n}".encode()).hexdigest()[:8], 16)


def brute(rows):
    """id -> (size, source size, target, times), by rounds of resharing."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((key(i, size(t)), i, size(t)))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total = {s: sum(x[2] for x in by[s]) for s in names}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    out = []
    for s in names:
        at, whole = 0, int(target[s] // total[s]) if total[s] else 0
        for _, i, n in sorted(by[s], key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            times = 0 if n == 0 else whole + (at + n / 2 <= target[s] - whole * total[s])
            out.append((i, n, total[s], round(target[s], 6), times))
            at += n
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, position int")


def fixture(n, seed=1):
    rng = random.Random(seed)
    text = lambda: " \t\n".join("w" for _ in range(rng.choice([0, 1, 2, 9, 30]))) + rng.choice(["", " ", "\x0b"])
    return [(i, rng.choice([None, text(), text()]), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]


@pytest.mark.parametrize("bucket", [4, 50_000])
@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "s")], fixture(300) + [(3, "a b c", "a"), (3, "a b c", "a"), (None, "x", "b")]])
def test_plan_equals_brute_force(spark, rows, bucket):
    got = mixing.plan(table(spark, rows), rows_per_bucket=bucket).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6) if r.target else 0.0, r.times) for r in got), key=str) == brute(rows)
    for r in got:
        assert len(r.positions) == r.times and r.positions == sorted(r.positions) and all(0 <= t <= 1 for t in r.positions)


def test_taken_words_come_near_the_target(spark):
    rows = fixture(500, 2)
    got = mixing.plan(table(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r["size"] * r.times)
        assert r.times <= 2
    assert all(abs(sum(v) - t) <= 15 for (_, t), v in by.items())


def test_inverse_of_the_schedule(spark):
    """The integral of the weights up to the time is the fraction of the demand."""
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.2), (0.3, 2.0), (1.0, 0.5)), ((0.0, 0.0), (0.5, 1.0), (1.0, 1.0))):
        df = spark.range(0, 101).selectExpr("id / 100.0D as f")
        for r in df.select("f", mixing._inverse(df["f"], schedule).alias("t")).collect():
            def area(t):
                out = 0.0
                for (a, wa), (b, wb) in zip(schedule, schedule[1:]):
                    u = min(max(t, a), b)
                    out += (u - a) * (wa + wa + (wb - wa) * (u - a) / (b - a)) / 2
                return out
            assert math.isclose(area(r.t), r.f * area(1.0), abs_tol=1e-9)


def test_mix_gives_documents_in_training_order(spark):
    rows = fixture(200, 3)
    df = table(spark, rows)
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "text", "source", "size", "position"]
    got = out.collect()
    times = {r.doc_id: r.times for r in mixing.plan(df).collect()}
    for i, t, s in rows:
        mine = [r for r in got if r.doc_id == i]
        assert len(mine) == times[i] and all((r.text, r.source, r["size"]) == (t, s, 1) for r in mine)
    at = [r.position for r in got]
    assert at == sorted(at) and len(at) > 100


def test_every_pass_is_in_the_mix(spark):
    df = table(spark, fixture(30, 5) + [(3, "x " * 40_000, "a"), (None, "a b", "b"), (None, "a b", "b")])
    planned = {}
    for r in mixing.plan(df, share=3.0, most=3.0).collect():
        planned[r.doc_id] = planned.get(r.doc_id, 0) + r.times
    got = {}
    for r in mixing.mix(df, share=3.0, most=3.0).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert {k: v for k, v in planned.items() if v} == got and max(got.values()) >= 3
    assert mixing.mix(df.where("false")).count() == 0


def test_heavy_sources_come_early(spark):
    rows = [(i, "w " * 20, "abc"[i % 3]) for i in range(600)]
    by = {}
    for r in mixing.mix(table(spark, rows)).collect():
        by.setdefault(r.source, []).append(r.position)
    mean = {s: sum(x) / len(x) for s, x in by.items()}
    assert mean["a"] < 0.47 < 0.53 < mean["c"] and 0.47 < mean["b"] < 0.53


def test_native(spark):
    plan = mixing.mix(table(spark, fixture(5)).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_reads_the_mix(spark, tmp_path):
    """What the query says of a document is what the rows of the mix hold of it, which are range-sorted, texts and all."""
    rows = fixture(200, 6) + [(None, "x y", "a"), (None, "x y", "a"), (3, "z", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    query = mixing.op8_curriculum_mix(spark, str(tmp_path))
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(position" in plan and "Python" not in plan and "Arrow" not in plan
    scan = plan[plan.index("rangepartitioning(position"):]
    assert "text" in scan.split("\n", 1)[1]
    got, expected = {}, {}
    for r in query.collect():
        words, first = got.get(r.doc_id, (0, []))
        got[r.doc_id] = (words + r.taken, sorted([*first, r.first_at] if r.first_at is not None else first))
    for r in mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        words, at = expected.get(r.doc_id, (0, []))
        expected[r.doc_id] = (words + len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), [*at, round(r.position, 6)])
    assert len(got) == 201
    for i, (words, first) in got.items():
        assert words == expected.get(i, (0, []))[0]
        # ids that several rows share have the first of each
        assert first == expected[i][1][:1] if len(first) == 1 else set(first) <= set(expected.get(i, (0, []))[1])


def test_query_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(i, t, s) for i, t, s in fixture(300, 8)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in mixing.op8_curriculum_mix(spark, str(tmp_path)).collect()]
    want = duck.execute(mixing.ORACLE).fetchall()
    assert len(got) == len(want) == 300
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:3] + a[4:5] == b[:3] + b[4:5] and math.isclose(a[3], b[3])
        assert (a[5] is None) == (b[5] is None) and (a[5] is None or math.isclose(a[5], b[5], abs_tol=2e-6))
