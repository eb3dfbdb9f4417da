import gc
import random

import pytest

import corpus_pipeline as cp
from cairn.llm import decontam, kneser, minhash, mixing


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(20)
    docs = [(i, text(rng.randint(20, 80)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None])) for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "a") for i in range(20)]
    docs += [(300 + i, f"{text(30)} {item} {text(10)}", "en", "b") for i in range(5)]
    docs += [(400 + i, "#@!%$ " * 40 + str(i), "en", "b") for i in range(8)] + [(500, None, "en", "a"), (501, "", None, "a")]
    rows = [(*d, len(d[1] or "")) for d in docs]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 400 <= i < 500), 0) for i, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        path = f"{tmp_path}/out-{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "quality":
            want = {r.doc_id for r in kneser.quality(before, kneser.trusted_ids(spark, str(tmp_path))).where("kept").collect()}
        elif name == "near_duplicates":
            want = {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
        elif name == "decontaminate":
            leaks = {r.doc_id for r in decontam.leaks(before, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
            want = {r.doc_id for r in before.collect()} - leaks
        elif name == "mix":
            plan = mixing.plan(before).collect()
            want = {r.doc_id for r in plan if r.times}
            assert now.count() == sum(r.times for r in plan)
        else:
            want = {r.doc_id for r in before.collect()}
            assert now.count() == before.count()
        assert seen[name] == want, name
        assert now.columns == before.columns + (["shard", "slot"] if name == "shard" else [])
    clean = {d[0] for d in docs if d[0] < 150}
    assert not {i for i in seen["quality"] if i >= 400} and len(clean & seen["quality"]) >= 145
    assert not {i for i in seen["near_duplicates"] if 200 <= i < 300} and clean & seen["quality"] <= seen["near_duplicates"]
    assert not {i for i in seen["decontaminate"] if i >= 300} and clean & seen["quality"] <= seen["decontaminate"]
    a, b = (sorted(map(tuple, cp.run(spark, str(tmp_path)).collect()), key=str) for _ in range(2))
    assert a == b and len(a) == now.count()


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_stages_begin_with_a_small_heap(spark, tmp_path, name):
    """Garbage of earlier work, 1 GB here, goes back to the system; tasks run in this one JVM."""
    docs = [(i, f"a few words of text {i}", "en", "a", 20) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such passage is in the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    garbage = spark.sparkContext._gateway.new_array(spark._jvm.long, 1 << 27)
    grown = heap.totalMemory()
    assert grown > 1 << 30
    del garbage
    gc.collect()
    dict(cp.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert heap.totalMemory() < grown - (1 << 28)
