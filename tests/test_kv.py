import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.codec import encode_frame
from cairn.operators import kv
from cairn.plans import stats
from cairn.plans.engine import Engine
from cairn.plans.storage import Conflict, Options, Store
from cairn.sources import wal


def state(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_merge_of_streams(spark):
    old = kv.puts(spark, [(b"a", b"v1"), (b"b", b"v1_old"), (b"c", b"v1_old"), (b"d", b"v1")], ts=1)
    new = kv.merge(kv.puts(spark, [(b"b", b"v2_new")], ts=2), kv.deletes(spark, [b"c"], ts=2))
    assert state(kv.current(kv.merge(new, old))) == {b"a": b"v1", b"b": b"v2_new", b"d": b"v1"}


def test_order_is_that_of_bytes(spark):
    rows = kv.puts(spark, [(k, b"") for k in (b"\xff", b"apple", b"fig", b"date", b"\x00", b"cherry")], ts=1)
    assert [bytes(r.key) for r in kv.scan(rows).collect()] == [b"\x00", b"apple", b"cherry", b"date", b"fig", b"\xff"]
    assert bytes(kv.seek(rows, b"czzz").first().key) == b"date"
    assert [bytes(r.key) for r in kv.scan(rows, b"cherry", b"fig", limit=2).collect()] == [b"cherry", b"date"]


def test_bad_keys(spark):
    for key in (b"", b"x" * 65_536):
        with pytest.raises(ValueError):
            kv.puts(spark, [(key, b"")], ts=1)


def test_random_mutations(spark):
    rng, want, rows = random.Random(5), {}, []
    for i in range(600):
        key = b"k%d" % rng.randrange(60)
        op = 2 if rng.random() < 0.3 else 1
        value = b"v%d" % i if op == 1 else None
        rows.append((bytearray(key), bytearray(value) if value else None, i // 7, i, op))
        want.pop(key, None) if op == 2 else want.__setitem__(key, value)
    assert state(kv.current(spark.createDataFrame(rows, "key binary, value binary, ts long, seq long, op tinyint"))) == want


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/kv", Options(l0_trigger=3))


def test_lifecycle(engine):
    engine.put_many([(b"user_%04d" % i, b"profile_data_%04d" % i) for i in range(300)])
    engine.delete(b"user_0042")
    assert engine.get(b"user_0042") is None and engine.get(b"user_0043") == b"profile_data_0043"
    assert len(engine.scan(b"user_0100", b"user_0110")) == 11
    assert engine.get(b"nobody") is None and len(engine.scan(limit=0)) == 100


def test_compaction_keeps_the_newest(engine):
    """A newer version wins and a deleted key stays deleted, whatever the order of tables."""
    for n in range(4):
        engine.put_many([(b"k_%02d_%04d" % (n, i), b"x") for i in range(50)] + [(b"same", b"%d" % n), (b"gone%d" % n, b"x")])
    engine.delete_many([b"gone1", b"gone2"])
    before = state(engine.store.current())
    assert engine.compact() >= 1
    assert state(engine.store.current()) == before and before[b"same"] == b"3" and b"gone1" not in before and len(before) == 203
    m = engine.store.manifest()
    assert {t.level for t in m.tables} == {1} and sum(t.entry_count for t in m.tables) == 203
    assert engine.stats()["entries_dropped"] == 3 + 4 and "cairn_disk_bytes" in engine.metrics()
    assert stats.overlapping(engine.store.tables(), b"same", b"same").count() == 1


def test_tombstones_stay_above_older_levels(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/kv", Options(l0_trigger=1, level1_bytes=1))
    e.put_many([(b"a", b"1"), (b"b", b"1")])
    e.store.compact(), e.store.compact()  # to level 2
    assert {t.level for t in e.store.manifest().tables} == {2}
    e.delete(b"a")
    work = e.store.compact()
    assert work.level == 0 and not work.bottom and e.get(b"a") is None
    e.compact()
    assert e.get(b"a") is None and e.get(b"b") == b"1" and all(t.level <= 6 for t in e.store.manifest().tables)


def test_snapshots_batches_and_vacuum(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", Options(keep_versions=1, l0_trigger=2, vacuum_age_s=0))
    s.flush(kv.puts(spark, [(b"a", b"1")], 1), "b1")
    s.flush(kv.puts(spark, [(b"a", b"2")], 2), "b1")
    assert len(s.versions()) == 1 and state(s.current()) == {b"a": b"1"}
    s.flush(kv.puts(spark, [(b"a", b"3")], 3), "b2")
    assert state(s.current(version=1)) == {b"a": b"1"} and state(s.current()) == {b"a": b"3"}
    s.compact()
    assert s.vacuum() == 2 and state(s.current()) == {b"a": b"3"} and s.vacuum() == 0
    stale = s.manifest()
    s.flush(kv.puts(spark, [(b"z", b"1")], 4))
    with pytest.raises(Conflict):
        s._commit(stale)


def test_point_reads_prune(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", Options(l0_trigger=1, table_bytes=2000))
    s.flush(kv.puts(spark, [(b"key_%05d" % (2 * i), b"v" * 20) for i in range(2000)], 1))
    s.compact()
    m = s.manifest()
    assert len(m.tables) > 2 and sum(t.overlaps(b"key_00100".hex().upper(), b"key_00100".hex().upper()) for t in m.tables) == 1
    assert s.get(b"key_00100").count() == 1 and s.get(b"key_00101").count() == 0
    plan = s.get(b"key_00100")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan


FRAMES = lambda n: b"".join(encode_frame(b"key_%05d" % i, b"value", i, 1) for i in range(n))


def flipped(data, at):
    return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]


ONE = len(FRAMES(1))
WAL = [
    ("clean", FRAMES(500), 500, None, False),
    ("garbage", FRAMES(50) + b"\x01\x02\x03\x04\x05\x06", 50, "truncated_tail", True),
    ("header", FRAMES(250) + b"\x00\x00\x00\x01", 250, "truncated_tail", True),
    ("payload", FRAMES(250) + b"\x00\x00\x00\x01\x00\x00\x00\x64" + b"x" * 20, 250, "truncated_tail", True),
    ("crc", flipped(FRAMES(50), 50 * ONE - 10), 49, "bad_crc_tail", True),
    ("length", FRAMES(30) + b"\x00\x00\x00\x01\xff\xff\xff\xff", 30, "bad_length", True),
    ("length2", FRAMES(30) + b"\x00\x00\x00\x01\xff\xff\xff\xff" + b"x" * 30, 30, "bad_length_middle", False),
    ("middle", flipped(FRAMES(100), 50 * ONE + 12), 50, "corrupt_middle", False),
]


def test_recovery(spark, tmp_path):
    folder = tmp_path / "wal"
    folder.mkdir()
    for i, (_, data, *_) in enumerate(WAL):
        (folder / f"{i + 2}.wal").write_bytes(data)
    (folder / "99.wal").write_bytes(b"")  # an empty segment has no row
    got = {wal.segment_number(r.path) - 2: r for r in wal.recovery_report(spark, f"file://{folder}").collect()}
    for i, (name, data, n, kind, cut) in enumerate(WAL):
        r = got[i]
        assert (r.valid_records, r.corruption_type, r.file_truncated, r.corruption_detected) == (n, kind, cut, kind is not None), name
        assert r.bytes_recovered == n * ONE and r.corruption_offset == (n * ONE if kind else None), name
        assert (folder / f"{i + 2}.wal").read_bytes() == data
    rows = wal.read_wal(spark, f"file://{folder}")
    assert rows.count() == sum(x[2] for x in WAL)
    assert rows.where("segment = 2").agg(F.max("ts")).first()[0] == 499
    assert [r.segment for r in wal.segments(spark, f"file://{folder}").collect()] == list(range(2, 2 + len(WAL)))
    assert len(state(kv.current(rows.select("key", "value", "ts", "seq", "op")))) == 500


def test_segments_that_come_or_grow_later_are_recovered(spark, tmp_path):
    folder = tmp_path / "wal"
    folder.mkdir()
    put = lambda k, v, ts: encode_frame(k, v, ts, 1)
    e = Engine(spark, f"file://{tmp_path}/kv")
    (folder / "wal_000001.log").write_bytes(put(b"a", b"1", 1))
    assert [r.valid_records for r in e.recover(f"file://{folder}").collect()] == [1]
    (folder / "wal_000002.log").write_bytes(put(b"b", b"1", 2))
    assert len(e.recover(f"file://{folder}").collect()) == 2 and dict(e.scan()) == {b"a": b"1", b"b": b"1"}
    (folder / "wal_000002.log").write_bytes(put(b"b", b"1", 2) + put(b"c", b"1", 3))
    e.recover(f"file://{folder}")
    n = len(e.store.versions())
    e.recover(f"file://{folder}")  # nothing new: no commit
    assert dict(e.scan()) == {b"a": b"1", b"b": b"1", b"c": b"1"} and len(e.store.versions()) == n
    assert e.recover(f"file://{folder}", "*1.log").count() == 1


def test_written_segments_read_back(spark, tmp_path):
    rows = kv.merge(kv.puts(spark, [(b"k%03d" % i, b"v" * (i % 5)) for i in range(100)], 7), kv.deletes(spark, [b"k001"], 8)).repartition(4)
    told = wal.write_wal(rows, f"file://{tmp_path}/w", first=3)
    assert sum(r.records for r in told.collect()) == 101 and (tmp_path / "w" / "wal_000003.log").exists()
    back = wal.read_wal(spark, f"file://{tmp_path}/w")
    read = lambda df: sorted((bytes(r.key), bytes(r.value or b""), r.ts, r.op) for r in df.collect())
    assert read(back) == read(rows) and not wal.recovery_report(spark, f"file://{tmp_path}/w").where("corruption_detected").count()


def test_one_writer_creates_a_file(spark, tmp_path):
    from cairn.plans.files import Folder

    f = Folder(spark, f"file://{tmp_path}/x")
    assert f.create("1", "a") and not f.create("1", "b") and f.read("1") == "a" and f.names() == ["1"]


def test_vacuum_leaves_what_is_young(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/kv", Options(keep_versions=1))
    s.flush(kv.puts(spark, [(b"a", b"1")], 1))
    kv.puts(spark, [(b"b", b"1")], 1).write.parquet(f"file://{tmp_path}/kv/data/uncommitted")
    assert s.vacuum() == 0 and (tmp_path / "kv/data/uncommitted").exists()


def test_percentiles_equal_sorting(spark):
    rng = random.Random(1)
    for xs in ([5], [1] * 900 + [2] * 100, [rng.randrange(10**6) for _ in range(5000)] + [7] * 3000 + [None]):
        got = stats.latency_percentiles(spark.createDataFrame([(x,) for x in xs], "x long"), "x").first()
        own = sorted(x for x in xs if x is not None)
        assert list(got) == [own[len(own) * k // 1000] for k in (500, 950, 990, 999)]


def test_decode_error(tmp_path):
    import io
    import struct
    import zlib

    body = struct.pack(">qBHI", 1, 1, 500, 0)
    report = wal.Report()
    assert list(wal.frames(io.BytesIO(struct.pack(">II", zlib.crc32(body), len(body)) + body), 1000, report)) == [] and report["corruption_type"] == "decode_error"


def test_recovered_segments_become_state(spark, tmp_path):
    folder = tmp_path / "wal"
    folder.mkdir()
    (folder / "1.wal").write_bytes(b"".join(encode_frame(b"k%d" % i, b"old", i, 1) for i in range(5)))
    (folder / "2.wal").write_bytes(encode_frame(b"k1", b"new", 9, 1) + encode_frame(b"k2", None, 9, 2) + b"torn")
    e = Engine(spark, f"file://{tmp_path}/kv", Options(l0_trigger=1), auto_compact=True)
    for _ in range(2):  # the second time changes nothing
        report = {wal.segment_number(r.path): r for r in e.recover(f"file://{folder}").collect()}
        assert report[2].corruption_type == "truncated_tail" and not report[1].corruption_detected
        assert dict(e.scan()) == {b"k0": b"old", b"k1": b"new", b"k3": b"old", b"k4": b"old"}
    e.store.bypass_bloom = True
    assert e.get(b"k1") == b"new" and e.get(b"k2") is None
    assert {t.level for t in e.store.manifest().tables} == {1}
