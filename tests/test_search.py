import json

import pytest

from cairn.functions.durations import parse_interval
from cairn.operators import histogram
from cairn.operators import search as s
from cairn.operators.search import Query
from cairn.plans.engine import SearchEngine, since
from cairn.schemas import LOG
from cairn.sources import json_ingest
from cairn.streaming import logs as streaming

BASE = 1_700_000_000_000_000_000
MIN = 60_000_000_000
ROWS = [
    ("log-001", BASE + 1 * MIN, "INFO", "auth-service", None, "User alice successfully logged in via OAuth", None),
    ("log-002", BASE + 2 * MIN, "WARN", "payment-service", None, "Database connection slow: latency spike 450ms", None),
    ("log-003", BASE + 3 * MIN, "ERROR", "payment-service", None, "Payment processing connection timeout on gateway", None),
    ("log-004", BASE + 4 * MIN, "ERROR", "order-service", None, "Failed to submit order due to connection timeout", None),
    ("log-005", BASE + 5 * MIN, "DEBUG", "auth-service", None, "Cache lookup for session token hit", None),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, LOG).cache()


@pytest.mark.parametrize(
    "q, ids",
    [
        (Query("timeout"), "004 003"),
        (Query("connection timeout payment"), "003"),
        (Query(level="ERROR"), "004 003"),
        (Query("timeout", service="order-service"), "004"),
        (Query("TIMEOUT", service="ORDER-SERVICE"), "004"),
        (Query(service="ORDER-SERVICE"), ""),
        (Query("the of"), "005 004 003 002 001"),
        (Query(limit=2, offset=1), "004 003"),
        (Query(offset=99), ""),
        (Query(limit=-1, offset=-1), "005 004 003 002 001"),
        (Query(from_time=BASE + 3 * MIN, to_time=BASE + 3 * MIN), "003"),
        (Query(level=" ERROR"), ""),
        (Query(level="error"), "004 003"),
        (Query("timeout session", match="any"), "005 004 003"),
        (Query(host=""), "005 004 003 002 001"),
        (Query(fields={"a": ""}), ""),
    ],
)
def test_search(logs, q, ids):
    want = ["log-" + i for i in ids.split()]
    assert [r.id for r in s.search(logs, q).collect()] == want
    assert [r.id for r in s.search(logs, q, s.postings(logs)).collect()] == want


def test_total_counts_before_paging(logs):
    assert s.total_hits(logs, Query(limit=1)).first()[0] == 5


def test_ties_are_in_order_of_id(spark):
    rows = [(i, 5, "INFO", "s", "", "m", {}) for i in ("b", "a", "c:d")]
    assert [r.id for r in s.search(spark.createDataFrame(rows, LOG), Query()).collect()] == ["a", "b", "c:d"]


def test_histogram(logs):
    got = histogram.histogram(logs, parse_interval("2m")).collect()
    assert sum(r["count"] for r in got) == 5 and all(r.timestamp % (2 * MIN) == 0 for r in got)
    assert histogram.total(logs, parse_interval("1m")).first().total == 5
    assert sum(r["count"] for r in histogram.counts(logs, MIN, max_hits=3).collect()) == 3
    assert {len(r.bar) for r in histogram.bars(logs, parse_interval("1h")).collect()} <= set(range(1, 41))


SAMPLE = [
    {"id": f"log-00100{i + 1}", "timestamp": 1726830000000000000 + i * 5_000_000_000, "level": lv, "service": "s", "host": "h", "message": m, "fields": f}
    for i, (lv, m, f) in enumerate(
        [("INFO", "a b start", {}), ("INFO", "ok go", {}), ("WARN", "slow", {}), ("ERROR", "connection timeout", {"provider": "stripe"}), ("ERROR", "timeout of connection", {}), ("WARN", "warm", {}), ("DEBUG", "dbg", {}), ("INFO", "end", {})]
    )
]


def test_engine_round_trip(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/logs")
    assert e.search(Query())["logs"] == [] and e.aggregate(Query())["buckets"] == []
    assert e.ingest_json(json.dumps(SAMPLE), batch="x") == (8, 0)
    assert e.ingest_json(json.dumps(SAMPLE), batch="x") == (0, 0)
    got = e.search(Query("connection timeout"))
    assert got["total_hits"] == 2 and [r["id"] for r in got["logs"]] == ["log-001005", "log-001004"]
    assert e.search(Query(fields={"provider": "stripe"}))["total_hits"] == 1
    assert e.search(Query(fields={"nokey": ""}))["total_hits"] == 8
    assert [(b["timestamp"], b["count"]) for b in e.aggregate(Query(), "1m")["buckets"]] == [(1726830000000000000, 8)]
    assert [b["count"] for b in e.aggregate(Query(), "10s")["buckets"]] == [2, 2, 2, 2]
    # a new version of a log replaces the old one, and its terms
    assert e.ingest_json('{"id": "log-001004", "timestamp": 5, "message": "renamed"}') == (1, 0)
    assert e.search(Query("connection timeout"))["total_hits"] == 1
    assert e.get("log-001004")["message"] == "renamed" and e.get("none") is None
    assert e.index().where("term = 'renamed'").count() == 1


@pytest.mark.parametrize(
    "body, good, bad",
    [
        ('{"message":"m"}', 1, 0),
        ('{"message":""}', 0, 1),
        ('{"message":" "}', 1, 0),
        ('{"message":"m","fields":{"a":1}}', 0, 1),
        ('{"message":5}', 0, 1),
        ('{"message":"m","timestamp":"x"}', 0, 1),
        ('[{"message":"a"},null,{"message":"b"}]', 2, 1),
        ('{"message":"a"}\n\n{"message":"b"}', 2, 0),
        ('{\n "message": "pretty"\n}', 1, 0),
        ("hello", 0, 1),
        ("[1", 0, 1),
        ('{"message":"m","host":null,"fields":null}', 1, 0),
    ],
)
def test_bodies(spark, body, good, bad):
    valid, rejected = json_ingest.split(json_ingest.from_bodies(spark.createDataFrame([(body,)], "value string")))
    assert (valid.count(), rejected.count()) == (good, bad)


def test_defaults(spark):
    lines = spark.createDataFrame([('{"message":"m"}',), ('{"message":"m","level":" warn "}',), ('{"message":"m","level":"  ","id":"i","service":" "}',)], "value string")
    valid, _ = json_ingest.split(json_ingest.from_lines(lines), now_ns=7)
    a, b, c = valid.collect()
    assert len(a.id) == 32 and int(a.id, 16) >= 0 and (a.timestamp, a.level, a.service) == (7, "INFO", "default")
    assert b.level == "WARN" and (c.level, c.id, c.service) == ("", "i", " ")


def test_since():
    assert since("1m", 10**12) == 10**12 - MIN and since("soon") == 0


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(r) for r in SAMPLE[i::3]))
    e = SearchEngine(spark, f"file://{tmp_path}/logs")
    for _ in range(2):  # the second run finds nothing new
        q = streaming.ingest(streaming.read_lines(spark, str(tmp_path / "in"), 1), e, str(tmp_path / "cp"))
        q.awaitTermination()
    assert e.logs().count() == 8 and len(e.batches()) == 3
    stream = json_ingest.split(streaming.read_lines(spark, str(tmp_path / "in")))[0]
    q = streaming.histogram(stream, "10 seconds").writeStream.outputMode("complete").format("memory").queryName("hist").trigger(availableNow=True).start()
    q.awaitTermination()
    want = histogram.by_level(e.logs(), 10_000_000_000)
    assert sorted(map(tuple, spark.table("hist").select("bucket", "level", "count").collect())) == sorted(map(tuple, want.collect()))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, LOG).write.parquet(str(tmp_path / "l"))
    df = s.hits(spark.read.parquet(str(tmp_path / "l")), Query(service="auth-service", from_time=5)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,5)" in plan.split("PushedFilters")[1]
    assert "ReadSchema: struct<id:string,timestamp:bigint,service:string>" in plan


def test_all_ways_fold_alike(spark, tmp_path):
    rows = [("a", 5, "INFO", "s", "", "\u0130STANBUL opened", {}), ("b", 6, "INFO", "s", "", "istanbul stays", {})]
    logs = spark.createDataFrame(rows, LOG)
    for text in ("istanbul", "\u0130stanbul", "ISTANBUL"):
        assert [r.id for r in s.search(logs, Query(text)).collect()] == ["b", "a"] == [r.id for r in s.search(logs, Query(text), s.postings(logs)).collect()]


def test_versions_of_many_partitions(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/logs")
    lines = spark.range(0, 130, 1, 130).selectExpr("concat('{\"message\":\"m', id, '\",\"timestamp\":', id + 1, ',\"id\":\"', if(id in (5, 129), 'same', string(id)), '\"}') as value")
    assert e.ingest(json_ingest.from_lines(lines)) == (130, 0)
    assert e.get("same")["message"] == "m129" and e.logs().count() == 129


def test_writers_at_once(spark, tmp_path):
    """Two writers that saw the same last batch get two numbers; one batch id is in once."""
    import threading

    root = f"file://{tmp_path}/logs"
    got = []

    def write(k):
        got.append(SearchEngine(spark, root).ingest_json(json.dumps([{"id": f"{k}", "message": f"writer {k}"}, {"id": "same", "message": "x"}]), batch="dup" if k > 1 else None))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    e = SearchEngine(spark, root)
    assert [n for n, *_ in e.batches()] == [1, 2, 3] and sorted(got) == [(0, 0), (2, 0), (2, 0), (2, 0)] and e.search(Query("writer"))["total_hits"] == 3


def test_queries_use_the_index_and_the_days(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/logs")
    day = 86_400_000_000_000
    e.ingest_json(json.dumps([{"id": f"{i}", "timestamp": BASE + i * day, "level": "info", "service": "s", "message": f"alpha n{i}"} for i in range(5)]))
    e.ingest_json(json.dumps([{"id": "2", "timestamp": BASE + 9 * day, "service": "s", "message": "alpha moved"}, {"id": "3", "timestamp": BASE, "service": "s", "message": "beta"}]))
    plans = lambda q: e.hits(q)._jdf.queryExecution().executedPlan().toString()
    text = plans(Query("alpha"))
    assert "EqualTo(term,alpha)" in text or "In(term, [alpha])" in text
    ranged = Query(from_time=BASE + 2 * day, to_time=BASE + 3 * day)
    assert "PartitionFilters: [isnotnull(day" in plans(ranged)
    every = {"alpha": ["0", "1", "2", "4"], "n2": [], "moved": ["2"], "beta": ["3"]}
    for word, ids in every.items():
        got = e.search(Query(word))
        assert sorted(r["id"] for r in got["logs"]) == ids and got["total_hits"] == len(ids)
        assert sorted(r.id for r in s.hits(e.logs(), Query(word)).collect()) == ids  # the same without the index
    assert e.search(ranged)["total_hits"] == 0 and e.search(Query(level="INFO", limit=2))["total_hits"] == 5
    assert [r["id"] for r in e.search(Query("alpha", limit=1, offset=1))["logs"]] == ["4"]
    assert e.search(Query("alpha", from_time=BASE + 4 * day))["total_hits"] == 2


def test_two_streams_into_one_engine(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "0.json").write_text(json.dumps({"id": k, "message": k}))
    e = SearchEngine(spark, f"file://{tmp_path}/logs")
    for k in "ab":
        streaming.ingest(streaming.read_lines(spark, str(tmp_path / k)), e, str(tmp_path / f"cp-{k}")).awaitTermination()
    assert e.logs().count() == 2


def test_command_line_shows_a_line(capsys):
    from cairn.__main__ import line

    assert line({"timestamp": 1_700_000_000_123_000_000, "level": "WARN", "service": "s", "id": "0123456789", "message": "m"}).endswith(".123 WARN  s [01234567] m")
