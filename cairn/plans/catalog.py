"""Registered queries over the test tables, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, codec
from ..functions.durations import parse_interval
from ..functions.text import STOP_WORDS
from ..operators import filters, histogram, kv
from ..operators import search as s
from ..operators.search import Query
from ..sources import wal
from ..sources.json_ingest import completed, from_bodies, from_lines, split, to_json
from ..sources.views import document_logs, event_logs, event_mutations
from . import stats
from .engine import Engine, SearchEngine
from .files import scratch
from .storage import Options, Store

FLAT = ("id", "timestamp", "level", "service", "host", "message")

EVENTS = """e AS (SELECT event_id::VARCHAR AS id, epoch_us(ts) * 1000 AS timestamp, upper(event_type) AS level, 'user-' || user_id AS service, '' AS host,
    event_type || ' ' || props AS message, json_extract_string(props, '$.k') AS k FROM events)"""
DOCS = """d AS (SELECT doc_id::VARCHAR AS id, 1726830000000000000 + doc_id * 5000000000 AS timestamp, upper(lang) AS level, source AS service,
    'host-' || (doc_id % 10) AS host, text AS message, n_chars::VARCHAR AS n_chars FROM documents)"""
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
TOKENS = r"""t AS (SELECT *, list_distinct(list_filter(list_transform(regexp_split_to_array(message, '[^\p{L}\p{Nd}_-]+'),
    lambda w: lower(regexp_replace(w, '^[_-]+|[_-]+$', '', 'g'))), lambda w: octet_length(encode(w)) BETWEEN 2 AND 64 AND NOT list_contains(""" + STOP + """, w))) AS tokens FROM d)"""
KV = """m AS (SELECT user_id::VARCHAR AS key, CASE WHEN event_type <> 'error' THEN coalesce(props, '') END AS value, epoch_us(ts) * 1000 AS ts, event_id AS seq,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op FROM events),
    newest AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)"""
COLS = "id, timestamp, level, service, host, message"

QUERIES: dict = {}
ORACLES: dict = {}


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _kv_rows(df: DataFrame) -> DataFrame:
    return df.select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "ts", "seq")


# -- filters


@_query(f"WITH {EVENTS} SELECT {COLS} FROM e WHERE level = 'ERROR'")
def filter_level(spark: SparkSession, d: str) -> DataFrame:
    return event_logs(spark, d).where(filters.level_is("error")).select(*FLAT)


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE service = 'src3'")
def filter_service_cs(spark: SparkSession, d: str) -> DataFrame:
    return document_logs(spark, d).where(filters.service_is_exactly("src3")).select(*FLAT)


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE upper(host) = 'HOST-7'")
def filter_host_ci(spark: SparkSession, d: str) -> DataFrame:
    return document_logs(spark, d).where(filters.host_is("HOST-7")).select(*FLAT)


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE timestamp BETWEEN 1726830500000000000 AND 1726831000000000000")
def filter_time_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return document_logs(spark, d).where(filters.within(1726830500000000000, 1726831000000000000)).select(*FLAT)


@_query(f"WITH {EVENTS} SELECT {COLS} FROM e WHERE coalesce(k, '') = '7'")
def filter_field_eq(spark: SparkSession, d: str) -> DataFrame:
    return event_logs(spark, d).where(filters.fields_are({"k": "7", "absent": ""})).select(*FLAT)


# -- order and paging


@_query(f"WITH {EVENTS} SELECT {COLS} FROM e ORDER BY timestamp DESC, id LIMIT 50")
def page_newest(spark: SparkSession, d: str) -> DataFrame:
    return s.search(event_logs(spark, d), Query()).select(*FLAT)


@_query(f"WITH {EVENTS} SELECT {COLS} FROM e WHERE level = 'VIEW' ORDER BY timestamp DESC, id LIMIT 20 OFFSET 30")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return s.search(event_logs(spark, d), Query(level="view", limit=20, offset=30)).select(*FLAT)


@_query(f"WITH {EVENTS} SELECT count(*) AS total_hits FROM e WHERE level = 'CLICK'")
def total_hits(spark: SparkSession, d: str) -> DataFrame:
    return s.total_hits(event_logs(spark, d), Query(level="click"))


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE id = '42'")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return s.by_id(document_logs(spark, d), "42").select(*FLAT)


# -- histograms


@_query(f"WITH {EVENTS} SELECT timestamp // 3600000000000 * 3600000000000 AS bucket, level, count(*) AS count FROM e GROUP BY ALL")
def hist_1h_by_level(spark: SparkSession, d: str) -> DataFrame:
    return histogram.by_level(event_logs(spark, d), parse_interval("1h"))


@_query(f"WITH {EVENTS} SELECT timestamp // 420000000000 * 420000000000 AS bucket, count(*) AS count FROM e GROUP BY ALL")
def hist_7m(spark: SparkSession, d: str) -> DataFrame:
    return histogram.counts(event_logs(spark, d), parse_interval("7m"))


@_query(f"WITH {EVENTS}, n AS (SELECT * FROM e ORDER BY timestamp DESC, id LIMIT 700) SELECT timestamp // 3600000000000 * 3600000000000 AS bucket, count(*) AS count FROM n GROUP BY ALL")
def hist_capped(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the feature: a histogram of the newest hits only."""
    return histogram.counts(event_logs(spark, d), parse_interval("1h"), max_hits=700)


@_query(f"WITH {EVENTS}, c AS (SELECT timestamp // 86400000000000 * 86400000000000 AS bucket, count(*) AS count FROM e GROUP BY ALL) SELECT bucket, count, repeat('█', greatest(1, count * 40 // max(count) OVER ())::INTEGER) AS bar FROM c")
def hist_bars(spark: SparkSession, d: str) -> DataFrame:
    return histogram.bars(event_logs(spark, d), parse_interval("24h"))


@_query(f"WITH {EVENTS} SELECT count(*)::BIGINT AS total, 60000::BIGINT AS interval_ms FROM e")
def hist_total(spark: SparkSession, d: str) -> DataFrame:
    return histogram.total(event_logs(spark, d), parse_interval("bad"))


@_query(f"""WITH {EVENTS}, c AS (SELECT timestamp // 86400000000000 * 86400000000000 AS bucket, level, count(*) AS n FROM e GROUP BY ALL)
    SELECT bucket AS timestamp, sum(n)::BIGINT AS count, string_agg(level || '=' || n, ',' ORDER BY level) AS by_level FROM c GROUP BY bucket""")
def hist_nested(spark: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.map_entries("by_level")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return histogram.histogram(event_logs(spark, d), parse_interval("24h")).withColumn("by_level", text)


# -- tokens and postings


@_query(f"WITH {DOCS}, {TOKENS} SELECT unnest(tokens) AS term, timestamp AS ts, id FROM t")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return s.postings(document_logs(spark, d))


@_query(f"WITH {DOCS}, {TOKENS}, u AS (SELECT unnest(tokens) AS term FROM t) SELECT term, count(*) AS df FROM u GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return s.postings(document_logs(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@_query(f"WITH {DOCS}, {TOKENS} SELECT id, len(tokens)::INTEGER AS n_tokens FROM t")
def tokens_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return document_logs(spark, d).select("id", F.size(s.tokenize(F.col("message"))).alias("n_tokens"))


# -- search


@_query(f"WITH {DOCS}, {TOKENS} SELECT {COLS} FROM t WHERE list_contains(tokens, 'license') ORDER BY timestamp DESC, id LIMIT 50")
def search_one_term(spark: SparkSession, d: str) -> DataFrame:
    return s.search(document_logs(spark, d), Query("License")).select(*FLAT)


@_query(f"WITH {DOCS}, {TOKENS} SELECT {COLS} FROM t WHERE list_has_all(tokens, ['mit', 'license']) ORDER BY timestamp DESC, id LIMIT 10 OFFSET 2")
def search_and2(spark: SparkSession, d: str) -> DataFrame:
    return s.search(document_logs(spark, d), Query("the MIT license", limit=10, offset=2)).select(*FLAT)


@_query(f"WITH {DOCS}, {TOKENS} SELECT {COLS} FROM t WHERE list_has_all(tokens, ['un', 'por', 'los']) AND level = 'ES' AND timestamp >= 1726830500000000000 ORDER BY timestamp DESC, id LIMIT 50")
def search_and3_level_time(spark: SparkSession, d: str) -> DataFrame:
    return s.search(document_logs(spark, d), Query("un, por, los", level="es", from_time=1726830500000000000)).select(*FLAT)


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE level = 'FR' ORDER BY timestamp DESC, id LIMIT 50")
def search_stopwords_only(spark: SparkSession, d: str) -> DataFrame:
    return s.search(document_logs(spark, d), Query("the of a", level="fr")).select(*FLAT)


@_query(f"WITH {DOCS}, {TOKENS} SELECT {COLS} FROM t WHERE list_has_all(tokens, ['license', 'version']) ORDER BY timestamp DESC, id LIMIT 50")
def search_via_postings(spark: SparkSession, d: str) -> DataFrame:
    logs = document_logs(spark, d)
    return s.search(logs, Query("license version"), s.postings(logs)).select(*FLAT)


@_query(f"WITH {DOCS}, {TOKENS} SELECT {COLS} FROM t WHERE list_contains(tokens, 'this') AND upper(service) = 'SRC0' ORDER BY timestamp DESC, id LIMIT 50")
def search_service_mixed_case(spark: SparkSession, d: str) -> DataFrame:
    return s.search(document_logs(spark, d), Query("this", service="SRC0")).select(*FLAT)


@_query(f"WITH {DOCS} SELECT {COLS} FROM d WHERE service = 'src0' ORDER BY timestamp DESC, id LIMIT 50")
def search_service_alone(spark: SparkSession, d: str) -> DataFrame:
    """A service on its own is matched as it is written."""
    return s.search(document_logs(spark, d), Query(service="src0")).select(*FLAT)


@_query(f"""WITH {DOCS}, {TOKENS} SELECT id, timestamp, message FROM t WHERE id::BIGINT % 10 <> 0 AND list_has_all(tokens, ['license', 'version'])
    UNION ALL SELECT id, timestamp, 'license of a new version' FROM t WHERE id::BIGINT % 10 = 0""")
def search_engine_hits(spark: SparkSession, d: str) -> DataFrame:
    """An engine's postings and versions: every tenth log is ingested again with another message."""
    engine = SearchEngine(spark, f"{scratch(spark)}/logs")
    logs = document_logs(spark, d)
    engine.ingest(from_lines(to_json(logs.where("message <> ''"))), "first")
    engine.ingest(from_lines(to_json(logs.where("id % 10 = 0").withColumn("message", F.lit("license of a new version")))), "second")
    return engine.hits(Query("license version")).select("id", "timestamp", "message")


@_query(f"WITH {DOCS}, {TOKENS} SELECT count(*) AS total_hits FROM t WHERE list_has_any(tokens, ['gnu', 'apache'])")
def search_any_total(spark: SparkSession, d: str) -> DataFrame:
    return s.total_hits(document_logs(spark, d), Query("gnu apache", match="any"))


# -- key-value


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1")
def kv_current(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(kv.current(event_mutations(spark, d)))


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1 AND key = '17'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(kv.get(event_mutations(spark, d), b"17"))


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1 AND key BETWEEN '12' AND '20'")
def kv_scan_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(kv.scan(event_mutations(spark, d), b"12", b"20"))


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1 ORDER BY key LIMIT 100")
def kv_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(kv.scan(event_mutations(spark, d), limit=0))


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1 AND key >= '5'")
def kv_seek(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(kv.seek(event_mutations(spark, d), b"5"))


@_query(f"WITH {KV} SELECT key, ts, seq FROM newest WHERE op = 2")
def kv_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return kv.newest(event_mutations(spark, d)).where("op = 2").select(F.decode("key", "UTF-8").alias("key"), "ts", "seq")


@_query(f"WITH {KV} SELECT key, value, ts, seq FROM newest WHERE op = 1")
def kv_multiway_merge(spark: SparkSession, d: str) -> DataFrame:
    m = event_mutations(spark, d)
    parts = [m.where(c) for c in ("op = 2", "op = 1 and value like '%1%'", "op = 1 and value not like '%1%'")]
    return _kv_rows(kv.current(kv.merge(*parts, parts[0])))


# -- storage


def _store(spark: SparkSession, d: str, flushes: int, **options) -> Store:
    """A store with all event mutations, in flushes by time."""
    store = Store(spark, f"{scratch(spark)}/store", Options(**options))
    m = event_mutations(spark, d)
    lo, hi = m.agg(F.min("ts"), F.max("ts")).first()
    step = (hi - lo) // flushes + 1
    for i in range(flushes):
        store.flush(m.where((F.col("ts") >= lo + i * step) & (F.col("ts") < lo + (i + 1) * step)), f"b{i}")
    return store


@_query(ORACLES["kv_current"])
def kv_after_flush(spark: SparkSession, d: str) -> DataFrame:
    return _kv_rows(_store(spark, d, 3).current())


@_query(ORACLES["kv_current"])
def kv_after_compaction(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d, 4)
    store.compact_all()
    return _kv_rows(store.current())


@_query(f"WITH {KV} SELECT 1 AS level, count(*) FILTER (op = 1) AS entries FROM newest")
def level_sizes(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d, 4)
    store.compact_all()
    return stats.levels(store.tables()).select("level", "entries")


@_query(ORACLES["kv_get"])
def kv_store_get(spark: SparkSession, d: str) -> DataFrame:
    """A point read of a store with two levels: tables are pruned by key range, row groups by Bloom filter."""
    store = _store(spark, d, 3, l0_trigger=2)
    store.compact_all()
    store.flush(event_mutations(spark, d).where("key = encode('17', 'UTF-8')"))
    return _kv_rows(store.get(b"17"))


@_query(f"""WITH {KV}, n AS (SELECT count(*) FILTER (op = 1) AS live FROM newest) SELECT 4::BIGINT AS flushes, 1::BIGINT AS compactions, live AS entries,
    (SELECT count(*) FROM events) - live AS entries_dropped, true AS amplified, 1.0::DOUBLE AS space_amplification FROM n""")
def amplification(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a store after its first compaction: all of it lies below level 0, and was written twice."""
    store = _store(spark, d, 4)
    store.compact_all()
    g = stats.gauges(store)
    twice = g["write_amplification"] * g["logical_bytes"] == g["flush_bytes"] + g["compaction_bytes"] and g["compaction_read_bytes"] == g["flush_bytes"]
    row = (g["flushes"], g["compactions"], g["entries"], g["entries_dropped"], twice and g["write_amplification"] > 0, g["space_amplification"])
    return spark.createDataFrame([row], "flushes long, compactions long, entries long, entries_dropped long, amplified boolean, space_amplification double")


@_query(f"""WITH {KV}, r AS (SELECT ts // 86400000000000 AS table_id, min(key) AS lo, max(key) AS hi, count(*) AS entry_count FROM m GROUP BY 1)
    SELECT table_id, entry_count FROM r WHERE NOT (hi < '3' OR lo > '4')""")
def overlap_ranges(spark: SparkSession, d: str) -> DataFrame:
    m = event_mutations(spark, d).groupBy(F.expr("ts div 86400000000000L").alias("table_id"))
    tables = m.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("entry_count"))
    return stats.overlapping(tables, b"3", b"4").select("table_id", "entry_count")


@_query("SELECT sum(octet_length(encode(user_id::VARCHAR)) + coalesce(octet_length(encode(CASE WHEN event_type <> 'error' THEN coalesce(props, '') END)), 0) + 16)::BIGINT AS logical_bytes FROM events")
def logical_bytes(spark: SparkSession, d: str) -> DataFrame:
    return event_mutations(spark, d).agg(F.sum(codec.entry_size(F.col("key"), F.col("value"))).alias("logical_bytes"))


@_query("WITH x AS (SELECT floor(value)::BIGINT AS x FROM events WHERE value IS NOT NULL), s AS (SELECT list_sort(list(x)) AS l FROM x) SELECT l[len(l) * 500 // 1000 + 1] AS p50, l[len(l) * 950 // 1000 + 1] AS p95, l[len(l) * 990 // 1000 + 1] AS p99, l[len(l) * 999 // 1000 + 1] AS p99_9 FROM s")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").where("value is not null")
    return stats.latency_percentiles(e.select(F.floor("value").cast("long").alias("x")), "x")


# -- ingest and checks


@_query(f"WITH {EVENTS} SELECT id, timestamp, level, service, message FROM e")
def ingest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Logs to JSON lines and back through parsing, type checks and defaults."""
    valid, _ = split(from_lines(to_json(event_logs(spark, d))), now_ns=1)
    return valid.select("id", "timestamp", "level", "service", "message")


@_query(f"WITH {EVENTS} SELECT id, CASE WHEN id::BIGINT % 3 = 0 THEN 99 ELSE timestamp END AS timestamp, CASE WHEN id::BIGINT % 2 = 0 THEN 'INFO' ELSE level END AS level, CASE WHEN id::BIGINT % 5 = 0 THEN 'default' ELSE service END AS service FROM e")
def ingest_defaults(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("long")
    gaps = event_logs(spark, d).withColumns(
        {
            "timestamp": F.when(n % 3 == 0, 0).otherwise(F.col("timestamp")),
            "level": F.when(n % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.lower("level"), F.lit(" "))),
            "service": F.when(n % 5 != 0, F.col("service")),
        }
    )
    return completed(gaps, now_ns=99).select("id", "timestamp", "level", "service")


@_query(f"""WITH {EVENTS}, crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
        lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t), h AS (SELECT id, hex(encode(message)) AS h FROM e)
    SELECT id, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]::BIGINT)))::BIGINT AS crc FROM h, crc""")
def crc32_check(spark: SparkSession, d: str) -> DataFrame:
    return event_logs(spark, d).select("id", codec.checksum(F.encode("message", "UTF-8")).alias("crc"))


@_query("SELECT count(DISTINCT user_id) AS added, 0::BIGINT AS missed FROM events")
def bloom_no_false_negative(spark: SparkSession, d: str) -> DataFrame:
    keys = event_mutations(spark, d).select("key").distinct()
    bits, hashes = bloom.shape(100_000)
    told = bloom.might_contain(keys, "key", bloom.build(keys, "key", bits, hashes), bits, hashes)
    return told.agg(F.count(F.lit(1)).alias("added"), F.sum((~F.col("maybe")).cast("long")).alias("missed"))


@_query("SELECT count(*) AS probes, true AS rare FROM events")
def bloom_false_positives(spark: SparkSession, d: str) -> DataFrame:
    """As many absent keys as present ones: at most 3% may be taken for present, at a design rate of 1%."""
    e = spark.read.parquet(f"{d}/events.parquet")
    keys = e.select(F.concat(F.lit("item_key_"), "event_id").alias("key"))
    bits, hashes = bloom.shape(keys.count(), 0.01)
    absent = e.select(F.concat(F.lit("absent_item_"), "event_id").alias("key"))
    told = bloom.might_contain(absent, "key", bloom.build(keys, "key", bits, hashes), bits, hashes)
    return told.agg(F.count(F.lit(1)).alias("probes"), (F.avg(F.col("maybe").cast("double")) <= 0.03).alias("rare"))


@_query("""SELECT 'e' || event_id AS id, '' AS error FROM events WHERE event_id % 5 <> 3
    UNION ALL SELECT 'f' || event_id, '' FROM events WHERE event_id % 5 = 1
    UNION ALL SELECT '', 'message is empty' FROM events WHERE event_id % 5 = 0
    UNION ALL SELECT 'e' || event_id, 'fields: wrong type' FROM events WHERE event_id % 5 = 3
    UNION ALL SELECT '', 'not a JSON object' FROM events WHERE event_id % 5 = 4""")
def ingest_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies of each kind: arrays, an object per line, one object on several lines, wrong types, arrays with null."""
    n = F.col("event_id")
    one = lambda c: F.concat(F.lit('{"id":"' + c), n, F.lit('","message":"m"}'))
    body = (
        F.when(n % 5 == 0, F.concat(F.lit("["), one("e"), F.lit(',{"message":""}]')))
        .when(n % 5 == 1, F.concat(one("e"), F.lit("\n\n"), one("f"), F.lit("\n")))
        .when(n % 5 == 2, F.concat(F.lit('{\n  "id": "e'), n, F.lit('",\n  "message": "m"\n}')))
        .when(n % 5 == 3, F.concat(F.lit('{"id":"e'), n, F.lit('","message":"m","fields":{"a":1}}')))
        .otherwise(F.concat(F.lit("[null,"), one("e"), F.lit("]")))
    )
    got = from_bodies(spark.read.parquet(f"{d}/events.parquet").select(body.alias("value")))
    return got.select(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("error", F.lit("")).alias("error"))


# -- mutation logs


def _wal(spark: SparkSession, d: str, segments: int) -> str:
    """A folder of log segments with all event mutations, dealt by sequence number."""
    folder = f"{scratch(spark)}/wal"
    m = event_mutations(spark, d)
    for i in range(segments):
        wal.write_wal(m.where(F.col("seq") % segments == i).coalesce(1), folder, i + 1)
    return folder


@_query(f"WITH {KV} SELECT key, coalesce(value, '') AS value, ts, op::TINYINT AS op FROM m")
def wal_frames(spark: SparkSession, d: str) -> DataFrame:
    """Mutations to framed segments and back."""
    rows = wal.read_wal(spark, _wal(spark, d, 2))
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.coalesce(F.decode("value", "UTF-8"), F.lit("")).alias("value"), "ts", "op")


@_query(f"WITH {KV} SELECT key, value, ts FROM newest WHERE op = 1")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """The state of an engine that recovers twice, a segment more the second time."""
    folder, engine = _wal(spark, d, 3), Engine(spark, f"{scratch(spark)}/kv")
    engine.recover(folder, "*000001.log")
    engine.recover(folder)
    return _kv_rows(engine.store.current()).select("key", "value", "ts")


@_query("""SELECT event_id % 3 + 1 AS segment, count(*) AS valid_records, event_id % 3 > 0 AS corruption_detected,
    CASE event_id % 3 WHEN 1 THEN 'truncated_tail' WHEN 2 THEN 'bad_length' END AS corruption_type, event_id % 3 > 0 AS file_truncated FROM events GROUP BY event_id % 3""")
def wal_report(spark: SparkSession, d: str) -> DataFrame:
    """Three segments: a whole one, one with half a header at its end, one whose last header claims too much."""
    from pyarrow import fs

    folder = _wal(spark, d, 3)
    for segment, tail in ((2, b"\x00\x00\x00\x01"), (3, b"\x00\x00\x00\x01\xff\xff\xff\xff")):
        where, name = fs.FileSystem.from_uri(f"{folder}/wal_{segment:06d}.log")
        with where.open_append_stream(name) as out:
            out.write(tail)
    report = wal.recovery_report(spark, folder)
    segment = F.regexp_extract("path", r"(\d+)\.log$", 1).cast("long").alias("segment")
    return report.select(segment, "valid_records", "corruption_detected", "corruption_type", "file_truncated")
