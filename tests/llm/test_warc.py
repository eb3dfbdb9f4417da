import base64
import hashlib
import io

import zlib

from cairn.llm import warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGES = [
    (1, "http://a.example/x?q=1 2", "hello", "x"),
    (2, "http://b.example/", "hello", "x"),
    (3, None, None, "x"),
    (4, "http://c.example/\r\nX: y", "", "x"),
    (5, "u", "ünï" * 200_000, "x"),
    (6, "u", "one of a kind\r\n\r\nWARC/1.1\r\n", "x"),
    (6, "u", "one of a kind\r\n\r\nWARC/1.1\r\n", "x"),
    (None, "u", "no id", "x"),
    (9, "u", "hello", "x"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_id string")


def test_round_trip(spark, tmp_path):
    manifest = warc.write_archives(pages(spark), f"file://{tmp_path}/w", chunk=1000, archive_bytes=2000)
    rows = warc.read_archives(manifest, chunk=777).collect()
    assert manifest.count() > 1 and sum(r.records for r in manifest.collect()) == len(PAGES)
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    heads = {}
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        heads[data] = max([x for x in (heads.get(data), i) if x is not None], default=None)
    for i, _, html, _ in PAGES:
        data, got = (html or "").encode(), sorted(by[None if i is None else str(i)], key=lambda r: r.chunk_no)
        last = [r for r in got if r.is_last][0]
        assert last.payload_bytes == len(data) and last.running_digest == b32(data)
        if heads[data] == i:
            assert last.record_type == "response" and last.refers_to is None and last.digest_ok
            if i != 6:
                assert b"".join(bytes(r.data) for r in got) == data
                assert [r.chunk_offset for r in got] == [777 * k for k in range(len(got))]
                for r in got:
                    assert len(r.data) <= 777 and r.running_digest == b32(data[: r.chunk_offset + len(r.data)])
        else:
            assert last.record_type == "revisit" and last.refers_to == str(heads[data]) and len(got) == 1
    assert len([r for r in rows if r.record_id == "6" and r.is_last and r.record_type == "response"]) == 2


def test_small_payloads_are_not_revisited(spark, tmp_path):
    manifest = warc.write_archives(pages(spark), f"file://{tmp_path}/w", min_bytes=6)
    assert warc.read_archives(manifest, with_data=False).where("record_type = 'revisit'").count() == 0


def test_empty_table(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, []), f"file://{tmp_path}/w")
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_plain_and_truncated_archives():
    block = b"HTTP/1.1 200 OK\r\n\r\npayload"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:7>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    got = list(warc.records(io.BytesIO(record * 2)))
    assert [(r[0], r[5], r[7]) for r in got] == [("7", b"payload", True)] * 2
    packed = zlib.compressobj(wbits=31)
    data = packed.compress(record) + packed.flush()
    assert list(warc.records(io.BytesIO(data + data))) == got
    try:
        list(warc.records(io.BytesIO(record[:-8])))
        raise AssertionError
    except EOFError:
        pass


def test_a_revisit_with_a_block_is_skipped():
    head = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n"
    body = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    revisit = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:record:8>\r\nWARC-Refers-To: <urn:record:7>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(head + body) + head + body + b"\r\n\r\n"
    got = [(r[0], r[1], r[2], r[8]) for r in warc.records(io.BytesIO(revisit * 2))]
    assert got == [("8", "revisit", "7", 9)] * 2


def test_the_query_cuts_pages_into_chunks(spark):
    got = warc.op1_warc_chunks(spark, "/root/testdata/sf0.001")
    assert got.where("record_type = 'response' and chunks > 1").count() > 0
    assert got.where(f"record_type = 'response' and chunks <> greatest(1, ceil(payload_bytes / {warc.PAGE_CHUNK}))").count() == 0


def test_names_are_of_one_attempt(spark, tmp_path):
    a, b = (warc.write_archives(pages(spark), f"file://{tmp_path}/{k}") for k in "xy")
    assert all(r.path.endswith(".warc.gz") and len(r.path.rsplit("/", 1)[1].split("-")) == 4 for r in a.collect())
    assert sorted(map(str, warc.read_archives(a).collect())) == sorted(map(str, warc.read_archives(b).collect()))
