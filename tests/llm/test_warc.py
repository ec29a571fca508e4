import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from cairn.llm import warc as W


def record(i, body=b"<p>x</p>", kind="response"):
    return W.page_record(i, f"http://h/{i}", body, hashlib.sha1(body).hexdigest(), kind, None if kind == "response" else 9, None, "2024-01-01T00:00:00Z")


def read(data):
    recs, gaps = [], []
    for kind, at, x, y in W.read_records(io.BytesIO(data)):
        (recs if kind == "record" else gaps).append((at, x, y))
    return [int(h["x-page-id"]) for _, h, _ in recs], gaps


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_whole_and_damaged(pack):
    parts = [pack(record(i, bytes([65 + i]) * 3000)) for i in range(5)]
    assert read(b"".join(parts)) == ([0, 1, 2, 3, 4], [])
    bad = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) // 2
    bad[at] ^= 0xFF
    bad[at + 1] ^= 0xFF
    ids, gaps = read(bytes(bad))
    assert ids == [0, 2, 3, 4]
    assert [(a, b) for a, b, _ in gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]


def test_junk_cut_and_mixed():
    a, b = gzip.compress(record(1)), record(2)
    ids, gaps = read(b"junk WARC/1.0 \x1f\x8b\x08 no" + a + b + b"\x00\x00" + gzip.compress(record(3))[:-9])
    assert ids == [1, 2] and len(gaps) == 2
    assert read(b"") == ([], [])
    assert read(b"nothing here")[1][0][:2] == (0, 12)


def test_wrong_digest_is_quarantined():
    good = record(1, b"<p>hello</p>")
    ids, gaps = read(good.replace(b"hello", b"jello") + record(2))
    assert ids == [2] and gaps[0][:2] == (0, len(good)) and "digest" in gaps[0][2]


def test_spark_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "http://h/1", big), (5, "http://h/5", big), (3, None, big), (2, "http://h/2", "small"), (4, "http://h/4", "small"), (6, "u\r\nX: y", None), (None, "http://n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    m = W.write_archives(pages, f"file://{tmp_path}/w")
    got = W.read_archives(spark, m, payloads=True).collect()
    assert len(got) == 7 and all(r.reason is None for r in got)
    by = {r.page_id: r for r in got}
    assert by[5].record_type == "response" and by[5].refers_to is None and by[5].payload == big.encode()
    assert {(by[i].record_type, by[i].refers_to) for i in (1, 3, None)} == {("revisit", 5)}
    assert {by[i].record_type for i in (2, 4, 6)} == {"response"}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert by[3].url is None and by[6].url == "u  X: y"
    assert W.read_archives(spark, W.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_many_records_in_one_member():
    parts = [record(i, bytes([65 + i]) * 3000) for i in range(5)]
    assert read(gzip.compress(b"".join(parts))) == ([0, 1, 2, 3, 4], [])
    bad = parts[1].replace(b"BBB", b"BxB", 1)
    ids, gaps = read(gzip.compress(b"".join([parts[0], bad, *parts[2:]])) + gzip.compress(record(7)))
    assert ids == [0, 2, 3, 4, 7] and len(gaps) == 1 and "digest" in gaps[0][2]
    noise = [b"".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest().encode() for k in range(2000)) for i in range(9)]
    ids, gaps = read(gzip.compress(b"".join(record(i, x) for i, x in enumerate(noise)))[:-2000] + gzip.compress(record(70)) + record(71))
    assert ids == [*range(8), 70, 71] and len(gaps) == 1


def test_long_header_lines(spark, tmp_path):
    url = "http://h/" + "u" * 70_000
    pages = spark.createDataFrame([(1, url, "<p>x</p>")], "page_id long, url string, html string")
    got = W.read_archives(spark, W.write_archives(pages, f"file://{tmp_path}/w")).collect()
    assert [(r.page_id, r.url, r.reason) for r in got] == [(1, url, None)]
    head = W.encode_record([("WARC-Type", "metadata"), ("X-Long", "v" * 3_000_000)], b"")
    assert [k for k, *_ in W.read_records(io.BytesIO(head))] == ["record"]


def test_groups_over_the_broadcast_bound(spark, monkeypatch):
    big = "<p>é</p>" * 400
    pages = spark.createDataFrame([(i, f"http://h/{i}", big + str(i % 3)) for i in range(30)], "page_id long, url string, html string")
    want = sorted(W.with_revisits(pages).select("page_id", "kind", "refers_to").collect())
    monkeypatch.setattr(W, "BROADCAST_GROUPS", 1)
    assert sorted(W.with_revisits(pages).select("page_id", "kind", "refers_to").collect()) == want
    assert sum(k == "response" for _, k, _ in want) == 3
