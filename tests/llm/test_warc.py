"""Archives: round trips, pieces of payloads that look like records, and transactions."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestitch.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) by the definition."""
    out, by_payload = [], {}
    for i, _, html in pages:
        by_payload.setdefault((html or "").encode(), []).append(i)
    for body, ids in by_payload.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out += [(i, len(body), digest, "revisit" if k else "response", ids[0] if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def round_trip(spark, folder, pages, **more):
    df = spark.createDataFrame([(*p, "clash") for p in pages], SCHEMA).repartition(3)
    W.write_archive(df, folder, **more)
    index = W.index_archive(W.read_records(spark, folder))
    captures = W.assemble(index)
    assert captures.count() == len(pages) and W.unclaimed(index, captures).count() == 0
    assert captures.where("requests <> 1 or metadatas <> 1 or request is null or not response.whole").count() == 0
    found = W.resolve(captures)
    assert found.where("not sound").count() == 0
    return sorted((tuple(r)[:6] for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri").collect()), key=str)


NASTY = [
    "", "\r\n", "\r\n\r\n", "a\r\n\r\n", "\r\n\r\n\r\n", W.BETWEEN, f"x{W.BETWEEN}", f"{W.BETWEEN}1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok",
    f"{W.BETWEEN}{W.BETWEEN}y", "Content-Length: 3\r\n\r\nabc", "é中\x00\x1f", "HTTP/1.1 200 OK\r\n\r\n", "\r\n\r\nWARC/1", "WARC/1.1\r\n\r\n",
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("split", [None, "150b"])
def test_payloads_of_any_kind_come_back(spark, tmp_path, compression, split):
    pages = [(i, f"http://h{i}.org/a b?q={i}#f" if i % 3 else None, html) for i, html in enumerate(NASTY * 2)]
    pages += [(100, "http://x.org", None), (None, "http://x.org", "only"), (None, "http://x.org", "only"), (7, "u", "only"), (7, "u", "only"), (200, "http://l.org", "long " * 100_000)]
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        pages = pages[:-1]
    try:
        found = round_trip(spark, str(tmp_path / "a"), pages, compression=compression)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[:5] for r in found] == brute(pages)


def test_many_names_of_marked_files_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "MOST_FILTERED", 0)
    pages = [(i, "http://a.org/", html) for i, html in enumerate(NASTY)]
    assert [r[:5] for r in round_trip(spark, str(tmp_path / "a"), pages)] == brute(pages)


def test_one_payload_may_hold_most_rows(spark, tmp_path):
    pages = [(i, f"http://a.org/{i}", "same" if i % 3 else f"own {i}") for i in range(600)]
    found = round_trip(spark, str(tmp_path / "a"), pages)
    assert [r[:5] for r in found] == brute(pages) and {r[5] for r in found} == {p[1] for p in pages}


def test_empty_table_and_small_payloads(spark, tmp_path):
    assert round_trip(spark, str(tmp_path / "none"), []) == []
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    found = round_trip(spark, str(tmp_path / "b"), pages, least_revisit_bytes=3)
    assert [(r[0], r[3], r[4]) for r in found] == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def record(kind, name, body, *headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"warc-record-id: <{name}>", *headers, f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Version 1.0, a gzip member per record, binary payloads, links in every direction, strays."""
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    to = lambda *names: [f"WARC-Concurrent-To: <{n}>" for n in names]
    web = "Content-Type: application/http; msgtype=response"
    records = [
        record("warcinfo", "info", b"software: x\r\n"),
        record("response", "r1", http + b"\xff\xfe\x00body", web, "WARC-Target-URI: http://a.org/"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http", *to("r1")),
        record("metadata", "m1", b"id: 5\r\n", *to("q1")),
        record("metadata", "m0", b"id: 6\r\n", *to("r1")),
        record("request", "q2", b"GET /2 HTTP/1.1\r\n\r\n", "Content-Type: application/http"),
        record("response", "r2", http, web, *to("q2", "m2")),
        record("metadata", "m2", b"id: 7\r\n"),
        record("request", "q3", b"GET /3 HTTP/1.1\r\n\r\n", *to("gone")),
        record("revisit", "r3", http, web, "WARC-Refers-To: <lost>", "WARC-Payload-Digest: sha1:ABC"),
        record("resource", "s1", b"plain"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    read = W.read_records(spark, str(tmp_path / "w"))
    payload = {r.record_id: bytes(r.payload) for r in W.with_payload(read).collect()}
    assert payload["<r1>"] == b"\xff\xfe\x00body" and payload["<r2>"] == b"" and payload["<s1>"] == b"plain"
    index = W.index_archive(read)
    captures = W.assemble(index)
    found = {r.record_id: r for r in captures.collect()}
    assert set(found) == {"<r1>", "<r2>", "<r3>", "<s1>"}
    assert (found["<r1>"].request.record_id, found["<r1>"].metadata.record_id, found["<r1>"].metadatas) == ("<q1>", "<m0>", 2)
    assert (found["<r2>"].request.record_id, found["<r2>"].metadata.record_id) == ("<q2>", "<m2>")
    assert found["<r3>"].request is None and found["<r3>"].requests == 0
    assert {r.record_id for r in W.unclaimed(index, captures).collect()} == {"<info>", "<m1>", "<q3>"}
    resolved = {r.payload_digest: r for r in W.resolve(captures).collect()}
    assert (resolved["ABC"].payload_bytes, resolved["ABC"].refers_to, resolved["ABC"].sound) == (None, None, False)


def test_base32_of_digests(spark):
    for text in ("", "a", "zz"):
        (r,) = spark.sql(f"select '{text}' as t").select(W.base32(F.sha1(F.col("t").cast("binary"))).alias("d")).collect()
        assert r.d == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
