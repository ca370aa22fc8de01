"""Archives: what is written is read back, whatever payloads hold."""

import gzip
import hashlib
import os

import pytest

from conformix.llm import warc

LONG = "<p>" + "payload ä " * 20 + "</p>"
TRICKY = LONG + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a.example/x?y=1#z", LONG), (2, "http://b.example", LONG), (3, None, LONG), (4, "http://a.example/x?y=1#z", None), (5, "u", ""), (6, "evil\r\nWARC-Type: x ", TRICKY),
    (7, "http://c", "short"), (8, "http://d", "short"), (9, "http://e", TRICKY), (10, "http://f", "x" * 99), (11, "http://g", "x" * 99), (12, "http://h", "x" * 100), (13, "http://i", "x" * 100),
    (14, "http://j", "\r\n\r\n" * 40), (15, "http://k", "tail\r\n" + "y" * 200 + "\r\n"), (None, "http://l", LONG), (None, "http://m", "only null keys " * 10), (1, "http://a.example/x?y=1#z", LONG), (2, "http://b.example", LONG), (16, "http://n", "\u0000\u0001 control " * 20),
]
SCHEMA = "page_id long, url string, html string, record_type int, refers_to string"


def frame(spark, pages=PAGES):
    return spark.createDataFrame([(*p, 1, "x") for p in pages], SCHEMA).repartition(3)


def brute(pages):
    low, out = {}, []
    for i, _, h in pages:
        if i is not None:
            low[h or ""] = min(low.get(h or "", i), i)
    for i, _, h in pages:
        b, first = (h or "").encode(), low.get(h or "")
        again = len(b) >= 100 and first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    out = warc.round_trip(frame(spark))
    assert sorted((tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == brute(PAGES)
    assert out.where("digest_ok = false OR size(request) <> 1 OR size(metadata) <> 1").count() == 0
    assert out.where("record_type = 'response' AND digest_ok IS NULL").count() == 0


def test_nested_captures_carry_payloads(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write(frame(spark), path)
    got = {r["page_id"]: r for r in warc.captures(spark, path).where("record_type = 'response'").collect()}
    assert bytes(got[6]["response"]["payload"]).decode() == TRICKY and bytes(got[14]["response"]["payload"]).decode() == "\r\n\r\n" * 40
    assert got[1]["request"][0]["block_headers"]["host"] == "a.example" and got[1]["response"]["status"] == "200"
    assert got[6]["url"] == "evil%0D%0AWARC-Type: x%20"
    lines = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz"))
    assert lines.count(b"WARC-Profile: ") == sum(r[3] == "revisit" for r in brute(PAGES))


def test_foreign_archive_with_members_folded_lines_and_other_kinds(spark, tmp_path):
    def record(kind, ident, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + ident, *more, b"Content-Length: %d" % len(block)]
        return gzip.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"Content-Type: application/http"
    parts = [
        record(b"warcinfo", b"<i>", b"software: x\r\n", b"Content-Type: application/warc-fields"),
        record(b"response", b"<r>", b"HTTP/1.1 404 Not Found\r\nX: 1\r\n 2\r\n\r\nbody", http, b"WARC-Target-URI: http://z"),
        record(b"metadata", b"<m>", b"page-id: 5\r\n", b"Content-Type: application/warc-fields", b"WARC-Concurrent-To: <r>"),
        record(b"request", b"<q>", b"GET / HTTP/1.1\r\n\r\n", http, b"WARC-Concurrent-To: <r>"),
        record(b"revisit", b"<v>", b"HTTP/1.1 200 OK\r\n\r\n", http, b"WARC-Payload-Digest: sha256:00"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    got = {r["record_type"]: r for r in warc.resolved(warc.captures(spark, str(tmp_path))).collect()}
    r = got["response"]
    assert (r["page_id"], r["response"]["status"], bytes(r["response"]["payload"]), r["response"]["block_headers"]["x"], len(r["request"])) == (5, "404", b"body", "1 2", 1)
    assert (got["revisit"]["payload_digest"], got["revisit"]["refers_to"], got["revisit"]["payload_bytes"], got["revisit"]["page_id"]) == ("00", None, None, None)


def test_empty_table_and_broken_archive(spark, tmp_path):
    assert warc.round_trip(frame(spark, [])).count() == 0
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"no archive\r\n\r\nat all\r\n\r\n"))
    with pytest.raises(Exception, match="no record begins"):
        warc.records(spark, str(tmp_path)).collect()
