import base64
import hashlib

import pytest

from strataloom.llm import warc
from strataloom.llm.common import new_path


def back(spark, pages, **options):
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, **options)
    return warc.read_archives(spark, path).collect()


def test_round_trip_with_segments(spark):
    big = "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a/3", "x"), (1, "http://a/1\n", "x"), (2, None, None), (5, "u", ""), (6, "u", big), (7, "u", big), (None, "u", "x"), (8, "u", "y"), (8, "u", "y")]
    pages = spark.createDataFrame([(*r, r[0]) for r in rows], "page_id long, url string, html string, digest long")
    got = back(spark, pages, segment_bytes=4096, file_records=7)
    assert len(got) == len(rows)
    html = {(i, t or "") for i, _, t in rows}
    for r in got:
        raw = next(t for i, t in html if i == r.page_id).encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kind == {(3, "revisit", 1), (1, "response", None), (2, "response", None), (5, "revisit", 2), (6, "response", None), (7, "revisit", 6), (None, "revisit", 1), (8, "response", None)}
    small = back(spark, pages, min_bytes=2)
    assert sum(r.record_type == "revisit" for r in small) == 1


def test_query_matches_pages(spark, sf):
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    rows = warc.op1_warc(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        i = first[pages[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if i == r.page_id else ("revisit", i))


def test_missing_segment_fails(spark, tmp_path):
    records = warc.page_records(1, "u", b"z" * 20_000, warc.base32_sha1(b"z" * 20_000), None, True, "1", 4096)
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.warc").write_bytes(b"".join(r + warc.END for r in records[::-1]))
    assert bytes(warc.read_archives(spark, f"file://{tmp_path}/whole").collect()[0].payload) == b"z" * 20_000
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "a.warc").write_bytes(b"".join(r + warc.END for r in records[:2] + records[3:]))
    with pytest.raises(Exception, match="missing or repeated"):
        warc.read_archives(spark, f"file://{tmp_path}/part").collect()


def test_chunked_framing():
    body = bytes(range(256)) * 100
    assert warc.unchunked(warc.chunked(body, 1000)) == body and warc.unchunked(warc.chunked(b"")) == b""
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_empty_table(spark):
    assert back(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []
