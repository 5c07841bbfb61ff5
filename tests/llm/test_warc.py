import gzip
import hashlib

import duckdb
import pytest

from vertexloom.llm import warc
from vertexloom.llm._common import scratch_path

LONG = "é" * 600
ROWS = [
    (1, "http://a.example/x?y=1#z", "<p>" + LONG), (2, "http://b.example", "<p>" + LONG), (9, None, "<p>" + LONG), (None, "http://n.example/", "<p>" + LONG),
    (3, "http://a.example/ a\r\nb", "short"), (4, "http://a.example/s", "short"), (5, "", None), (6, "u", ""), (7, "http://c.example/", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nx: y\r\n\r\n" * 50),
    (8, "http://c.example/big", "x" * 3_000_000), (10, "http://t.example", "y" * 1000), (10, "http://t.example", "y" * 1000), (11, "http://u.example", "z" * 999), (12, "http://u.example", "z" * 999),
]
SCHEMA = "page_id long, url string, html string, row int, payload string, refers_to long"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "clash", 5) for r in ROWS], SCHEMA)


@pytest.mark.parametrize("broadcast_rows", [warc.BROADCAST_ROWS, 0])
def test_digests(spark, pages, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    got = warc.page_digests(pages, scratch_path(spark, "warc")).collect()
    assert got[0].__fields__ == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    raw = {}
    for i, _, html in ROWS:
        raw.setdefault(i, (html or "").encode())
    assert sorted(str(r.page_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    kinds = {}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(raw[r.page_id]), hashlib.sha1(raw[r.page_id]).hexdigest())
        kinds.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kinds[1] == kinds[2] == kinds[None] == [("revisit", 9)]
    assert sorted(kinds.pop(10)) == [("response", None), ("revisit", 10)]
    assert all(kinds[i] == [("response", None)] for i in (9, 3, 4, 5, 6, 7, 8, 11, 12))


def test_sql(spark, pages):
    unique = pages.where("page_id is not null and page_id <> 10")
    c = duckdb.connect()
    table = unique.toArrow()
    c.register("pages", table)
    expected = sorted(map(str, c.sql(warc.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in warc.page_digests(unique, scratch_path(spark, "warc")).collect()) == expected


def test_sql_on_repeated_rows_and_null_ids(spark, pages):
    c = duckdb.connect()
    c.register("pages", pages.toArrow())
    expected = sorted(map(str, c.sql(warc.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in warc.page_digests(pages, scratch_path(spark, "warc")).collect()) == expected


def test_transactions_and_archives(spark, pages, tmp_path):
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path)
    kinds = {}
    for file in (tmp_path / "archives").glob("*.gz"):
        with gzip.open(file) as stream:
            for headers, _ in warc.records_of(stream):
                kinds[headers["warc-record-id"]] = headers["warc-type"]
    assert len(kinds) == 3 * len(ROWS)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.request is not None and "pageId" in r.metadata.fields or r.response.payload_bytes
        if r.record_type == "response":
            assert hashlib.sha1(r.response.payload).hexdigest() == r.response.payload_digest
        else:
            assert r.response.payload is None and kinds[r.response.refers_to_id] == "response"
    big = next(r for r in rows if r.response.payload_bytes == 3_000_000)
    assert bytes(big.response.payload) == b"x" * 3_000_000


def test_partners_missing_or_repeated(spark):
    schema = "kind string, record_id string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary"
    rows = [("response", "a", None, None, "u", "d", 1, None, b"x"), ("request", "c", "a", None, None, None, None, None, None), ("request", "b", "a", None, None, None, None, None, None), ("metadata", "m", None, None, None, None, None, None, None), ("metadata", "n", "gone", None, None, None, None, None, None)]
    got = warc.assemble(spark.createDataFrame(rows, schema)).collect()
    assert [(r.capture_id, r.request.record_id, r.metadata) for r in got] == [("a", "b", None)]


def test_empty(spark, pages):
    assert warc.page_digests(pages.limit(0), scratch_path(spark, "warc")).count() == 0


def test_broken_archive(tmp_path):
    (tmp_path / "x").write_bytes(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")
    with open(tmp_path / "x", "rb") as stream, pytest.raises(ValueError):
        list(warc.records_of(stream))
