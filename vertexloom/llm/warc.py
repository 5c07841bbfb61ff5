"""WARC archives of web pages: writing, reading back, and assembling transactions.

Every page becomes three records, a request, a response (or a revisit of an equal payload) and metadata; the request and
the metadata name the response through WARC-Concurrent-To. Archives are written by Spark's own committed text output, so
a task that is tried again leaves no second copy, gzipped, at most RECORDS_PER_FILE pages to a file. They are read by
streaming through each file, never holding more than one record.

Which payloads repeat comes from an aggregate over their digests, so a payload that a third of all pages share moves as
partial maxima. Its table of repeated digests is broadcast if it is counted to be small, and joined by shuffle otherwise.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm._common import checkpoint

LEAST_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 20_000
#: Rows of repeated digests that may be broadcast, some 100 bytes each.
BROADCAST_ROWS = 50_000
DATE = "2026-01-01T00:00:00Z"
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, row: Column) -> Column:
    hexes = F.md5(F.concat(F.lit(kind + ":"), row.cast("string")))
    parts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, empty where the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(END)), F.lit(""))


def _record(kind: Column, record_id: Column, content_type: Column, block: Column, *headers: Column) -> Column:
    return F.concat(
        F.lit("WARC/1.1" + END), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(DATE)), *headers,
        _line("Content-Type", content_type), _line("Content-Length", F.octet_length(block)), F.lit(END), block,
    )


def with_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Adds row, payload (no null), payload_digest, payload_bytes, and original_row and refers_to of revisits (else null).

    Of equal payloads of LEAST_REVISIT_BYTES or more the row of largest id is the response; nulls are smallest, and of
    rows that repeat the id the first is. `pages` has to be read the same way twice, as a table's scan is.
    """
    rows = pages.withColumn("row", F.monotonically_increasing_id()).withColumn("payload", F.coalesce(F.col(html_col), F.lit("")))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT_BYTES)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max(F.struct(F.col(id_col), -F.col("row"))).alias("last"))
    repeated = checkpoint(groups.where("n > 1").select("payload_digest", "payload_bytes", (-F.col("last.col2")).alias("original_row"), F.col(f"last.{id_col}").alias("refers_to")))
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated.hint("shuffle_hash")
    joined = rows.join(repeated, ["payload_digest", "payload_bytes"], "left")
    again = F.col("original_row") != F.col("row")
    return joined.withColumns({"refers_to": F.when(again, F.col("refers_to")), "original_row": F.when(again, F.col("original_row"))})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes the records of every page to gzipped WARC files under `path`."""
    rows = with_revisits(pages.select(id_col, url_col, html_col), id_col, html_col)
    url = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20")
    again = F.col("original_row").isNotNull()
    response = _urn("response", F.col("row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    get = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(url, r"^[^/]*//[^/?#]*|#.*$", ""), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(url, r"//([^/?#]*)", 1), F.lit("")), F.lit(END + END))
    target, partner = _line("WARC-Target-URI", url), _line("WARC-Concurrent-To", response)
    fields = F.concat(_line("pageId", F.col(id_col)), _line("payloadBytes", F.col("payload_bytes")))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    revisit = [_line("WARC-Refers-To", F.when(again, _urn("response", F.col("original_row")))), _line("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE)))]
    kind = F.when(again, "revisit").otherwise("response")
    records = F.concat_ws(
        END + END,
        _record(F.lit("request"), _urn("request", F.col("row")), F.lit("application/http; msgtype=request"), get, target, partner),
        _record(kind, response, F.lit("application/http; msgtype=response"), F.when(again, http).otherwise(F.concat(http, F.col("payload"))), target, digest, *revisit),
        _record(F.lit("metadata"), _urn("metadata", F.col("row")), F.lit("application/warc-fields"), fields, target, partner),
    )
    rows.select(records).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _open(path: str) -> BinaryIO:
    if path.startswith("file:"):
        from urllib.parse import unquote

        return open(unquote("/" + path[5:].lstrip("/")), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name)


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an unpacked archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("an archive ends inside a record")
        yield headers, block


def http_body(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name and body of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under `path`.

    payload_bytes and payload_digest are those of the body of a response; a revisit has them from its headers. fields
    holds a metadata record's. payload is null where payloads is False, and for all but responses.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path")
    schema = pa.schema([
        ("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ])

    def rows_of(name: str) -> Iterator[tuple]:
        with _open(name) as packed, gzip.open(packed) as stream:
            for headers, block in records_of(stream):
                kind, digest, size, fields, payload = headers["warc-type"], None, None, None, None
                if kind == "response":
                    _, body = http_body(block)
                    digest, size, payload = hashlib.sha1(body).hexdigest(), len(body), body if payloads else None
                elif kind == "revisit":
                    digest, size = headers["warc-payload-digest"].partition(":")[2], int(http_body(block)[0]["content-length"])
                elif kind == "metadata":
                    fields = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n")) if n]
                yield kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, size, fields, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(name):
                    held.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.mapInArrow(run, "kind string, record_id string, concurrent_to string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, fields map<string,string>, payload binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, record_type, request, response, metadata).

    A capture is a response or revisit record; its request and metadata are those whose concurrent-to names it, the one
    of least record id if several do, null if none does. Records that name no capture belong to none.
    """
    partner = F.struct("record_id", "target_uri", "fields")
    side = {}
    for kind in ("request", "metadata"):
        own = records.where((F.col("kind") == kind) & F.col("concurrent_to").isNotNull())
        side[kind] = own.groupBy(F.col("concurrent_to").alias(f"of_{kind}")).agg(F.min_by(partner, F.col("record_id")).alias(kind))
    captures = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.col("kind").alias("record_type"),
        F.struct("target_uri", "payload_digest", "payload_bytes", "refers_to_id", "payload").alias("response"),
    )
    for kind, frame in side.items():
        captures = captures.join(frame, captures["capture_id"] == frame[f"of_{kind}"], "left").drop(f"of_{kind}")
    return captures.select("capture_id", "record_type", "request", "response", "metadata")


def page_digests(pages: DataFrame, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, through archives under `path`.

    A null html is an empty payload, a null url leaves the target out, a null page_id stays null; repeated rows have
    records of their own each. Other columns of pages aren't read. Without pages there are no rows.
    """
    write_archives(pages, path)
    captures = assemble(read_records(pages.sparkSession, path, payloads=False))
    flat = checkpoint(captures.select(
        "capture_id", F.element_at("metadata.fields", "pageId").cast("long").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        "record_type", F.col("response.refers_to_id").alias("refers_to_id"),
    ))
    originals = flat.where("record_type = 'response'").select(F.col("capture_id").alias("original_id"), F.col("page_id").alias("refers_to"))
    return flat.join(originals, flat["refers_to_id"] == originals["original_id"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (
  SELECT *, max(page_id) OVER w AS last, row_number() OVER (w ORDER BY page_id DESC NULLS LAST) > 1 AND payload_bytes >= {LEAST_REVISIT_BYTES} AS again
  FROM d WINDOW w AS (PARTITION BY payload_digest, payload_bytes))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM g
"""
