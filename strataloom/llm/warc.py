"""WARC archives: writing records with revisits and segments, reading them back whole."""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, new_path, table

SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32 << 10, 8 << 10, 4096
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = "origin string, segment int, total long, fields map<string,string>, block binary"
READ = "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in HTTP's chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are allowed; broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, is_response: bool, ident: str, segment_bytes: int) -> list[bytes]:
    """The records of a page: a revisit, or a response in as many segments as its size asks for."""
    uri = f"urn:x-page:{ident}"
    fields = [("WARC-Record-ID", f"<{uri}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("X-Page-Id", str(page_id))] if page_id is not None else []
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if not is_response:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(first))]
        return [record([("WARC-Type", "revisit"), *fields, ("Content-Type", "application/http; msgtype=response")], http.encode() + f"Content-Length: {len(payload)}".encode() + END)]
    if len(payload) > CHUNK_BYTES:
        block = http.encode() + b"Transfer-Encoding: chunked" + END + chunked(payload)
    else:
        block = http.encode() + f"Content-Length: {len(payload)}".encode() + END + payload
    fields = [("WARC-Type", "response"), *fields, ("Content-Type", "application/http; msgtype=response")]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uri}:{n}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", one_line(url)), ("WARC-Segment-Origin-ID", f"<{uri}>"), ("WARC-Segment-Number", str(n))]
        out.append(record(own + ([("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []), part))
    return out


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files below path, by Spark's writer and its commit protocol.

    Equal payloads are found by digest: the smallest page_id per digest comes from a partially
    aggregated count, and only digests met twice are joined back, so a hot payload is split by
    adaptive execution. Rows that share the smallest page_id are all responses. Where no page_id of
    a payload is set, all its rows are responses. A file holds file_records records at most.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = base.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    joined = base.join(repeated, "digest", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        for b in batches:
            out: list[bytes] = []
            for page_id, url, payload, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                n += 1
                is_response = first is None or page_id == first
                ident = f"{page_id}:{task.partitionId() if task else 0}.{n}"  # unlike for repeated rows
                out += page_records(page_id, url, payload, base32_sha1(payload), first, is_response, ident, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = map_arrow(joined, run, "value binary").select(F.col("value").cast("string").alias("value"))
    # Spark's text writer ends each record as WARC asks: with two line ends.
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(archive: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a stream of bytes, one record in memory at a time."""
    buffer, at, over = bytearray(), 0, False

    def fill(n: int) -> bool:
        nonlocal at, over
        if at > 1 << 20:
            del buffer[:at]
            at = 0
        while not over and len(buffer) - at < n:
            piece = next(archive, None)
            if piece is None:
                over = True
            else:
                buffer.extend(piece)
        return len(buffer) - at >= n

    while fill(4):
        step, end = 1 << 12, -1
        while end < 0:
            more = fill(step)
            end = buffer.find(END, at)
            if end < 0 and not more:
                raise ValueError("a record's header is cut short")
            step *= 2
        fields = headers(bytes(buffer[at:end]))
        size = int(fields["content-length"])
        at_block = end + 4 - at
        if not fill(at_block + size):
            raise ValueError("a record's block is cut short")
        yield fields, bytes(buffer[at + at_block : at + at_block + size])
        fill(at_block + size + 4)
        at += at_block + size + 4


def inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of one or more gzip members, or raw itself if it isn't gzip."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        z = zlib.decompressobj(31)
        data = raw
        while data and not z.eof:
            yield z.decompress(data, step)
            data = z.unconsumed_tail
        yield z.flush()
        raw = z.unused_data


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP header fields and decoded payload of a response's block."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("an HTTP header is cut short")
    fields = headers(head)
    return fields, unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def finished(fields: dict[str, str], block: bytes) -> tuple:
    """A row of READ from a whole record; a digest that doesn't fit the payload raises ValueError."""
    number = lambda k: int(fields[k]) if k in fields else None
    http, payload = payload_of(block)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if base32_sha1(payload) != digest:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't fit its digest")
        size = len(payload)
    else:
        size, payload = int(http["content-length"]), None
    return number("x-page-id"), fields.get("warc-target-uri"), size, digest, kind, number("x-refers-to-page"), payload


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], [x.split()[0] for x in READ.split(", ")])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of all archives below path, segments put together.

    Whole records go straight on. Only segments are shuffled: continuations meet by origin
    identifier, are ordered by segment number, and must run from 1 without gap to the total length
    that the last one states, else the job fails. A group is one record, so its size is bounded.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("content")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                size = 0
                for fields, block in parse(inflated(raw.as_py())):
                    n = fields.get("warc-segment-number")
                    origin = fields.get("warc-segment-origin-id") or (fields.get("warc-record-id") if n else None)
                    total = fields.get("warc-segment-total-length")
                    rows.append((origin, int(n) if n else None, int(total) if total else None, list(fields.items()), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PARTS.split(", ")])
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in PARTS.split(", ")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for origin, segments, fields, block in zip(*(b.column(i).to_pylist() for i in range(4))):
                if origin is not None:
                    segments = sorted(segments, key=lambda s: s["segment"])
                    numbers, total = [s["segment"] for s in segments], segments[-1]["total"]
                    block = b"".join(s["block"] for s in segments)
                    if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
                        raise ValueError(f"segments of {origin} are missing or repeated")
                    fields = segments[0]["fields"]
                found = finished(dict(fields), block)
                out.append(found if with_payload else (*found[:-1], None))
            if out:
                yield rows_of(out)

    parts = map_arrow(files, split, PARTS)
    wanted = parts.filter(F.col("segment").isNotNull() | F.col("fields")["warc-type"].isin("response", "revisit"))
    segment = "struct<segment:int,total:long,fields:map<string,string>,block:binary>"
    grouped = wanted.filter(F.col("segment").isNotNull()).groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "fields", "block")).alias("segments"))
    nothing = lambda kind: F.lit(None).cast(kind)
    single = wanted.filter(F.col("segment").isNull()).select(nothing("string").alias("origin"), nothing(f"array<{segment}>").alias("segments"), "fields", "block")
    together = grouped.select("origin", "segments", nothing("map<string,string>").alias("fields"), nothing("binary").alias("block"))
    return map_arrow(single.unionByName(together), whole, READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).drop("payload", "target_uri")
