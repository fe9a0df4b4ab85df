"""WARC archives: writing pages with segmented records, and reassembling them.

A page is an HTTP response in chunked transfer framing. A record whose block is longer than ``segment_bytes`` is written
as a first segment and continuation records, which carry the origin's record id, their segment number and, in the last
one, the total length. Reading groups continuation records by origin id, orders them by segment number, verifies that
none is missing and that the total length agrees, and then takes the chunked framing off and checks the payload digest.
A group is one record, so it is as large as that record and no larger.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest page_id is the response and
the others are revisits, which keep the HTTP head (with the payload's length) and no payload. The table of repeated
digests is aggregated before anything is joined to it, so a payload that a third of the pages share costs one row.

Cases: null or empty html: an empty payload. Null page_id: below all others; written without an id and read as null. Rows
that repeat the largest page_id and the payload are all responses. Ties can't occur otherwise. Null url: no target URI.
Empty table: no archive, no rows. Damaged, missing or repeated segments raise ValueError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import get, put, scratch, slices, stored

END = b"\r\n"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, segment long, total_length long, block binary"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, END]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    at, parts = 0, []
    while True:
        end = body.find(END, at)
        if end < 0:
            raise ValueError("chunked framing breaks off")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk's length is wrong")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), f"Content-Length: {len(block)}\r\n\r\n"])
    return head.encode() + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, record_id: str, segment_bytes: int) -> Iterator[bytes]:
    head = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        head[0] = ("WARC-Type", "revisit")
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
        yield record(head, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record(head, block)
        return
    yield record([*head, ("WARC-Segment-Number", "1")], block[:segment_bytes])
    n = -(-len(block) // segment_bytes)
    for k in range(2, n + 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{k}')}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", str(k))]
        if k == n:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[(k - 1) * segment_bytes : k * segment_bytes])


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each; bytes are taken in small steps so that no rest is copied often."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive breaks off")
            piece = view[at : at + 16384]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    end = raw.find(b"\r\n\r\n")
    first, *lines = raw[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError("a record breaks off")
    return fields, block


def payload_of(block: bytes, digest: str) -> bytes:
    end = block.find(b"\r\n\r\n")
    head, body = block[:end].lower(), block[end + 4 :]
    payload = dechunked(body) if b"transfer-encoding: chunked" in head else body
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return payload


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length or None, bytes)."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise ValueError("the segments don't add up to the total length")
    return block


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.encode(html, "UTF-8").alias("payload"), F.col(url_col).cast("string").alias("url"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, *, revisit_bytes: int = 1000, segment_bytes: int = 32768, archive_bytes: int = 1 << 26) -> DataFrame:
    """Writes .warc.gz files and returns their paths, one row each, with the number of records."""
    rows = page_rows(pages).withColumn("digest", F.sha1("payload"))
    long_ones = rows.where(F.octet_length("payload") >= revisit_bytes)
    repeated = long_ones.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest")
    repeated = stored(spark, repeated, "warc-repeated")
    refers = F.when((F.octet_length("payload") >= revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") < F.col("newest"))), F.col("newest"))
    rows = rows.join(repeated, "digest", "left").select("page_id", "payload", "url", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, n, out, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal piece, out, size
            put(path := f"{folder}/part-{part:06d}-{piece:04d}.warc.gz", b"".join(out))
            row = pa.RecordBatch.from_pylist([{"path": path, "records": len(out)}])
            piece, out, size = piece + 1, [], 0
            return row

        for batch in slices(batches):
            for page_id, payload, url, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{n}/{page_id}')}>"
                for raw in page_records(page_id, url, payload, digest, refers_to, record_id, segment_bytes):
                    out.append(zipped(raw))
                    size += len(out[-1])
                    if size >= archive_bytes:
                        yield close()
        if out:
            yield close()

    return stored(spark, rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _int(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_records(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives; only segments, which need others, keep their bytes in ``block``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for raw in members(get(path)):
                    f, block = parse(raw)
                    digest = f.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    page, number, total = _int(f.get("X-Page-Id")), _int(f.get("WARC-Segment-Number")), _int(f.get("WARC-Segment-Total-Length"))
                    kind = f["WARC-Type"]
                    if number is not None:
                        rows.append((page, None, digest or None, kind, None, f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"]), number, total, block))
                        size += len(block)
                    elif kind == "revisit":
                        held = next(int(x.split(b":")[1]) for x in block.split(END) if x.lower().startswith(b"content-length:"))
                        rows.append((page, held, digest, kind, int(f["X-Refers-To-Page-Id"]), f["WARC-Record-ID"], None, None, None))
                    else:
                        rows.append((page, len(payload_of(block, digest)), digest, kind, None, f["WARC-Record-ID"], None, None, None))
                    if size >= 1 << 22 or len(rows) >= 4096:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return manifest.select("path").repartition(n, "path").mapInArrow(read, RECORD)


def read_pages(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page in the archives."""
    records = stored(spark, read_records(manifest), "warc-records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    part = F.struct("segment", "total_length", "block", "page_id", "payload_digest")
    groups = records.where("segment is not null").groupBy("record_id").agg(F.collect_list(part).alias("parts"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column(0)[k].as_py()
                first = min(parts, key=lambda p: p["segment"])
                block = reassembled([(p["segment"], p["total_length"], p["block"]) for p in parts])
                n = len(payload_of(block, first["payload_digest"]))
                yield pa.RecordBatch.from_arrays([pa.array([first["page_id"]], pa.int64()), pa.array([n], pa.int64()), pa.array([first["payload_digest"]]), pa.array(["response"]), pa.array([None], pa.int64())], names)

    whole = groups.select("parts").mapInArrow(assemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return records.where("segment is null").select(names).unionByName(whole)


def page_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    return read_pages(spark, write_archives(spark, pages, scratch(spark, "warc"), **options))
