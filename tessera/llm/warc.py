"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: every record is a gzip member of its own. A task appends to files of about FILE_BYTES under names that no other attempt uses, and returns what it
wrote; only files in that manifest count, so that an attempt that was lost leaves nothing behind that is read.

Reading: a file is cut into byte ranges without looking at it. The task of a range looks for the gzip magic from its start, takes a place for
a member only if what it decodes to begins like a WARC header with all its lines, owns the records that start inside its range, and reads on past
its end to finish the last of them. After a record it goes on at the member's end, so magic bytes inside compressed data are not tried.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, lookup, materialize

#: Payloads of at least so many bytes are written once.
MIN_REVISIT = 1000
#: A file is closed when it has so many bytes; the bytes of a range; rows of repeated payloads that are broadcast.
FILE_BYTES, RANGE_BYTES, BROADCAST_ROWS = 64 << 20, 4 << 20, 500_000
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
STEP = 1 << 18

MANIFEST = "path string, bytes bigint, records bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A gzip member with one record: response, or revisit of refers_to (with the payload's HTTP header but without the payload)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:x-page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, to: str | None = None) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html; null html: empty) to files in the folder to; returns the manifest.

    Of records with equal payloads of at least MIN_REVISIT bytes that with the largest page_id is a response and the others revisit it (rows that repeat that page_id are responses, too).
    """
    to = to or fresh(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1("html")})
    repeated = rows.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    repeated = materialize(repeated.select(F.col("digest").alias("d"), "first"), "warc-repeated")
    # small payloads revisit nothing: they have no key, so that all the empty ones are not dealt to one task
    rows = rows.withColumn("d", F.when(F.col("size") >= MIN_REVISIT, F.col("digest")))
    rows = rows.join(F.broadcast(repeated), "d", "left") if repeated.count() <= BROADCAST_ROWS else lookup(rows, repeated, "d", "warc")
    rows = rows.select("page_id", "url", "html", "digest", "size", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _filesystem(to)
        out = path = None
        size = records = 0
        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "bytes", "records"])
        for b in batches:
            for page_id, url, html, digest, n, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, size, records, out = f"{to}/{name}", 0, 0, fs.open_output_stream(f"{folder}/{name}", compression=None)
                data = record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, n, refers)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, b""

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(STEP, self.size - at), at)
        return True

    def drop(self, to: int) -> None:
        self.data, self.start = self.data[to - self.start :], to


def member(window: _Window, at: int) -> tuple[bytes, int, bool] | None:
    """What the gzip member at a place decodes to, where it ends, and whether it is whole; None if there is none or it is no WARC record."""
    unpack = zlib.decompressobj(31)
    parts, start, tail, done = [], b"", b"", False
    p = at - window.start
    while True:
        if p >= len(window.data) and not window.more():
            return (b"".join(parts), window.start + p, False) if done else None
        piece = window.data[p : p + STEP]
        try:
            out = unpack.decompress(piece)
        except zlib.error:
            return None
        p += len(piece)
        parts.append(out)
        if not done:
            # whatever starts like a record is read on until its header ends, or the member does
            start, tail = (start + out)[:7], tail + out
            if not start.startswith(b"WARC/1."[: len(start)]):
                return None
            done, tail = b"\r\n\r\n" in tail, tail[-3:]
            if not done and unpack.eof:
                return None
        if unpack.eof:
            return b"".join(parts), window.start + p - len(unpack.unused_data), True


def parse(record: bytes, whole: bool = True) -> tuple:
    """The RECORD columns of a decoded record. A record without a valid Content-Length has what follows its header as its block; one whose member ends early (whole is
    false) has the type truncated and what there is of it. Records of other types than response and revisit have their block as payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length, kind = fields.get("content-length", ""), fields.get("warc-type") if whole else "truncated"
    block = block[: int(length)] if length.isascii() and length.isdigit() else block.removesuffix(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.search(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) else None
    url = fields.get("warc-target-uri")
    url = None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    http, gap, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        n = re.search(rb"(?im)^content-length: *(\d+)", http)
        return number("warc-record-id"), url, kind, number("warc-refers-to"), int(n[1]) if n else None, fields.get("warc-payload-digest", "").partition(":")[2] or None, None
    payload = payload if gap and kind in ("response", "truncated") else block
    return number("warc-record-id"), url, kind, None, len(payload), hashlib.sha1(payload).hexdigest(), payload


def records_of_range(file, size: int, start: int, end: int) -> Iterator[tuple]:
    """The records whose members start at a place from start up to end (not included)."""
    window = _Window(file, size, start)
    at = start
    while at < end:
        found = window.data.find(MAGIC, at - window.start)
        if found < 0 or window.start + found >= end:
            if found >= 0 or window.start + len(window.data) >= end + len(MAGIC):
                return
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.drop(at)
            if not window.more():
                return
            continue
        at = window.start + found
        got = member(window, at)
        if got is None:
            at += 1
            continue
        yield parse(got[0], got[2])
        at = got[1]
        window.drop(min(at, window.start + len(window.data)))
        if at > window.start + len(window.data):
            window.start, window.data = at, b""


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records (RECORD) of all files in manifest (path, bytes), one task range after another."""
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(n, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for row in records_of_range(file, size, start, min(size, start + range_bytes)):
                        rows.append(row if with_payload else (*row[:-1], None))
                        held += len(row[-1] or b"") if with_payload else 0
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives of all rows of pages.

    A null url stays null, a null page_id too; null html is an empty payload; equal rows are records of their own, and so are urls and payloads of any length. Other columns are
    ignored. An empty table gives no file and no rows.
    """
    read = read_archives(write_archives(pages), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM m
"""
