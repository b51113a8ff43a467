"""WARC archives: a writer over Spark's text sink and a splittable reader.

*Writing.* Records are gzip members. The text sink ends each row with a separator; as a member's last byte (the high
byte of its size) is zero under 16 MiB, rows are written without it and the separator is a zero byte, which gives plain
``.warc.gz`` content on any file system that Spark writes, under its commit protocol. Larger members get an empty
member behind them, whose last byte is zero.

*Reading.* Files are cut into byte ranges, which are dealt to as many tasks as there are ranges (``MAX_TASKS`` at most). A
task looks for gzip's magic in its range and takes a position for a member if what inflates there has the whole head of a
WARC record: the version line, then named fields with a type and a length, then an empty line. It owns the records
that start inside its range, reading past the range's end for the last one, and finds each next one where the last
member ended. If a member is damaged, or ends before its record does, the search goes on behind its start. A task holds
one record at a time. Workers open files by Arrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
CHUNK = 256 << 10
STEP = 16 << 10
MAX_HEAD = 64 << 10
MAX_TASKS = 20_000
EMPTY_MEMBER = (lambda z: z.compress(b"") + z.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"[!#-'*+.0-9A-Z^-z|~-]+:[^\r\n]*(?:\r\n[ \t][^\r\n]*)*")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, level: int) -> bytes:
    """One record as a gzip member, or two if the second one ends it with a zero byte."""
    urn = lambda x: "<urn:page:%s>" % ("" if x is None else x)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + urn(page_id).encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode()), b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + urn(refers_to).encode()]
    body = http if revisit else http + payload
    raw = b"\r\n".join([*head, b"Content-Length: %d" % len(body), b"", b""]) + body + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(raw) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to, revisit)``: copies refer to the least id of their payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("key", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    firsts = written(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "payloads")
    copy = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull() & F.col("page_id").isNull())
    return rows.join(firsts, "key", "left").select("page_id", "url", "payload", F.when(copy, F.col("first")).alias("refers_to"), F.coalesce(copy, F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 4) -> None:
    """Writes a record per row of ``(page_id, url, html)`` into archives below ``path``."""

    def members(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([record(*row, level)[:-1] for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.binary())], ["member"])

    made = with_originals(pages, min_bytes).select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(members, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Window:
    """Forward reads of a file, from ``start`` on."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        part = self.file.read(CHUNK)
        self.data += part
        return bool(part)

    def drop(self, to: int) -> None:
        if to > self.base:
            del self.data[: to - self.base]
            self.base = to


def head_of(out: bytes | bytearray) -> tuple[dict[str, str], int] | None:
    """The fields of a record's head and where its body begins; None if this is no head or its end is not there yet."""
    end = out.find(b"\r\n\r\n", 0, MAX_HEAD)
    if end < 0 or not _VERSION.match(out):
        return None
    fields, at = {}, out.index(b"\r\n") + 2
    while at < end:
        m = _FIELD.match(out, at, end)
        if not m or m.end() != end and not out.startswith(b"\r\n", m.end()):
            return None
        name, _, value = m[0].partition(b":")
        fields[name.lower().decode()] = b" ".join(value.split()).decode("utf-8", "replace")
        at = m.end() + 2
    return (fields, end + 4) if fields.get("warc-type") and fields.get("content-length", "").isdecimal() else None


def _inflate(w: _Window, at: int, whole: bool) -> tuple[dict, bytes, int] | None:
    """Head, body and end of the member at ``at`` (without ``whole``, as soon as the head is there); None if it is no whole record."""
    z, out, pos, head = zlib.decompressobj(31), bytearray(), at, None
    try:
        while not z.eof:
            if pos - w.base >= len(w.data) and not w.more():
                return None
            part = bytes(w.data[pos - w.base : pos - w.base + STEP])
            out += z.decompress(part)
            pos += len(part)
            if head is None and len(out) >= 10:
                head = head_of(out)
                if head is None and (len(out) >= MAX_HEAD or z.eof or not _VERSION.match(out)):
                    return None
            if head and not whole:
                return head[0], b"", pos
    except zlib.error:
        return None
    if head is None or len(out) - head[1] < int(head[0]["content-length"]):
        return None
    return head[0], bytes(memoryview(out)[head[1] : head[1] + int(head[0]["content-length"])]), pos - len(z.unused_data)


def members_in(file, start: int, end: int):
    """``(offset, fields, body)`` of the records that start in ``[start, end)``."""
    w, at, sure = _Window(file, start), start, False
    while at < end:
        w.drop(at)
        if not sure:
            while (k := w.data.find(MAGIC)) < 0:
                skip = max(0, len(w.data) - len(MAGIC) + 1)
                w.drop(w.base + skip)
                if w.base >= end or not w.more():
                    return
            at += w.base - at + k
            if at >= end:
                return
            if _inflate(w, at, False) is None:
                at += 1
                continue
        got = _inflate(w, at, True)
        if got is None:
            at, sure = at + 1, False
            continue
        yield at, got[0], got[1]
        at, sure = got[2], True


def payload_of(body: bytes) -> tuple[bytes, int]:
    """What follows a body's HTTP head, and how long that head says it is."""
    http, _, payload = body.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return payload, int(size[1]) if size else len(payload)


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


READ_SCHEMA = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, one row each; ``payload=False`` leaves the payloads out.

    ``payload_digest`` is the recorded one, without its algorithm. For records that hold their payload it is checked,
    and a payload that doesn't match gives a null digest. Files without any record give no rows.
    """

    def read(batches):
        for batch in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                with _open(uri) as file:
                    for offset, f, body in members_in(file, start, end):
                        held, size = payload_of(body)
                        kind, told = f.get("warc-type"), (f.get("warc-payload-digest") or "").rpartition(":")[2] or None
                        if kind == "response" and told != digest(held):
                            told = None
                        rows.append((uri, offset, kind, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"), told, size, held if payload else None))
                        if len(rows) >= 256:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    cut = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    n = files.agg(F.sum(F.size(cut))).first()[0] or 0
    starts = files.withColumn("start", F.explode(cut))
    # A stated number: ranges are tiny rows, and Spark would put them all into one task.
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end")).repartition(max(1, min(n, MAX_TASKS)))
    return ranges.mapInArrow(read, READ_SCHEMA)


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def round_trip(pages: DataFrame, min_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes ``pages`` and reads the archives back: a row per page, from the records alone.

    A null html is an empty payload; a null url an empty one. Of equal payloads of ``min_bytes`` or more the row with the
    smallest ``page_id`` is the response and others revisit it; rows that repeat that id are all responses. A null
    id comes after any other; if all are null, all are responses. An empty table gives an empty result.
    """
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    back = read_archives(spark, path, range_bytes, payload=False)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast(pages.schema["page_id"].dataType)
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
