"""WARC archives: a writer with revisit records, and a reader that salvages what follows damage.

Payloads are named by their SHA-1.  Of equal payloads of at least ``least`` bytes the record with the smallest
page_id is a response, the others revisit it; the smallest is found by a grouped minimum and a join whose hot
digests Spark can split, so copies are never collected.  Each record is a gzip member of its own.  Archives are
rows of a binary column in the shared folder (any store can hold them); ``export`` of ``order`` shows how such
rows become files.

The reader takes an archive's bytes, plain or gzipped, of any WARC/x.y version, from any writer: members may hold
many records, records may be of any type, and headers may be missing.  Where a record's version line, length or
digest is wrong, or a member can't be unpacked, it searches for the next version line or gzip header that gives a
valid record, goes on there, and reports the gap as a row of type ``quarantine``.  Inside a member the search goes
on in the unpacked bytes.  Of a member that breaks off, whole records of its front are kept; of a member with wrong
bytes, those whose block digest proves them.  ``begin`` and ``end`` are places in the archive; ``inner`` is the place
in the member's unpacked bytes (null for plain records and for gaps of the archive itself).

Defined results: null html is an empty payload; a null page_id is kept as null; rows that share the smallest
page_id of a payload are all responses (ties), as repeated rows of it are; very long pages are records like others
(an archive, and a member unpacked, are held by one task);
columns other than page_id, url and html are not read; an empty table gives an empty result.  A digest of an unknown
algorithm is not checked.  Records without a type are of type ``unknown``; a payload is what follows the HTTP head
in records of HTTP messages, else the whole block; a revisit's size and digest are those its header states, null
where it states none.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, on_workers

ARCHIVE_BYTES = 4 << 20
_VERSION = b"WARC/1.1\r\n"
_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(re.escape(_MEMBER) + b"|" + _LINE.pattern)
_STEP = 1 << 14
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    body = b"" if refers_to is not None else payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Payload-Length", str(len(payload))),  # an extension field: a revisit's body is empty
        ("WARC-Block-Digest", f"sha1:{digest(body)}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(body))))
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def pack(raw: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Found(NamedTuple):
    """A record, or a gap of bytes where ``head`` is None."""

    head: dict | None
    body: bytes
    begin: int
    end: int
    inner: int | None


def _sums(body: bytes, algorithm: str) -> set[str]:
    """The digest's usual spellings; none for an unknown algorithm."""
    try:
        raw = hashlib.new(algorithm.replace("-", ""), body).digest()
    except (ValueError, TypeError):
        return set()
    return {base64.b32encode(raw).decode().rstrip("="), raw.hex().upper()}


def proved(head: dict, body: bytes) -> bool | None:
    """Whether the block digest holds; None where there is none that can be checked."""
    algorithm, sep, value = head.get("warc-block-digest", "").partition(":")
    right = _sums(body, algorithm.strip().lower()) if sep else set()
    return value.strip().upper().rstrip("=") in right if right else None


class _Blank:
    """The next blank line from a place on; places are asked for in rising order, so every stretch is searched once."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, -1

    def __call__(self, p: int) -> int:
        if self.at < p:
            found = self.raw.find(b"\r\n\r\n", p)
            self.at = len(self.raw) if found < 0 else found
        return self.at


def parse(raw: bytes, at: int = 0, blank: _Blank | None = None) -> tuple[dict, bytes, int] | None:
    """Headers, body and end of the record at ``at``; None if it isn't whole and right.

    Fields are read one by one up to the blank line, so a damaged header ends at its first line that is no field.
    """
    line = _LINE.match(raw, at)
    stop = (blank or _Blank(raw))(at) if line else len(raw)
    if stop == len(raw) or stop < line.end():
        return None
    head: dict[str, str] = {}
    name, place = None, line.end()
    while place < stop:
        to = raw.find(b"\r\n", place, stop)
        to = stop if to < 0 else to
        field, place = raw[place:to], to + 2
        if name and field[:1] in (b" ", b"\t"):  # a folded line
            head[name] += " " + field.strip().decode("utf-8", "replace")
            continue
        k, sep, v = field.partition(b":")
        if not sep:
            return None
        name = k.strip().lower().decode("latin-1")
        head[name] = v.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    end = stop + 4 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        return None
    body = raw[stop + 4 : end]
    return None if proved(head, body) is False else (head, body, end + 4)


def _unpack(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at ``at`` holds as far as it can be unpacked, where that ends, and whether it is whole, cut or wrong."""
    z, out, p, step = zlib.decompressobj(31), [], at, _STEP
    while p < len(data) and not z.eof:
        before = z.copy() if step > 1 else None
        part = data[p : p + step]
        try:
            out.append(z.decompress(part))
        except zlib.error:
            if before is None:
                return b"".join(out), p, "wrong"
            z, step = before, step // 8 or 1
            continue
        p += len(part)
    return b"".join(out), p - len(z.unused_data), "whole" if z.eof else "cut"


def _records(raw: bytes) -> Iterator[tuple[dict | None, bytes, int, int]]:
    """Records of unpacked bytes and the gaps between them."""
    p, gap, blank = 0, 0, _Blank(raw)
    while p < len(raw):
        if got := parse(raw, p, blank):
            if gap < p:
                yield None, raw[gap:p], gap, p
            yield got[0], got[1], p, got[2]
            p = gap = got[2]
        else:
            m = _LINE.search(raw, p + 1)
            p = m.start() if m else len(raw)
    if gap < len(raw):
        yield None, raw[gap:], gap, len(raw)


def salvage(data: bytes) -> Iterator[Found]:
    """Each record of an archive and each quarantined gap."""
    at, gap, blank = 0, 0, _Blank(data)
    stored: set[bytes] = set()  # records taken from a damaged member, which may stand in its bytes unpacked
    reach = 0
    while at < len(data):
        found, end = [], at
        if data.startswith(_MEMBER, at):
            raw, end, state = _unpack(data, at)
            inside = list(_records(raw))
            if state == "whole" and any(h is not None for h, *_ in inside):
                found = [Found(h, body, at, end, a) for h, body, a, _ in inside]
            else:
                good = [(h, body, a, b) for h, body, a, b in inside if h is not None and (state != "wrong" or proved(h, body))]
                stored |= {hashlib.sha1(raw[a:b]).digest() for _, _, a, b in good}
                reach = max(reach, end)
                for h, body, a, _ in good:
                    yield Found(h, body, at, end, a)
        elif got := parse(data, at, blank):
            end = got[2]
            if not (at < reach and hashlib.sha1(data[at:end]).digest() in stored):
                found = [Found(got[0], got[1], at, end, None)]
        if found:
            if gap < at:
                yield Found(None, data[gap:at], gap, at, None)
            yield from found
            at = gap = end
        else:
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
    if gap < len(data):
        yield Found(None, data[gap:], gap, len(data), None)


def _write(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{nth:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

    for b in batches:
        for page_id, url, html, to in zip(*(b.column(i) for i in range(4)), strict=True):
            held.append(pack(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), to.as_py())))
            size += len(held[-1])
            if size >= most:
                yield done()
                nth, held, size = nth + 1, [], 0
    if held:
        yield done()


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m and -(2**63) <= int(m[1]) < 2**63 else None


def _stated(head: dict) -> tuple[int | None, str | None]:
    """A revisit's payload size and digest as its header states them."""
    size = head.get("warc-payload-length", "")
    algorithm, sep, value = head.get("warc-payload-digest", "").partition(":")
    if sep and algorithm.lower() == "sha1" and re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        value = base64.b32encode(bytes.fromhex(value)).decode()
    return int(size) if size.isascii() and size.isdigit() else None, value or algorithm or None


def _payload(head: dict, body: bytes) -> bytes:
    if head.get("content-type", "").lower().startswith("application/http"):
        before, sep, after = body.partition(b"\r\n\r\n")
        return after if sep and b"HTTP/" in before.split(b"\r\n", 1)[0] else body
    return body


def _row(archive: str, f: Found) -> tuple:
    if f.head is None:
        return archive, f.begin, f.end, f.inner, None, None, None, None, "quarantine", None, f.body
    kind = f.head.get("warc-type", "").lower() or "unknown"
    payload = _payload(f.head, f.body)
    size, sha = _stated(f.head) if kind == "revisit" else (len(payload), digest(payload))
    return archive, f.begin, f.end, f.inner, _page(f.head.get("warc-record-id", "")), f.head.get("warc-target-uri"), size, sha, kind, _page(f.head.get("warc-refers-to", "")), payload


_READ = "archive string, begin bigint, end bigint, inner bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
_COLUMNS = [(name, _ARROW[kind]) for name, kind in (c.split() for c in _READ.split(", "))]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    for b in batches:
        for archive, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows, held = [], 0
            for f in salvage(data.as_py() or b""):
                rows.append(_row(archive, f))
                held += len(f.body)
                if held > 8 << 20:
                    yield done(rows)
                    rows, held = [], 0
            if rows:
                yield done(rows)


def write(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages(page_id, url, html) to the written archives (archive, data)."""
    spark = pages.sparkSession
    tables = Tables(spark, "warc")
    got = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    named = got.withColumn("sha", F.sha1(raw))
    copies = named.filter(F.octet_length(raw) >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that both sides of the join are dealt anew and a hot payload's rows can be split
    copies = tables.write(copies.select("sha", "first"), "copies")
    to = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    linked = named.join(copies, "sha", "left").select("page_id", "url", "html", to.alias("refers_to"))
    return tables.write(linked.mapInArrow(lambda it: _write(it, archive_bytes), "archive string, data binary"), "archives", "uncompressed", product=True)


def read(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps of archives(archive, data): the columns of ``_READ``."""
    on_workers(archives.sparkSession)
    return archives.select("archive", "data").mapInArrow(_read, _READ)
