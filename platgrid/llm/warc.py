"""WARC segment reassembly.

A record too long for one file is cut into segments: the first has its own type and a
WARC-Segment-Number of 1, the others are `continuation` records that name the first one in
WARC-Segment-Origin-ID, and the last one has WARC-Segment-Total-Length.  Segments are grouped by origin,
ordered by number and joined; the length is verified; then the HTTP head is parsed and chunked transfer framing
undone.

Defined results: every origin gives one row with a status: `ok`; `gap` (a number is missing, the first or
the last one lost); `length` (a segment or the sum differs from what is declared); `framing` (chunks broken); `head` (no HTTP
head in a response); `damaged` (a record whose head names no readable length, or a file that cannot be unpacked to its end: such a row has the
file and the byte as its origin_id).  body is null unless the status is `ok`.  Copies of a segment (same number, same
bytes) count once; of different bytes under one number, the status is `conflict`.  Records that are null, empty or
without a WARC head or identifier give nothing.  Segment numbers that are no number up to 2**31 - 1 count as missing (0).  Records without segments are their own origin.  Empty tables give empty results.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

RECORD = "record_id string, origin_id string, type string, uri string, number int, total_length bigint, declared bigint, payload binary"
PAGE = "origin_id string, uri string, segments int, total_length bigint, status string, http_status int, chunked boolean, body binary"
DAMAGED = "damaged"
#: Bytes that are read from a file at once.
READ_BYTES = 4 << 20
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Fields of a WARC or HTTP head by lower-case name ('' is the first line), and where the block begins."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    fields = {"": lines[0]}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            value = value.strip()
            fields[name] = f"{fields[name]}, {value}" if name in fields else value
    return fields, end + 4


def _number(x: str | None, most: int = (1 << 63) - 1) -> int | None:
    """The number that x is, of ASCII digits alone; None if it is none or above most."""
    n = int(x) if x is not None and x.isascii() and x.isdigit() and len(x) < 20 else None
    return n if n is not None and n <= most else None


def dechunk(raw: bytes) -> bytes | None:
    """The data of chunked framing, up to the chunk of length 0; None where it is broken."""
    out, at = [], 0
    while True:
        m = _CHUNK.match(raw, at)
        if not m:
            return None
        n = int(m[1], 16)
        at = m.end()
        if n == 0:
            return b"".join(out)
        if raw[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(raw[at : at + n])
        at += n + 2


def parse_records(warc: DataFrame) -> DataFrame:
    """RECORD columns of each row's `record` (bytes of one WARC record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for raw in b.column(0).to_pylist():
                got = parse_head(raw) if raw else None
                if got is None or not got[0][""].startswith("WARC/"):
                    continue
                f, start = got
                own = f.get("warc-record-id")
                if not own:
                    continue
                n = _number(f.get("content-length"))
                payload = raw[start:]
                if n is not None and payload[n:] in (b"", b"\r\n\r\n"):
                    payload = payload[:n]
                kind = f.get("warc-type", "").lower()
                if kind == DAMAGED:  # what read_records makes of bytes that it could not read
                    n = None
                origin = f.get("warc-segment-origin-id") if kind == "continuation" else own
                if not origin:
                    continue
                number = _number(f.get("warc-segment-number"), (1 << 31) - 1)
                rows.append((own, origin, kind, f.get("warc-target-uri"), 0 if number is None else number, _number(f.get("warc-segment-total-length")), n, payload))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in RECORD.split(", ")])

    return warc.select("record").mapInArrow(run, RECORD)


def join_segments(segments: list[dict]) -> dict:
    """One PAGE row (without origin_id) of the segments of an origin, in any order."""
    one: dict[int, dict] = {}
    status = "ok"
    for s in segments:
        have = one.setdefault(s["number"], s)
        if have is not s and bytes(have["payload"]) != bytes(s["payload"]):
            status = "conflict"
        if have is not s and have["total_length"] is None:
            have["total_length"] = s["total_length"]
    parts = [one[k] for k in sorted(one)]
    head, numbers = parts[0], sorted(one)
    whole = numbers == [0]
    payload = b"".join(bytes(p["payload"]) for p in parts)
    total = parts[-1]["total_length"]
    if head["type"] == DAMAGED:
        status = DAMAGED
    out = {"uri": next((p["uri"] for p in parts if p["uri"]), None), "segments": len(parts), "total_length": len(payload) if whole else total, "http_status": None, "chunked": None, "body": None}
    if status == "ok" and not whole and (numbers != list(range(1, len(numbers) + 1)) or total is None or head["type"] == "continuation"):
        status = "gap"
    if status == "ok" and (any(p["declared"] != len(p["payload"]) for p in parts) or not whole and total != len(payload)):
        status = "length"
    if status == "ok":
        if head["type"] != "response":
            out["body"] = payload
        else:
            got = parse_head(payload)
            line = re.match(r"HTTP/\d(?:\.\d)? (\d{3})", got[0][""]) if got else None
            if not line:
                status = "head"
            else:
                f, start = got
                out["http_status"], body = int(line[1]), payload[start:]
                codings = [c.strip() for c in f.get("transfer-encoding", "").lower().split(",")]
                out["chunked"] = codings[-1] == "chunked"
                if out["chunked"]:
                    body = dechunk(body)
                if body is None:
                    status = "framing"
                out["body"] = body
    return out | {"status": status}


def reassemble(warc: DataFrame) -> DataFrame:
    """PAGE rows, one for each origin; one shuffle of the payloads, by origin identifier."""
    small_batches(warc.sparkSession)
    records = parse_records(warc)
    names = ["type", "uri", "number", "total_length", "declared", "payload"]
    grouped = records.groupBy("origin_id").agg(F.collect_list(F.struct(*names)).alias("segments"))
    columns = [x.split()[0] for x in PAGE.split(", ")]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [join_segments(s) | {"origin_id": o} for o, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(columns, kinds)], names=columns)

    return grouped.mapInArrow(run, PAGE)


class _Records:
    """Records of a WARC file that comes in pieces, in time and memory that follow the longest record."""

    def __init__(self, name: str, pieces: Iterator[bytes]):
        self.name, self.pieces, self.buffer, self.at, self.base, self.broken = name, pieces, bytearray(), 0, 0, None

    def _more(self) -> bool:
        if self.broken is None:
            try:
                piece = next(self.pieces, None)
            except (OSError, EOFError, zlib.error) as e:
                self.broken, piece = f"{type(e).__name__}: {e}", None
            if piece:
                del self.buffer[: self.at]
                self.base, self.at = self.base + self.at, 0
                self.buffer += piece
                return True
            self.pieces = iter(())
        return False

    def _find(self, what: bytes, start: int) -> int:
        """Where `what` is at or behind start, as offset to self.at; -1 if nowhere."""
        while (found := self.buffer.find(what, self.at + start)) < 0:
            start = max(start, len(self.buffer) - self.at - len(what) + 1)
            if not self._more():
                return -1
        return found - self.at

    def _damaged(self, why: str) -> bytes:
        where = f"{self.name}@{self.base + self.at}"
        return f"WARC/1.0\r\nWARC-Type: {DAMAGED}\r\nWARC-Record-ID: {where}\r\nWARC-Target-URI: {why}\r\n\r\n".encode()

    def __iter__(self) -> Iterator[bytes]:
        while True:
            start = self._find(b"WARC/", 0)
            if start != 0 and (self.buffer[self.at :].strip() if start < 0 else self.buffer[self.at : self.at + start].strip()):
                yield self._damaged("bytes that belong to no record")
            if start < 0:
                break
            self.at += start
            end = self._find(b"\r\n\r\n", 0)
            got = parse_head(bytes(self.buffer[self.at : self.at + end + 4])) if end >= 0 else None
            n = _number(got[0].get("content-length")) if got else None
            if n is None:
                # the next record is where the next head begins
                yield self._damaged("no readable length")
                self.at += 5
                after = self._find(b"\r\nWARC/", 0)
                if after < 0:
                    self.at = len(self.buffer)
                    break
                self.at += after + 2
                continue
            whole = got[1] + n
            while len(self.buffer) - self.at < whole and self._more():
                pass
            yield bytes(self.buffer[self.at : self.at + whole])  # a record that is cut off fails the check of its length
            self.at = min(len(self.buffer), self.at + whole)
        if self.broken:
            yield self._damaged(self.broken)


def _pieces(raw: BinaryIO) -> Iterator[bytes]:
    """The bytes of a file, unpacked if they are gzipped, also record by record."""
    first = raw.read(READ_BYTES)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = raw.read(READ_BYTES)
        return
    unpack, inside = zlib.decompressobj(31), False
    while first:
        inside = True
        out = unpack.decompress(first, READ_BYTES)
        if out:
            yield out
        if unpack.eof:
            first, inside = unpack.unused_data.lstrip(b"\0"), False
            unpack = zlib.decompressobj(31)
        else:
            first = unpack.unconsumed_tail
        first = first or raw.read(READ_BYTES)
    rest = unpack.flush()
    if rest:
        yield rest
    if inside and not unpack.eof:
        raise EOFError("the file ends inside a packed record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """`record` rows of the WARC files (plain, or gzipped whole or record by record) under path; one task reads one file, of at most 2 GB as it is stored.

    Damaged stretches give a record of type `damaged`, and reading goes on at the next head."""
    small_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, size = [], 0
                for record in _Records(name, _pieces(io.BytesIO(raw))):
                    out.append(record)
                    size += len(record)
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "record binary")


def to_warc(pages: DataFrame, segment_bytes: int = 1500, chunk_bytes: int = 700) -> DataFrame:
    """`record` rows that hold pages (page_id, url, html) as chunked HTTP responses, cut into segments: the inverse.

    Two of three pages are sent in chunks; rows of null html have an empty body."""

    def records(page_id: int, url: str | None, html: str | None) -> Iterator[bytes]:
        body = (html or "").encode()
        chunked = page_id % 3 != 0
        if chunked:
            size = chunk_bytes + page_id % 97
            pieces = [body[i : i + size] for i in range(0, len(body), size)]
            body = b"".join(b"%x%s\r\n%s\r\n" % (len(p), b";q=1" if page_id % 5 == 0 else b"", p) for p in pieces) + b"0\r\n\r\n"
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Transfer-Encoding: chunked\r\n" if chunked else b"Content-Length: %d\r\n" % len(body)) + b"\r\n" + body
        parts = [http[i : i + segment_bytes] for i in range(0, len(http), segment_bytes)]
        for k, p in enumerate(parts, 1):
            head = [f"WARC-Type: {'response' if k == 1 else 'continuation'}", f"WARC-Record-ID: <urn:page:{page_id}:{k}>", f"WARC-Target-URI: {url or ''}"]
            if len(parts) > 1:
                head.append(f"WARC-Segment-Number: {k}")
                if k > 1:
                    head.append(f"WARC-Segment-Origin-ID: <urn:page:{page_id}:1>")
                if k == len(parts):
                    head.append(f"WARC-Segment-Total-Length: {len(http)}")
            yield ("WARC/1.0\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(p)}\r\n\r\n").encode() + p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for row in zip(*(c.to_pylist() for c in b.columns)) for r in records(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.where("page_id is not null").select("page_id", "url", "html").mapInArrow(run, "record binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reassemble(to_warc(table(spark, sf_dir, "pages")))
    return got.select(
        F.regexp_extract("origin_id", r"page:(\d+):", 1).cast("bigint").alias("page_id"),
        F.col("uri").alias("url"),
        "status",
        "chunked",
        F.octet_length("body").cast("bigint").alias("n_bytes"),
        F.md5("body").alias("md5"),
        F.col("body").cast("string").alias("html"),
    )


OP10_SQL = """
SELECT page_id, url, 'ok' AS status, page_id % 3 <> 0 AS chunked, strlen(html)::BIGINT AS n_bytes, md5(html) AS md5, html FROM pages
"""
