"""Benchmark decontamination: Wu-Manber search for many strings at once.

Test strings are the runs of `window` words of every benchmark item, and an item of fewer words whole, however short (`least_words`
raises that).  Text and items are compared in lower case with every run of blanks and punctuation as one blank;
bytes of multi-byte characters count as word characters.  A block of bytes at the end of the current
window is looked up in a shift table; a shift above 0 skips as many positions as cannot end an
occurrence, a shift of 0 selects a hash bucket of the test strings by their last bytes, whose candidates are
compared byte by byte.  Strings of like length share tables, so that a short one does not shorten the shifts of all; those under
8 bytes have blocks of 2.  Cursors for many stretches of a batch advance together, one numpy step for all.

The tables are broadcast for PART_BYTES of benchmark text at a time; a larger benchmark is searched for in as many passes.

Defined results: null and empty texts hold nothing; items that are null or without a word are not
searched for, and those of null item_id by `decontaminate` alone, as a report names the item; the same text in several items reports each of them.  A document is reported once per item
with the number of its test strings that occur and the byte position (in the compared form) of the first.
Rows of null doc_id are searched as well.  Repeated rows of one doc_id are reported as often as they stand.
Extra columns pass through `decontaminate` unchanged.  An empty benchmark or table reports nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import small_batches, table

WINDOW = 13
LEAST_WORDS = 1
#: Bytes of a block, for strings of that length at least; strings that share tables are at most CLASSES apart.
BLOCK, SHORT_BLOCK = 8, 2
CLASSES = (0, BLOCK, 24, 64)
#: A shift table has about eight places for each block of the strings, within these bounds (of 4 bytes each).
TABLE_BITS = (12, 24)
LANES = 16384
#: Benchmark text (bytes) whose tables are held at once; with windows of 13 words they take some 30 times as much.
PART_BYTES = 4 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)


def compared(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of the compared form: every text stands between two blanks, and after a NUL."""
    data, offsets = tc.buffers(pc.utf8_lower(column))
    n = len(offsets) - 1
    word = tc._WORD[data] == 1
    keep = word.copy()
    keep[1:] |= word[:-1]  # one blank after each word
    starts = offsets[:-1][np.diff(offsets) > 0]
    if len(starts):
        keep[starts] = word[starts]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    sizes = np.diff(at[offsets])
    # a text that ends in a word has no blank behind it yet
    last = np.zeros(n, bool)
    full = np.diff(offsets) > 0
    last[full] = word[offsets[1:][full] - 1]
    first = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + last + 2, out=first[1:])
    out = np.full(first[-1], 32, np.uint8)
    out[first[:-1]] = 0
    kept = np.where(word, data, 32).astype(np.uint8)[keep]
    row = np.repeat(np.arange(n), sizes)
    out[np.arange(len(kept)) + (first[:-1] + 2 - at[offsets[:-1]])[row]] = kept
    return out, first


class Tables:
    """Shift and bucket tables of byte strings of at least `block` bytes."""

    def __init__(self, strings: list[bytes], number: np.ndarray, size: int):
        self.number, self.size = number, size  # of the strings in the whole list; bytes of a block
        self.length = np.array([len(s) for s in strings])
        self.m = int(self.length.min())
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.first = np.cumsum(self.length) - self.length
        blocks = self.m - size + 1
        self.bits = int(np.clip(int(8 * blocks * len(strings)).bit_length(), *TABLE_BITS))
        self.shift = np.full(1 << self.bits, blocks, np.int32)
        for k in range(blocks):  # the block that ends k bytes before the end of the first m
            at = self.first + self.m - size - k
            np.minimum.at(self.shift, self.block(self.data, at), k)
        self.tail = self.block(self.data, self.first + self.m - size)
        self.order = np.argsort(self.tail, kind="stable")
        self.sorted_tail = self.tail[self.order]

    def block(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(data) < self.size:
            return np.zeros(0, np.int64)
        wide = np.lib.stride_tricks.as_strided(data, (len(data) - self.size + 1, self.size), (1, 1))
        word = np.ascontiguousarray(wide[at]).view(np.uint64 if self.size == 8 else np.uint16)[:, 0].astype(np.uint64)
        return ((word * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in text, number of the string) of all occurrences."""
        m, n = self.m, len(text)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        # cursors stand on ends (exclusive) of windows; lane i has the ends in [bound[i], bound[i + 1])
        lanes = int(max(1, min(LANES, n // (4 * m))))
        bound = np.linspace(m, n + 1, lanes + 1).astype(np.int64)
        at, stop = bound[:-1].copy(), bound[1:].copy()
        live = at < stop
        at, stop = at[live], stop[live]
        starts, which = [none], [none]
        while len(at):
            h = self.block(text, at - self.size)
            shift = self.shift[h]
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                s, w = self.confirm(text, at[hit] - m, h[hit])
                starts.append(s)
                which.append(w)
            at = at + np.maximum(shift, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return np.concatenate(starts), self.number[np.concatenate(which)]

    def confirm(self, text: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.sorted_tail, h), np.searchsorted(self.sorted_tail, h, "right")
        size = hi - lo
        s = np.repeat(start, size)
        k = np.arange(len(s)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        w = self.order[k]
        ok = s + self.length[w] <= len(text)
        s, w = s[ok], w[ok]
        # first the blocks at the front, then all bytes of what is left
        front = self.block(text, s) == self.block(self.data, self.first[w])
        s, w = s[front], w[front]
        same = (text[a : a + n].tobytes() == self.data[f : f + n].tobytes() for a, n, f in zip(s.tolist(), self.length[w].tolist(), self.first[w].tolist()))
        same = np.fromiter(same, bool, len(s))
        return s[same], w[same]


class WuManber:
    """Search for a list of byte strings of SHORT_BLOCK bytes at least, with tables for each class of lengths."""

    def __init__(self, strings: list[bytes]):
        self.strings = sorted(set(strings))
        if any(len(s) < SHORT_BLOCK for s in self.strings):
            raise ValueError(f"a test string has fewer than {SHORT_BLOCK} bytes")
        of = np.searchsorted(CLASSES, [len(s) for s in self.strings], "right")
        self.tables = [Tables([self.strings[i] for i in np.flatnonzero(of == c)], np.flatnonzero(of == c), SHORT_BLOCK if c == 1 else BLOCK) for c in np.unique(of)]

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in text, number of the string) of all occurrences."""
        found = [t.search(text) for t in self.tables]
        return np.concatenate([s for s, _ in found]), np.concatenate([w for _, w in found])

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "strings": None}  # the tables have the bytes


def test_strings(texts: list[str | None], window: int = WINDOW, least_words: int = LEAST_WORDS) -> dict[bytes, set[int]]:
    """Test strings, each between blanks, and the numbers of the items that have them."""
    data, first = compared(pa.array(texts, pa.large_string()))
    out: dict[bytes, set[int]] = {}
    for i in range(len(texts)):
        words = data[first[i] + 1 : first[i + 1]].tobytes().split()
        if len(words) < max(1, least_words):
            continue
        for k in range(max(1, len(words) - window + 1)):
            out.setdefault(b" " + b" ".join(words[k : k + window]) + b" ", set()).add(i)
    return out


def _parts(benchmark: DataFrame, by: str) -> list[DataFrame]:
    """The benchmark in parts of about PART_BYTES of text; rows of equal `by` stay together."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART_BYTES)
    return [benchmark] * n if n < 2 else [benchmark.where(F.pmod(F.xxhash64(by), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, strings, first_at) for every document and every item of which it holds a test string.

    One pass over the documents, without a shuffle, for every PART_BYTES of the benchmark."""
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("strings", T.LongType()), T.StructField("first_at", T.LongType())])
    found = [_leaks(docs, part, window, least_words, schema) for part in _parts(benchmark.select("item_id", "text").where("item_id is not null and text is not null"), "item_id")]
    found = [f for f in found if f is not None]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, least_words: int, schema: T.StructType) -> DataFrame | None:
    items = benchmark.orderBy("item_id", "text").collect()
    strings = test_strings([r.text for r in items], window, least_words)
    if not strings:
        return None
    finder = WuManber(list(strings))
    owners = [sorted({items[i].item_id for i in strings[s]}) for s in finder.strings]
    held = docs.sparkSession.sparkContext.broadcast((finder, owners))
    types = [pa.int64() if f.dataType == T.LongType() else None for f in schema.fields[:2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, owners = held.value
        for b in batches:
            ids, column = b.column("doc_id"), b.column("text")
            _, offsets = tc.buffers(column)
            found: dict[tuple[int, object], list] = {}
            for lo, hi in tc.chunks(offsets):
                text, first = compared(column.slice(lo, hi - lo))
                start, which = finder.search(text)
                row = np.searchsorted(first, start, "right") - 1
                for r, s, w in zip((row + lo).tolist(), (start - first[row] - 1).tolist(), which.tolist()):
                    for item in owners[w]:
                        have = found.setdefault((r, item), [set(), s])
                        have[0].add(w)
                        have[1] = min(have[1], s)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r for r, _ in found])),
                        pa.array([i for _, i in found], types[1]),
                        pa.array([len(v[0]) for v in found.values()], pa.int64()),
                        pa.array([v[1] for v in found.values()], pa.int64()),
                    ],
                    names=[f.name for f in schema.fields],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the rows that hold a test string; decided row by row, in one pass without a shuffle. Only texts go to Python."""
    small_batches(docs.sparkSession)
    for part in _parts(benchmark.select("text").where("text is not null"), "text"):
        strings = test_strings([r.text for r in part.collect()], window, least_words)
        if strings:
            docs = docs.where(_clean(docs.sparkSession, list(strings))(F.col("text")))
    return docs


def _clean(spark: SparkSession, strings: list[bytes]):
    held = spark.sparkContext.broadcast(WuManber(strings))

    def run(column: pa.Array) -> pa.Array:
        clean = np.ones(len(column), bool)
        _, offsets = tc.buffers(column)
        for lo, hi in tc.chunks(offsets):
            text, first = compared(column.slice(lo, hi - lo))
            start, _ = held.value.search(text)
            clean[np.searchsorted(first, start, "right") - 1 + lo] = False
        return pa.array(clean)

    return F.arrow_udf(run, "boolean")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_NORM = r"regexp_replace(lower({0}), '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+', ' ', 'g')"
OP5_SQL = f"""
WITH item AS (SELECT item_id, string_split(trim({_NORM.format("text")}), ' ') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
test AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(w[k + 1 : k + {WINDOW}], ' ') || ' ' AS s
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - {WINDOW - 1}))) AS k FROM item WHERE len(w) >= {LEAST_WORDS} AND w <> [''])),
doc AS (SELECT doc_id, ' ' || trim({_NORM.format("text")}) || ' ' AS t FROM documents)
SELECT doc_id, item_id, count(*) AS strings, min(strlen(split_part(t, s, 1))) AS first_at
FROM doc JOIN test ON contains(t, s) GROUP BY doc_id, item_id
"""
