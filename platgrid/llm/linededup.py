"""Line dedup by a segment-partition edit join.

Of lines that are within THRESHOLD edits of each other (over UTF-8 bytes; equal lines included) the first one in order of
(doc_id, line number) stays; a line goes from wherever it stands if an earlier line is within
THRESHOLD edits of it.  Of lines of fewer than LEAST_BYTES bytes only exact repeats go (without `short` none do); empty lines always stay.

Every distinct line is cut into THRESHOLD + 1 segments; two lines within the threshold share a segment at
nearly the same place.  Segments are index entries under (length, segment number, hash); each line probes the entries of its own and
the THRESHOLD lesser lengths with the substrings that the length difference leaves possible.  Lines that meet are made distinct by
key, so a line that stands everywhere meets others once.  Pairs
are verified with bit-parallel edit distance in a band of 2 * THRESHOLD + 1 diagonals, many pairs at a time.

A key under which more than HOT_PAIRS pairs would meet (dates, log heads, templates) is refined instead: what is left of its lines
beside the common segment is cut into THRESHOLD + 1 segments once more, of which one must agree too.  The cuts go where a
sample of the key's lines differs most; any cut finds all pairs.  That is repeated until no key is hot or its lines differ in too few places to be cut.

Defined results: rows always stay, with the lines that are left; a null text stays null, an empty one empty.  Rows of null
doc_id are neither searched nor changed.  Repeated rows of one doc_id and text are one document.  Lines of
equal 128-bit hash count as equal.  n_chars, if there, becomes the length of the new text; all other columns are
carried through, whatever they are called (lines_removed is replaced, if asked for).  Lines are cut at line feeds alone.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import small_batches, stored, table

THRESHOLD = 2
LEAST_BYTES = 24
#: Pairs that may meet under one key before it is refined; distinct rows of a key that a task holds; lines that decide where a hot key is cut.
HOT_PAIRS = 1 << 16
HOT_ROWS = 1 << 14
SAMPLE = 64
#: Hashes of lines that a task remembers so as to send the keys of each once.
REMEMBERED = 1 << 18

_SALT = np.uint64(0xC2B2AE3D27D4EB4F)
_SECOND = 0x2545F4914F6CDD1D | 1


class Lines:
    """Lines of LEAST_BYTES bytes at least of a string column's chunk: row, number, bounds and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int = LEAST_BYTES):
        n = len(data)
        cut = data == 10
        edge = np.zeros(n + 1, bool)
        edge[1:] = cut
        edge[offsets[:-1]] = True
        start = np.flatnonzero(edge[:n]) if n else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, start, "right") - 1
        stop = np.empty(len(start), np.int64)
        if len(start):
            stop[:-1] = start[1:]
            stop[-1] = n
            last = np.ones(len(start), bool)
            last[:-1] = row[1:] != row[:-1]
            stop[last] = offsets[row[last] + 1]
            stop -= cut[stop - 1] & (stop > start)
        number = np.arange(len(start)) - np.searchsorted(row, row)
        long = stop - start >= least
        self.data, self.start, self.stop, self.row, self.number = data, start[long], stop[long], row[long], number[long]
        self.length = self.stop - self.start
        self.prefix, self.down = self._prefix(tc.BASE)
        self.h1 = self.hash(self.start, self.stop)

    def _prefix(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        up, down = tc.powers(base, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        return prefix, down

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tc.mix((self.prefix[b] - self.prefix[a]) * self.down[a])

    def second_hash(self) -> np.ndarray:
        prefix, down = self._prefix(_SECOND)
        return tc.mix((prefix[self.stop] - prefix[self.start]) * down[self.start] + self.length.astype(np.uint64))


def cuts(length: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offset, size) of the threshold + 1 segments of lines of these lengths; the later ones take the remainder."""
    size, more = np.divmod(length, threshold + 1)
    out, at = [], np.zeros_like(length)
    for i in range(threshold + 1):
        own = size + (i >= threshold + 1 - more)
        out.append((at, own))
        at = at + own
    return out


def segment_keys(lines: Lines, of: np.ndarray, threshold: int, least: int) -> tuple[np.ndarray, ...]:
    """(key, line, start, start in the index line, size, index length) of all entries and probes of the lines numbered in `of`.

    The last bit of a key tells probes from index entries. An entry also serves as its line's probe of its own place."""
    start, length = lines.start[of], lines.length[of]
    out = []
    for less in range(threshold + 1):
        ok = np.flatnonzero(length - less >= least)
        total = length[ok] - less
        for i, (at, size) in enumerate(cuts(total, threshold)):
            # an occurrence shifted by s leaves |s| edits to the left and |less - s| to the right
            for s in range(max(-i, less - threshold + i), min(i, less + threshold - i) + 1):
                fits = (at + s >= 0) & (at + s + size <= length[ok])
                a, n, m = (at + s)[fits], size[fits], total[fits]
                first = start[ok][fits] + a
                key = tc.mix(lines.hash(first, first + n) ^ ((m * (threshold + 1) + i).astype(np.uint64) * _SALT))
                out.append(((key & ~np.uint64(1)) | np.uint64(less > 0 or s != 0), of[ok[fits]], a, at[fits], n, m))
    return tuple(np.concatenate(x) for x in zip(*out))


def meeting(most_pairs: int, most_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that gives rows (a, b, hot) of batches (key, h1) sorted by key: pairs of lines a < b that meet, or, where hot, line a and key b of a hot key."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        key, h, hot = none, none, None  # what is held back of the last key; the key that was found hot

        def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

        def distinct(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((h, key))
            key, h = key[order], h[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            return key[new], h[new]

        def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = key >> 1
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            return first, np.diff(np.append(first, len(key)))

        def pairs(key: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            first, size = groups(key)
            some = np.repeat((size > 1) & (key[first] & 1 == 0), size)  # without an index entry nothing meets
            key, h = distinct(key[some], h[some])
            if not len(key):
                return
            first, size = groups(key)
            index = key & 1 == 0
            n = np.add.reduceat(index, first).astype(np.int64)
            many = n * (n - 1) // 2 + n * (size - n)
            if (many > most_pairs).any():
                of = np.repeat(many > most_pairs, size)
                yield out(h[of], key[of], True)
            # an index entry meets every row of its key behind it
            behind = np.where(index & np.repeat(many <= most_pairs, size), np.repeat(first + size, size) - 1 - np.arange(len(key)), 0)
            for lo, hi in tc.chunks(np.concatenate([[0], np.cumsum(behind)]), 1 << 20):
                left = np.repeat(np.arange(lo, hi), behind[lo:hi])
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind[lo:hi]) - behind[lo:hi], behind[lo:hi])
                a, b = np.minimum(h[left], h[right]), np.maximum(h[left], h[right])
                a, b = distinct(a[a < b], b[a < b])
                yield out(a, b, False)

        for batch in batches:
            k, x = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if hot is not None:  # more rows of a key that was too large to hold
                n = int(np.searchsorted(k >> 1, hot, "right"))
                if n:
                    k0, x0 = distinct(k[:n], x[:n])
                    yield out(x0, k0, True)
                    k, x = k[n:], x[n:]
                if len(k):
                    hot = None
            key, h = np.concatenate([key, k]), np.concatenate([h, x])
            if not len(key):
                continue
            last = int(np.searchsorted(key >> 1, key[-1] >> 1))
            yield from pairs(key[:last], h[:last])
            key, h = key[last:], h[last:]
            if len(key) > most_rows:
                key, h = distinct(key, h)
                if len(key) > most_rows:
                    hot = int(key[0] >> 1)
                    yield out(h, key, True)
                    key, h = none, none
        yield from pairs(key, h)

    return meet


def gaps_of(key: int, keys: dict[int, tuple[int, int, int, int, int]]) -> list[int]:
    """What a line has beside the segment of that key: [from, to) in the index line and [from, to) in the line itself, for each side."""
    a, at, n, total, length = keys[key]
    return [0, at, 0, a, at + n, total, a + n, length]


def refined(key: int, line: bytes, gaps: list[int], segments: list[int], threshold: int) -> Iterator[tuple[int, list[int]]]:
    """(key, gaps) of a hot key's line, for segments [gap, from, to) of the index line."""
    probe = key & 1
    quads = [gaps[i : i + 4] for i in range(0, len(gaps), 4)]
    spent = sum(abs((q[3] - q[2]) - (q[1] - q[0])) for q in quads)
    if spent > threshold:
        return
    for j in range(0, len(segments), 3):
        g, a, b = segments[j : j + 3]
        xa, xb, ya, yb = quads[g]
        d = (yb - ya) - (xb - xa)
        for s in range(-threshold, threshold + 1) if probe else (0,):
            at = ya + a - xa + s
            if abs(s) + abs(d - s) > threshold - spent + abs(d) or at < ya or at + b - a > yb:
                continue
            own = xxhash.xxh64_intdigest(line[at : at + b - a], seed=((key >> 1) * 31 + j) & tc.MASK)
            own = ((own & ~1) | probe) - (1 << 64 if own >> 63 else 0)
            parts = [[xa, a, ya, at], [b, xb, at + b - a, yb]]
            yield own, [v for q in [*quads[:g], *parts, *quads[g + 1 :]] if q[1] > q[0] or q[3] > q[2] for v in q]


def where_to_cut(lines: list[bytes], gaps: list[int], threshold: int) -> list[int]:
    """threshold + 1 segments [gap, from, to) of index lines of one key, with a like share of what tells the lines apart; none if they differ in too few places."""
    place = [(g, p) for g in range(len(gaps) // 4) for p in range(gaps[4 * g], gaps[4 * g + 1])]
    if not place:
        return []
    matrix = np.array([[x[p] for _, p in place] for x in lines], np.uint8)
    weight = np.zeros(len(place))
    for i in range(len(place)):
        share = np.unique(matrix[:, i], return_counts=True)[1] / len(lines)
        weight[i] = -(share * np.log(share)).sum()
    if (weight > 1e-9).sum() <= threshold:
        return []
    upto = np.cumsum(weight)
    part = np.minimum(((upto - weight / 2) / upto[-1] * (threshold + 1)).astype(int), threshold)
    out: list[int] = []
    for k in range(threshold + 1):
        best = (0.0, 0, 0, 0)
        for g in range(len(gaps) // 4):
            own = [i for i in np.flatnonzero(part == k) if place[i][0] == g]
            if own:
                best = max(best, (float(weight[own].sum()), g, place[own[0]][1], place[own[-1]][1] + 1))
        if best[0] <= 1e-9:
            return []
        out += best[1:]
    return out


def within(a: list[bytes], b: list[bytes], threshold: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most threshold; bit-parallel in a band, all pairs in step.

    Bit 2 * threshold of a lane's word is the lower edge of the band; the band slides down one row for each byte."""
    out = np.zeros(len(a), bool)
    long = [x if len(x) >= len(y) else y for x, y in zip(a, b)]
    short = [y if len(x) >= len(y) else x for x, y in zip(a, b)]
    size = np.array([len(x) for x in long], np.int64)
    fit = np.flatnonzero(size - np.array([len(x) for x in short], np.int64) <= threshold) if len(a) else np.zeros(0, np.int64)
    order = fit[np.argsort(size[fit], kind="stable")]
    at = 0
    while at < len(order):
        # lanes of like lengths, within a bound on the bytes of their matrix
        end = at + 1
        while end < len(order) and size[order[end]] <= size[order[at]] * 1.25 + 16 and (end - at) * size[order[end]] < 1 << 24:
            end += 1
        lanes = order[at:end]
        out[lanes] = _band([long[i] for i in lanes], [short[i] for i in lanes], threshold)
        at = end
    return out


def _band(long: list[bytes], short: list[bytes], t: int) -> np.ndarray:
    m, n = np.array([len(x) for x in long]), np.array([len(x) for x in short])
    width, height = int(n.max(initial=0)), int(m.max(initial=0))
    # rows are bytes of the text; column of the pattern matrix is shifted by t, so that rows above the start match nothing
    p = np.zeros((height + 2 * t + 1 + width, len(long)), np.int16) - 1
    s = np.zeros((width, len(long)), np.int16) - 2
    for k, (x, y) in enumerate(zip(long, short)):
        p[t : t + len(x), k] = np.frombuffer(x, np.uint8)
        s[: len(y), k] = np.frombuffer(y, np.uint8)
    one = np.uint64(1)
    low = np.uint64(2 * t)
    vp = np.full(len(long), sum(1 << k for k in range(t, 2 * t + 1)), np.uint64)
    vn = np.zeros(len(long), np.uint64)
    mask = np.uint64((1 << (2 * t + 1)) - 1)
    dist = np.full(len(long), t, np.int64)
    for i in range(width):
        x = np.zeros(len(long), np.uint64)
        for k in range(2 * t + 1):
            x |= (p[i + k] == s[i]).astype(np.uint64) << np.uint64(k)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        live = i < n
        diagonal = i < m - t  # the lower edge still slides down; afterwards it runs along the last row
        dist += (live & diagonal & ((d0 >> low) & one == 0)).astype(np.int64)
        bit = np.where(diagonal, 0, 2 * t - 1 - (i - np.maximum(m - t, 0))).clip(0, 63).astype(np.uint64)
        level = live & ~diagonal
        dist += (level & ((hp >> bit) & one == 1)).astype(np.int64)
        dist -= (level & ((hn >> bit) & one == 1)).astype(np.int64)
        down = d0 >> one
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
    return dist <= t


def _chunked(column: pa.Array, least: int) -> Iterator[tuple[int, Lines]]:
    data, offsets = tc.buffers(column)
    for a, b in tc.chunks(offsets):
        yield a, Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def dropped(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST_BYTES, short: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): the rows of docs as (doc_id, row), and the lines that go as (doc_id, drop list of (line, h1))."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"]
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    counted = 1 if short else least

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in _chunked(b.column("text"), counted):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(x.row + a)), pa.array(x.number.astype(np.int32)), _signed(x.h1), _signed(x.second_hash())], names=["doc_id", "line", "h1", "h2"])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, x in _chunked(b.column("text"), counted):
                doc = b.column("doc_id").take(pa.array(x.row + a))
                h2 = x.second_hash()
                order = np.lexsort((x.number, pc.rank(doc, tiebreaker="dense").to_numpy(), h2, x.h1))  # first doc and line in front
                h1, h2 = x.h1[order], h2[order]
                new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else order
                count = np.diff(np.append(new, len(h1)))
                at = order[new]
                yield pa.RecordBatch.from_arrays([_signed(h1[new]), _signed(h2[new]), doc.take(pa.array(at)), pa.array(x.number[at].astype(np.int32)), pa.array(count.astype(np.int64))], names=["h1", "h2", "doc_id", "line", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for _, x in _chunked(b.column("text"), least):
                own, of = np.unique(x.h1, return_index=True)
                new = seen[np.searchsorted(seen, own).clip(max=len(seen) - 1)] != own if len(seen) else np.ones(len(own), bool)
                seen = np.union1d(seen, own) if len(seen) + len(own) <= REMEMBERED else own
                key, line, *_ = segment_keys(x, of[new], threshold, least)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(x.h1[line])], names=["key", "h1"])

    occ = texts.mapInArrow(occurrences, T.StructType([kind, T.StructField("line", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
    # a line that stands everywhere is counted once for each chunk before it moves; the exchange by h1 alone serves all joins below,
    # in which "^ ... = 0" compares the second hashes without making them part of the join's key
    per_chunk = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), kind, T.StructField("line", T.IntegerType()), T.StructField("n", T.LongType())])
    distinct = texts.mapInArrow(combined, per_chunk).repartition("h1").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.sum("n").alias("n"))
    met = _meet(texts.mapInArrow(keys, "key bigint, h1 bigint"))
    met = stored(met, "line-pairs")
    pairs, hot = met.where("not hot").select("a", "b"), met.where("hot").select(F.col("b").alias("key"), F.col("a").alias("h1")).distinct()
    firsts = distinct.select("h1", "h2", "first")
    any_hot = not hot.isEmpty()
    lines = pairs.select(F.explode(F.array("a", "b")).alias("h1"))
    wanted = (lines.union(hot.select("h1")) if any_hot else lines).distinct().join(firsts, "h1")
    wanted = wanted.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line", "h1", "h2")).alias("want"))
    # both uses of rows ask for the same columns and filter, so that one shuffle of the texts serves both
    rows = docs.where("doc_id is not null").select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index("text")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            texts = b.column("row").field(at)
            have: dict[tuple[int, int], tuple[int, int]] = {}
            for a, x in _chunked(texts, least):
                have |= {(r + a, k): h for r, k, h in zip(x.row.tolist(), x.number.tolist(), zip(x.h1.view(np.int64).tolist(), x.start.tolist(), x.stop.tolist()))}
            for r, (doc, want) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("want").to_pylist())):
                lines = None
                for w in want:
                    if have.get((r, w["line"]), (None,))[0] == w["h1"]:
                        lines = lines or texts[r].as_py().encode().split(b"\n")
                        for o, v in zip(out, (w["h1"], w["h2"], doc, w["line"], lines[w["line"]])):
                            o.append(v)
            kinds = (pa.int64(), pa.int64(), b.column("doc_id").type, pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["h1", "h2", "doc_id", "line", "bytes"])

    bare = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), kind, T.StructField("line", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
    got = rows.join(wanted, "doc_id").select("doc_id", "row", "want").mapInArrow(fetch, bare)
    got = got.select("h1", F.struct("doc_id", "line").alias("first"), "h2", "bytes").distinct()
    if any_hot:
        got = stored(got, "line-bytes")
        pairs = pairs.union(_hot_pairs(hot, got.select("h1", "bytes").dropDuplicates(["h1"]), threshold, least))
    pairs = pairs.distinct()
    left = pairs.join(got.select(F.col("h1").alias("a"), F.struct("first", "h2", "bytes").alias("x")), "a")
    met = left.join(got.select(F.col("h1").alias("b"), F.struct("first", "h2", "bytes").alias("y")), "b")
    met = met.select("a", "b", F.col("x.h2").alias("a2"), F.col("y.h2").alias("b2"), F.expr("x.first < y.first").alias("a_first"), F.col("x.bytes").alias("x"), F.col("y.bytes").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = within(b.column("x").to_pylist(), b.column("y").to_pylist(), threshold)
            later = np.asarray(b.column("a_first"))
            h1 = np.where(later, b.column("b").to_numpy(), b.column("a").to_numpy())
            h2 = np.where(later, b.column("b2").to_numpy(), b.column("a2").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h1[ok]), pa.array(h2[ok])], names=["l1", "l2"])

    later = met.mapInArrow(verify, "l1 bigint, l2 bigint").distinct().withColumn("later", F.lit(True))
    verdict = distinct.join(later, F.expr("h1 = l1 and (h2 ^ l2) = 0"), "left").where("n > 1 or later")
    verdict = verdict.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "first", "later")
    gone = occ.join(verdict, F.expr("h1 = v1 and (h2 ^ v2) = 0")).where("later or first <> struct(doc_id, line)")
    return rows, gone.groupBy("doc_id").agg(F.collect_set(F.struct("line", "h1")).alias("drop"))


def _meet(keyed: DataFrame) -> DataFrame:
    """What meets of rows (key, h1); one exchange, by key."""
    spread = keyed.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return spread.mapInArrow(meeting(HOT_PAIRS, HOT_ROWS), "a bigint, b bigint, hot boolean")


def _hot_pairs(hot: DataFrame, lines: DataFrame, threshold: int, least: int) -> DataFrame:
    """Pairs (a, b) that meet under the hot keys of hot (key, h1), by refining them; lines has the bytes of every h1."""

    def first_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [bytes(x) for x in b.column("bytes").to_pylist()]
            bound = np.concatenate([[0], np.cumsum([len(x) for x in text])]).astype(np.int64)
            x = Lines(np.frombuffer(b"".join(text), np.uint8), bound, 1)
            key, line, a, at, n, total = (v.tolist() for v in segment_keys(x, np.arange(len(text)), threshold, least))
            keys: list[dict] = [{} for _ in text]
            for i, k in enumerate(key):
                keys[line[i]][k - (1 << 64 if k >> 63 else 0)] = (a[i], at[i], n[i], total[i], len(text[line[i]]))
            gaps = [gaps_of(k, keys[r]) for r, k in enumerate(b.column("key").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h1"), pa.array(gaps, pa.list_(pa.int32()))], names=["key", "h1", "gaps"])

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"of": [key[0]], "segments": [where_to_cut([bytes(x) for x in pdf["bytes"]], list(pdf["gaps"].iloc[0]), threshold)]})

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids, gaps = [], [], []
            for key, h1, line, own, segments in zip(*(b.column(c).to_pylist() for c in ("key", "h1", "bytes", "gaps", "segments"))):
                for k, g in refined(key, bytes(line), own, segments, threshold):
                    keys.append(k)
                    ids.append(h1)
                    gaps.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(gaps, pa.list_(pa.int32()))], names=["key", "h1", "gaps"])

    schema = "key bigint, h1 bigint, gaps array<int>"
    state = stored(hot.join(lines, "h1").select("key", "h1", "bytes").mapInArrow(first_gaps, schema), "line-hot")
    found = None
    while True:
        state = state.withColumn("of", F.shiftright("key", 1))
        ranked = state.where("key % 2 = 0").withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("h1")))).where(f"n <= {SAMPLE}")
        cuts = ranked.join(lines, "h1").select("of", "gaps", "bytes").groupBy("of").applyInPandas(cut, "of bigint, segments array<int>")
        cuts = stored(cuts, "line-cuts")
        # lines that differ in no more than `threshold` places of the sample cannot be told apart by segments: they all meet
        alike = state.join(cuts.where("size(segments) = 0").select("of"), "of", "left_semi").select("of", "key", "h1")
        both = alike.where("key % 2 = 0").select("of", F.col("h1").alias("a")).join(alike.select("of", F.col("h1").alias("b")), "of").where("a <> b")
        own = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        finer = state.join(cuts.where("size(segments) > 0"), "of").join(lines, "h1").select("key", "h1", "bytes", "gaps", "segments").mapInArrow(refine, schema)
        finer = stored(finer, "line-finer")
        met = stored(_meet(finer.select("key", "h1")), "line-met")
        own = own.union(met.where("not hot").select("a", "b"))
        found = own if found is None else found.union(own)
        hot = met.where("hot").select(F.col("b").alias("key"), F.col("a").alias("h1")).distinct()
        if hot.isEmpty():
            return found
        state = stored(finer.join(hot, ["key", "h1"], "left_semi"), "line-hot")


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST_BYTES, count: bool = False, short: bool = True) -> DataFrame:
    """docs without the lines that an earlier line nearly equals; with count, also lines_removed; with short, exact repeats of lines under `least` bytes go too."""
    docs = docs.drop("lines_removed") if count else docs
    rows, drops = dropped(docs, threshold, least, short)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            cols = [row.field(i) for i in range(len(names))]
            drop = b.column("drop").to_pylist()
            text = cols[at].to_pylist()
            sizes = cols[chars].to_pylist() if chars is not None else None
            removed = [0] * len(text)
            hit = [r for r, d in enumerate(drop) if d and text[r] is not None]
            part = pa.array([text[r] for r in hit], pa.large_string())
            have: dict[int, dict[int, int]] = {}
            for a, x in _chunked(part, 1 if short else least):
                for r, k, h in zip(x.row.tolist(), x.number.tolist(), x.h1.view(np.int64).tolist()):
                    have.setdefault(r + a, {})[k] = h
            for i, r in enumerate(hit):
                own = have.get(i, {})
                out = {d["line"] for d in drop[r] if own.get(d["line"]) == d["h1"]}
                lines = text[r].split("\n")
                text[r] = "\n".join(x for k, x in enumerate(lines) if k not in out)
                removed[r] = len(out)
                if sizes is not None:
                    sizes[r] = len(text[r])
            cols[at] = pa.array(text, cols[at].type)
            if sizes is not None:
                cols[chars] = pa.array(sizes, cols[chars].type)
            more = [pa.array(removed, pa.int64())] if count else []
            yield pa.RecordBatch.from_arrays([*cols, *more], names=[f"c{i}" for i in range(len(cols) + len(more))])

    fields = [*docs.schema.fields, *([T.StructField("lines_removed", T.LongType())] if count else [])]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    joined = rows.join(drops, "doc_id", "left").select("row", "drop")
    out = joined.mapInArrow(strip, schema).toDF(*[f.name for f in fields])
    nameless = docs.where("doc_id is null")
    return out.union(nameless.withColumn("lines_removed", F.lit(0).cast("bigint")) if count else nameless)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), count=True)


OP4_SQL = f"""
WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
d AS (SELECT x, min((doc_id, line)) AS first, strlen(x) AS n FROM o WHERE strlen(x) > 0 GROUP BY x),
later AS (SELECT DISTINCT b.x FROM d a JOIN d b ON a.n >= {LEAST_BYTES} AND b.n >= {LEAST_BYTES} AND a.n BETWEEN b.n - {THRESHOLD} AND b.n + {THRESHOLD} AND a.first < b.first AND levenshtein(a.x, b.x) <= {THRESHOLD}),
k AS (SELECT o.doc_id, o.line, o.x, d.x IS NULL OR (d.first = (o.doc_id, o.line) AND later.x IS NULL) AS keep
  FROM o LEFT JOIN d ON d.x = o.x LEFT JOIN later ON later.x = o.x)
SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE keep), '') AS text, count(*) FILTER (WHERE NOT keep) AS lines_removed
FROM k GROUP BY doc_id
"""
