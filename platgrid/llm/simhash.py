"""SimHash near-dedup: exact comparison of fingerprints by tiles and segments.

A fingerprint has 256 bits; each bit is the majority vote of the hashes of a text's distinct words and
distinct pairs of neighbouring words.  Fingerprints are sorted by population count and cut into tiles; two
tiles whose ranges of population counts lie further apart than the radius can hold no pair and are skipped,
every other pair of tiles is compared.  The radius is shared out among the words of a fingerprint and the
segments of a word: a pair within it has a segment within that segment's share, in a word within the word's, so
only fingerprints whose segments are that near meet, by an index on each segment.  What meets is compared with
exclusive-or and bit counts, small tiles whole.  No pair within the radius is lost.  A task reports only a
spanning forest of the pairs that it found, so a group of thousands of copies gives thousands of edges, not
millions; the groups are the connected components.

Defined results: texts without a word (null, empty, punctuation only) have no fingerprint and never count as
copies.  Rows of null doc_id are never compared and always kept.  Equal texts under several ids, and
repeated rows of one id, are copies: of a group stays the row of the least doc_id (of repeated rows of that
id, one).  Ids may be of any type that has an order.  Of repeated rows that differ in other columns any one stays.  Extra columns are carried through; internal names start with "_sh_".  Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import checkpoint, small_batches, stored, table

WORDS = 4
BITS = 64 * WORDS
#: Greatest Hamming distance of near copies, of BITS.
RADIUS = 56
#: Fingerprints in a tile, about (21 MB with their ids; the fewer tiles, the less often each one moves, and the fuller are a segment's buckets).
TILE_ROWS = 524288
#: Tasks that compare, at least, where there are pairs enough; the segments of a pair of tiles are divided among tasks for it.
LEAST_UNITS = 20
#: Rows and columns of a block that is compared at once, to stay in the processor's cache.
BLOCK = (16, 4096)
#: Pairs that meet are checked so many at a time, about.
HITS = 1 << 20

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _votes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row range of first: how many of its hashes have each of the 64 bits set."""
    rows = len(first) - 1
    out = np.zeros((rows, 64), np.int64)
    if not len(h):
        return out
    # counters of 8 bits, so sums of at most 255 hashes at a time
    length = np.diff(first)
    parts = -(-length // 255)
    row = np.repeat(np.arange(rows), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[row] + 255 * k
    by = h.view(np.uint8).reshape(-1, 8)
    counts = np.empty((len(start), 64), np.uint8)
    for i in range(8):
        counts[:, 8 * i : 8 * i + 8] = np.add.reduceat(_SPREAD[by[:, i]], start).view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(parts)
    out[full] = np.add.reduceat(counts, (np.cumsum(parts) - parts)[full], axis=0, dtype=np.int64)
    return out


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, WORDS) uint64 fingerprints and whether each text has a word."""
    out = np.zeros((len(column), WORDS), np.uint64)
    some = np.zeros(len(column), bool)
    for a, b, t in tc.tokenised(pa.compute.utf8_lower(column)):
        pair = np.flatnonzero(t.left() > 1)
        h = np.concatenate([t.hash, tc.mix(t.hash[pair] * np.uint64(0x9E3779B97F4A7C15) + t.hash[pair + 1])])
        row = np.concatenate([t.row, t.row[pair]]).astype(np.uint64)
        # a chunk has fewer than 2**21 rows; 43 bits tell the features of one text apart
        key = np.sort((row << np.uint64(43)) | (h >> np.uint64(21)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        first = np.searchsorted(key, np.arange(t.rows + 1).astype(np.uint64) << np.uint64(43))
        h = key & np.uint64((1 << 43) - 1)
        n = np.diff(first)
        some[a:b] = n > 0
        for w in range(WORDS):
            v = _votes(tc.mix(h + np.uint64((w * 0xA24BAED4963EE407) & tc.MASK)), first)
            out[a:b, w] = np.packbits(2 * v > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, some


def _shares(radius: int, parts: int) -> list[int]:
    """Radii of the parts: what lies beyond each of them lies beyond radius in all. -1: such a part holds no pair of its own."""
    each, more = divmod(radius + 1, parts)
    return [each + (i < more) - 1 for i in range(parts)]


def segments(radius: int, cuts: int) -> list[tuple[int, int, int, int, int]]:
    """(word, shift, bits, radius of the segment, radius of the word), with each word cut in so many segments; costly ones first.

    Every pair within radius is, for one of these at least, within both of its radii."""
    found = []
    for word, whole in enumerate(_shares(radius, WORDS)):
        shift = 0
        for i, own in enumerate(_shares(whole, cuts)):
            bits = 64 // cuts + (i < 64 % cuts)
            if own >= 0:
                found.append((word, shift, bits, own, whole))
            shift += bits
    return sorted(found, key=lambda s: (-s[3], s))


def best_cuts(m: int, n: int, radius: int) -> int:
    """Into how many segments words are best cut for m and n rows; 0: better compare all. From measured nanoseconds."""

    def cost(cuts: int) -> float:
        total = 0.0
        for _, _, bits, own, _ in segments(radius, cuts):
            near = sum(math.comb(bits, i) for i in range(min(own, bits) + 1))
            share = near / 2**bits
            total += 1.3 * m * n * share + min(m, 2**bits) * (25000 + 10 * near + 6 * n * share)
        return total

    least, cuts = min((cost(c), c) for c in range(4, 9))
    return cuts if least < 5.0 * m * n else 0


def _all_blocks(a: np.ndarray, b: np.ndarray, radius: int, same: bool, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row of a (of this part) with every row of b."""
    at, bt = np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)[:, None, :]
    dense = WORDS - 1  # three quarters of the bits rule out all but few pairs
    shape = (min(BLOCK[0], len(a)), min(BLOCK[1], len(b)))
    xor, count, dist = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    for i in range(BLOCK[0] * part, len(a), BLOCK[0] * parts):
        for j in range(i - i % BLOCK[1] if same else 0, len(b), BLOCK[1]):
            x, y = at[:, i : i + BLOCK[0]], bt[:, :, j : j + BLOCK[1]]
            at_, of = slice(0, x.shape[1]), slice(0, y.shape[2])
            v, c, d = xor[at_, of], count[at_, of], dist[at_, of]
            np.bitwise_count(np.bitwise_xor(x[0], y[0], out=v), out=d)
            for w in range(1, dense):
                np.bitwise_count(np.bitwise_xor(x[w], y[w], out=v), out=c)
                np.add(d, c, out=d)
            if d.min() > radius:
                continue
            p, q = np.nonzero(d <= radius)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            ok = np.bitwise_count(a[p] ^ b[q]).sum(1, dtype=np.int64) <= radius
            yield p[ok], q[ok]


def _meet(a: np.ndarray, b: np.ndarray, segment: tuple[int, int, int, int, int], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b within the two radii of the segment; same: each pair once."""
    word, shift, bits, own, whole = segment

    def index(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = t[:, word]
        key = ((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int32)
        order = np.argsort(key, kind="stable")
        return x[order], order, np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << bits))])

    xs, of_a, first_a = index(a)
    ys, of_b, first_b = (xs, of_a, first_a) if same else index(b)
    near = np.arange(1 << bits)
    near = near[np.bitwise_count(near) <= own]
    cells = BLOCK[0] * BLOCK[1]
    xor, dist, low = np.empty(cells, np.uint64), np.empty(cells, np.uint8), np.empty(cells, bool)
    left, right, held = [], [], 0

    def hits() -> tuple[np.ndarray, np.ndarray]:
        p, q = np.concatenate(left), np.concatenate(right)
        if not same:
            return of_a[p], of_b[q]
        p, q = of_a[p[p < q]], of_b[q[p < q]]  # places in order: of two buckets the later one is the partner
        return np.minimum(p, q), np.maximum(p, q)

    for v in np.flatnonzero(np.diff(first_a)).tolist():
        to = near ^ v
        if same:
            to = to[to >= v]
        start = first_b[to]
        n = first_b[to + 1] - start
        end = np.cumsum(n)
        total = int(end[-1])
        if not total:
            continue
        place = np.repeat(start - (end - n), n)
        place += np.arange(total)
        y = ys[place]
        i0, i1 = int(first_a[v]), int(first_a[v + 1])
        rows = min(i1 - i0, max(1, cells // min(total, BLOCK[1])))
        for i in range(i0, i1, rows):
            x = xs[i : min(i + rows, i1), None]
            for j in range(0, total, cells // len(x)):
                z = y[j : j + cells // len(x)]
                size = len(x) * len(z)
                np.bitwise_xor(x, z, out=xor[:size].reshape(len(x), len(z)))
                np.bitwise_count(xor[:size], out=dist[:size])
                hit = np.flatnonzero(np.less_equal(dist[:size], whole, out=low[:size]))
                if len(hit):
                    p, q = np.divmod(hit, len(z))
                    left.append(p + i)
                    right.append(place[q + j])
                    held += len(hit)
                    if held >= HITS:
                        yield hits()
                        left, right, held = [], [], 0
    if held:
        yield hits()


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, part: int = 0, parts: int = 1, cuts: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of a and b within radius, by and by; same: a is b, and only i < j is given.

    Each pair is in just one of the parts, and there once. cuts: as of best_cuts, which also sets it."""
    if not len(a) or not len(b):
        return
    cuts = best_cuts(len(a), len(b), radius) if cuts is None else cuts
    if not cuts:
        yield from _all_blocks(a, b, radius, same, part, parts)
        return
    every = segments(radius, cuts)
    for k in range(part, len(every), parts):
        for p, q in _meet(a, b, every[k], same):
            x = a[p] ^ b[q]
            dist = np.bitwise_count(x)
            ok = dist.sum(1, dtype=np.int64) <= radius
            p, q, x, dist = p[ok], q[ok], x[ok], dist[ok]
            new = np.ones(len(p), bool)
            for word, shift, bits, own, whole in every[:k]:  # an earlier segment has given those
                differ = np.bitwise_count((x[:, word] >> np.uint64(shift)) & np.uint64((1 << bits) - 1))
                new &= (differ > own) | (dist[:, word] > whole)
            yield p[new], q[new]


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of near_pairs at once."""
    found = [(np.zeros(0, np.int64),) * 2, *near_pairs(a, b, radius, same)]
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(least node, node) for each of n nodes that the pairs connect with a lesser one; no more than some pairs are held at once."""
    top = np.arange(n)
    for p, q in pairs:
        p, q = top[p], top[q]
        edges = np.unique(np.minimum(p, q)[p != q] * n + np.maximum(p, q)[p != q])
        if len(edges):
            up, node = np.array(forest(n, edges // n, edges % n)).T
            top[node] = up
            top = top[top]
    node = np.flatnonzero(top != np.arange(n))
    return top[node], node


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (least node, node) that connect what the given ones connect."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        i, j = top(i), top(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [(top(x), x) for x in set(left.tolist()) | set(right.tolist()) if top(x) != x]


def components(edges: DataFrame) -> DataFrame:
    """(node, least node of its component) of all nodes of edges (u, v), by large and small stars in turns.

    Every round is written to the shared folder, so a lost executor costs no more than one round."""
    e = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the small star: all lesser neighbours and the node itself hang on the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = checkpoint(small.where("u <> v").distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("least")).union(e.select("v", "v").distinct())
        e = new


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the least doc_id of its group."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _groups(docs, radius)
    # other ids are numbered, and the numbers stored, as tiles hold whole numbers
    ids = stored(docs.select("doc_id").where("doc_id is not null").distinct().withColumn("_n", F.monotonically_increasing_id()), "simhash-ids")
    found = _groups(docs.join(ids, "doc_id").select(F.col("_n").alias("doc_id"), "text"), radius).toDF("_n", "_g").join(ids, "_n")
    return found.select("doc_id", "_g").join(found.groupBy("_g").agg(F.min("doc_id").alias("group_id")), "_g").select("doc_id", "group_id")


def _groups(docs: DataFrame, radius: int) -> DataFrame:
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, some = fingerprints(b.column("text"))
            keep = np.flatnonzero(some)
            raw = np.ascontiguousarray(f[keep]).view(f"S{8 * WORDS}")  # only a view of the bytes
            data = pa.py_buffer(raw.tobytes())
            fp = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * WORDS), len(keep), [None, data]).cast(pa.binary())
            count = np.bitwise_count(f[keep]).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep)), fp, pa.array(count)], names=["doc_id", "fp", "pop"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.BinaryType()), T.StructField("pop", T.IntegerType())])
    fps = stored(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(prints, schema).distinct(), "simhash")
    # one node for each distinct fingerprint, named by its least document
    nodes = fps.groupBy("fp", "pop").agg(F.min("doc_id").alias("node"))
    nodes = stored(nodes, "simhash-nodes")
    hist = nodes.groupBy("pop").count().orderBy("pop").collect()  # BITS + 1 rows at most
    total = sum(r["count"] for r in hist)
    tiles = max(1, -(-total // TILE_ROWS))
    before, spans = 0, {}
    low, high = [BITS] * tiles, [0] * tiles
    for r in hist:
        spans[r.pop] = (before, r["count"])
        for t in range(before * tiles // total, (before + r["count"] - 1) * tiles // total + 1):
            low[t], high[t] = min(low[t], r.pop), max(high[t], r.pop)
        before += r["count"]
    same = fps.join(nodes.select("fp", "node"), "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).where("u <> v")
    if total > 1:
        table_of = F.create_map(*[F.lit(x) for p, s in spans.items() for x in (p, s[0])])
        count_of = F.create_map(*[F.lit(x) for p, s in spans.items() for x in (p, s[1])])
        # the partners of a tile are those from start to stop; counts rise with the tiles
        stop = [bisect.bisect_right(low, h + radius) - 1 for h in high]
        start = [bisect.bisect_left(stop, t) for t in range(tiles)]
        offset = [0, *itertools.accumulate(s - t + 1 for t, s in enumerate(stop))]
        parts = max(1, min(-(-LEAST_UNITS // offset[-1]), total * total >> 27))

        def pack(t: pa.Table) -> pa.Table:
            f = np.frombuffer(b"".join(t["fp"].to_pylist()), np.uint64).reshape(-1, WORDS)
            order = np.lexsort(f.T)  # the same rows in the same order in each task, also if one is run again
            ids = pa.compute.cast(t["node"], pa.int64()).to_numpy()
            return pa.table({"tile": t["tile"][:1], "fps": pa.array([f[order].tobytes()], pa.binary()), "ids": pa.array([ids[order].tobytes()], pa.binary())})

        def at(values: list[int], tile: str) -> Column:
            return F.element_at(F.array(*map(F.lit, values)), F.col(tile) + 1)

        place = table_of[F.col("pop")] + F.pmod(F.xxhash64("fp"), count_of[F.col("pop")])
        packed = nodes.withColumn("place", place).selectExpr("fp", "node", f"cast(place * {tiles} div {total} as int) as tile")
        packed = packed.groupBy("tile").applyInArrow(pack, "tile int, fps binary, ids binary")
        # a tile goes once to each task that compares it
        sent = (
            packed.withColumn("turn", F.explode(F.sequence(F.lit(0), (at(stop, "tile") - at(start, "tile") + 1) * parts - 1)))
            .withColumn("other", at(start, "tile") + F.expr(f"cast(turn div {parts} as int)"))
            .withColumn("a", F.least("tile", "other"))
            .withColumn("b", F.greatest("tile", "other"))
            .withColumn("part", F.col("turn") % parts)
            .withColumn("unit", ((at(offset, "a") + F.col("b") - F.col("a")) * parts + F.col("part")).cast("int"))
            .select("unit", "part", "tile", "a", "b", "fps", "ids")
            .repartitionById(offset[-1] * parts, F.col("unit"))
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for k in range(batch.num_rows):
                    unit, part, tile, first, last = (batch.column(c)[k].as_py() for c in ("unit", "part", "tile", "a", "b"))
                    f = np.frombuffer(batch.column("fps")[k].as_buffer(), np.uint64).reshape(-1, WORDS)
                    ids = np.frombuffer(batch.column("ids")[k].as_buffer(), np.int64)
                    if first == last:
                        up, node = linked(len(f), near_pairs(f, f, radius, True, part, parts))
                    elif unit not in waiting:
                        waiting[unit] = tile, f, ids
                        continue
                    else:
                        (_, fa, ia), (_, fb, ib) = sorted([waiting.pop(unit), (tile, f, ids)], key=lambda x: x[0])
                        ids = np.concatenate([ia, ib])
                        up, node = linked(len(ids), ((p, q + len(fa)) for p, q in near_pairs(fa, fb, radius, False, part, parts)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[node]), pa.array(ids[up])], names=["u", "v"])

        same = same.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).union(sent.mapInArrow(compare, "u bigint, v bigint"))
    return components(same).select(F.col("node").cast(kind).alias("doc_id"), F.col("least").cast(kind).alias("group_id"))


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the copies: of each group the document of the least doc_id stays."""
    drop = groups(docs, radius).where("doc_id <> group_id").select("doc_id")
    kept = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    return _one_each(kept)


def _one_each(docs: DataFrame) -> DataFrame:
    """Repeated rows of one doc_id are copies of each other where the id has one text: one stays."""
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return known.union(docs.where("doc_id is null"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
