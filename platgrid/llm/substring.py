"""Substring dedup with a log-structured fingerprint index.

Found are passages of LEAST_WORDS words or more that stand, word by word, in an earlier document too; earlier is by batch, then by doc_id.
Words are runs of letters, digits and underscores in lower case, so case and punctuation do not matter.

Of the hashes of all windows of WINDOW words winnowing keeps the least of every SPAN neighbours, so two equal passages of
WINDOW + SPAN - 1 = LEAST_WORDS words keep a common one.  An index entry is such a hash, the hash of its
neighbourhood (WINDOW words, and SPAN - 1 more to either side) and the first place that has both.  The index is a list of immutable runs,
each a table bucketed and sorted by the window hash; a new batch is merge-joined with every run without moving the
runs, what is new becomes a run of its own, and when more than FANOUT runs of a level have gathered, they are compacted to one of the next level.
FingerprintIndex keeps its runs from session to session, and gives the verified passages of each batch.

A place whose neighbourhood is known is a candidate with the known place.  Where a hash gets a further neighbourhood, the hashes of all
windows of LEAST_WORDS words around the first places of all of them find the other candidates, so nothing depends on which place
happens to be first.  Every candidate is verified by comparing the words, and widened as far as they agree.

Defined results: a row is a run of equal words in doc_id and an earlier source_doc, [start_word, end_word) in words of doc_id; together the
rows of a document cover exactly the words that stand in some such passage.
Null, empty and shorter texts hold no passage; rows of null doc_id are left out.  Of repeated rows of one doc_id one counts;
equal texts under several ids give a passage each.  Ids may be of any type that has an order.  Repeats inside one document do not count.  Very long texts are
handled whole; extra columns are ignored, and empty tables give empty results.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import shared_dir, small_batches, stored, table

LEAST_WORDS = 50
WINDOW = 25
SPAN = LEAST_WORDS - WINDOW + 1
#: Buckets of every run; a power of two times the cores of the cluster does well.
BUCKETS = 48
FANOUT = 2
BATCHES = 4

_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
_UNSCRAMBLE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that leave a task at once.
FLUSH_BYTES = 4 << 20


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def winnow(t: tc.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the window, hash of its neighbourhood, number of its first token) of the kept windows of a chunk."""
    none = np.zeros(0, np.uint64)
    h, at = t.windows(WINDOW)
    if len(h) < SPAN:
        return none, none, np.zeros(0, np.int64)
    # the least hash wins, of equals the least scrambled place: so text that repeats itself keeps no more windows than other text
    bits = np.uint64(max(24, int(len(h)).bit_length()))
    place = np.arange(len(h), dtype=np.uint64)
    top = (np.uint64(1) << bits) - np.uint64(1)
    x = (h >> bits << bits) | (place * _SCRAMBLE & top)
    size, m = 1, x
    while size * 2 <= SPAN:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < SPAN:
        m = np.minimum(m[: len(x) - SPAN + 1], m[SPAN - size : SPAN - size + len(x) - SPAN + 1])
    whole = t.left()[at[: len(m)]] >= LEAST_WORDS
    kept = np.unique(((m[whole] & top) * _UNSCRAMBLE & top).astype(np.int64))
    first = at[kept]
    row = np.searchsorted(t.first, first, "right") - 1
    lo = np.maximum(first - (SPAN - 1), t.first[row])
    hi = np.minimum(first + WINDOW + SPAN - 1, t.first[row + 1])
    near = t.span_hash(lo, hi) ^ tc.mix((first - lo).astype(np.uint64) + np.uint64(1))
    return h[kept], near, first


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(h, near, doc_id, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, _, t in tc.tokenised(pc.utf8_lower(b.column("text"))):
                h, near, first = winnow(t)
                row = np.searchsorted(t.first, first, "right") - 1
                yield pa.RecordBatch.from_arrays([_i64(h), _i64(near), b.column("doc_id").take(pa.array(row + a)), pa.array((first - t.first[row]).astype(np.int32))], names=["h", "near", "doc_id", "pos"])

    fields = [T.StructField("h", T.LongType()), T.StructField("near", T.LongType()), docs.schema["doc_id"], T.StructField("pos", T.IntegerType())]
    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, T.StructType(fields))


class FingerprintIndex:
    """Runs of (h, near, doc_id, pos), each (h, near) in one run only; `folder` is named in the shared folder and opened again by its name.

    The runs stand in a manifest of the folder, which is replaced by a rename once a run is written, so a session that is lost leaves the
    index as it was before the batch.  One session at a time may ingest.  Runs of a level are compacted to one of the next level when there are more than
    `fanout`, so an entry is written again once a level: a number of times that grows with the logarithm of the batches."""

    def __init__(self, spark: SparkSession, buckets: int = BUCKETS, fanout: int = FANOUT, folder: str | None = None):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.path = f"{shared_dir(spark)}/{folder or 'substring-' + uuid.uuid4().hex}"
        self.runs: list[tuple[str, int]] = []
        self.version = 0
        self.schema: str | None = None
        names = [f.getPath().getName() for f in self._fs().listStatus(self._at(""))] if self._fs().exists(self._at("")) else []
        versions = sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))
        if versions:
            self.version = versions[-1]
            have = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/manifest-{self.version}").collect()))
            self.buckets, self.schema, self.runs = have["buckets"], have["schema"], [(n, k) for n, k in have["runs"]]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        """Makes these the runs of the index, and removes what no longer counts."""
        fs, new = self._fs(), self._at(f"manifest-{self.version + 1}")
        out = fs.create(self._at("next"), True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "schema": self.schema, "runs": runs}).encode()))
        out.close()
        if not fs.rename(self._at("next"), new):
            raise RuntimeError(f"another session has written to {self.path}")
        gone = [n for n, _ in self.runs if n not in {n for n, _ in runs}]
        if self.version:
            fs.delete(self._at(f"manifest-{self.version}"), False)
        self.version, self.runs = self.version + 1, runs
        for n in gone:
            self._remove(n)

    def _write(self, rows: DataFrame) -> str:
        name = f"substring_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, "h")
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        """The run's table; a session that has not written it first names it in its own catalog."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._fs().delete(self._at(name), True)

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(candidates, contested) of the batch, which joins the index.

        Candidates (doc_id, pos, src, src_pos) have a neighbourhood that is known or comes again in the batch; contested (doc_id, pos, new) are
        the first places of every hash that gets one more neighbourhood by this batch and has others, whether in a run or in the batch."""
        new = self._write(_fingerprints(batch))
        rows = self.spark.table(new)
        self.schema = self.schema or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        runs = [self._run(n) for n, _ in self.runs]
        known = F.lit(None)
        for k, run in enumerate(runs):
            own = run.select(F.col("h"), F.col("near"), F.struct("doc_id", "pos").alias(f"k{k}"))
            rows = rows.join(own.hint("merge"), ["h", "near"], "left")
            known = F.col(f"k{k}") if k == 0 else F.coalesce(known, F.col(f"k{k}"))
        least = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h", "near"))
        rows = rows.select("h", "near", "doc_id", "pos", known.alias("known") if runs else F.lit(None).cast(rows.select(F.struct("doc_id", "pos")).schema[0].dataType).alias("known"))
        rows = rows.withColumn("first", F.coalesce("known", least))
        found = rows.where("doc_id <> first.doc_id").select("doc_id", "pos", F.col("first.doc_id").alias("src"), F.col("first.pos").alias("src_pos"))
        found = stored(found, "substring-found")
        fresh = self._write(rows.where("known is null and first = struct(doc_id, pos)").select("h", "near", "doc_id", "pos").dropDuplicates(["h", "near"]))
        self._remove(new)
        own = self.spark.table(fresh)
        # a hash of the batch's own entries that a run has too has another neighbourhood there
        met = None
        for run in runs:
            part = run.join(own.select("h").distinct().hint("merge"), "h", "left_semi").select("h", "doc_id", "pos", F.lit(False).alias("new"))
            met = part if met is None else met.union(part)
        several = own.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("h")
        if met is not None:
            met = stored(met, "substring-met")
            several = several.union(met.select("h")).distinct()
        places = own.join(several, "h", "left_semi").select("doc_id", "pos", F.lit(True).alias("new"))
        places = stored(places if met is None else places.union(met.select("doc_id", "pos", "new")), "substring-contested")
        self._commit([*self.runs, (fresh, 0)])
        self.compact()
        return found, places

    def passages(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Verified passages of the batch's documents, which join the index; texts (doc_id, text) are all documents so far, those of the batch among them."""
        small_batches(self.spark)
        batch, texts = (d.select("doc_id", "text").where("doc_id is not null and text is not null") for d in (batch, texts))
        found, places = self.ingest(batch)
        return _verified(found.unionByName(_contested(places, texts)), texts)

    def compact(self) -> None:
        """Of each level with more than `fanout` runs, the runs become one of the next level; they are removed once it stands in the manifest."""
        level = 0
        while level <= max((k for _, k in self.runs), default=-1):
            own = [n for n, k in self.runs if k == level]
            if len(own) > self.fanout:
                rows = self._run(own[0])
                for n in own[1:]:
                    rows = rows.unionByName(self._run(n))
                self._commit([r for r in self.runs if r[0] not in own] + [(self._write(rows), level + 1)])
            level += 1

    def remove(self) -> None:
        """Deletes the index."""
        for n, _ in self.runs:
            self._remove(n)
        self._fs().delete(self._at(""), True)
        self.runs, self.version = [], 0


def _contested(places: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates of the new places (doc_id, pos, new) from windows of LEAST_WORDS words around hashes that have several neighbourhoods."""
    places = places.groupBy("doc_id").agg(F.collect_set("pos").alias("at"), F.max("new").alias("new"))
    kind = texts.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at")
            place, bound = np.asarray(at.flatten()), np.asarray(at.offsets) - at.offsets[0].as_py()
            for a, e, t in tc.tokenised(pc.utf8_lower(b.column("text"))):
                p = place[bound[a] : bound[e]].astype(np.int64)
                row = np.repeat(np.arange(e - a), np.diff(bound[a : e + 1]))
                start = (t.first[row] + p)[:, None] - np.arange(SPAN)
                ok = (start >= t.first[row][:, None]) & (start + LEAST_WORDS <= t.first[row + 1][:, None])
                start = np.unique(start[ok])
                row = np.searchsorted(t.first, start, "right") - 1
                w = t.span_hash(start, start + LEAST_WORDS)
                of = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([_i64(w), b.column("doc_id").take(of), pa.array((start - t.first[row]).astype(np.int32)), b.column("new").take(of)], names=["w", "doc_id", "pos", "new"])

    schema = T.StructType([T.StructField("w", T.LongType()), kind, T.StructField("pos", T.IntegerType()), T.StructField("new", T.BooleanType())])
    windows = texts.join(places, "doc_id").select("doc_id", "text", "at", "new").mapInArrow(run, schema)
    first = F.min(F.struct("new", "doc_id", "pos")).over(Window.partitionBy("w"))
    return windows.withColumn("first", first).where("new and doc_id <> first.doc_id").select("doc_id", "pos", F.col("first.doc_id").alias("src"), F.col("first.pos").alias("src_pos"))


def _verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Passages of the candidates: on each diagonal of two documents, the runs of LEAST_WORDS equal words or more."""
    margin = LEAST_WORDS + SPAN
    kind = texts.schema["doc_id"]
    id_type = kind.dataType.simpleString()
    regions = found.groupBy("doc_id", "src", (F.col("pos") - F.col("src_pos")).alias("shift")).agg(F.min("src_pos").alias("low"), F.max("src_pos").alias("high"))
    wanted = regions.groupBy("src").agg(F.collect_list(F.struct("doc_id", "shift", "low", "high")).alias("want")).withColumnRenamed("src", "doc_id")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lower = pc.utf8_lower(b.column("text"))
            data, offsets = tc.buffers(lower)
            want = b.column("want")
            kinds = (b.column("doc_id").type, b.column("doc_id").type, pa.int32(), pa.int32(), pa.binary())

            def flush(out: list[list]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=["doc_id", "src", "shift", "low", "piece"])

            out: list[list] = [[], [], [], [], []]
            held = 0
            for a, e, t in tc.tokenised(lower):
                own = data[offsets[a] : offsets[e]]
                for r in range(a, e):
                    f, n = int(t.first[r - a]), int(t.count[r - a])
                    for w in want[r].as_py():
                        # as far on as a run can reach that holds no further candidate
                        lo, hi = max(0, w["low"] - margin), min(n, w["high"] + LEAST_WORDS + margin)
                        piece = own[t.start[f + lo] : t.end[f + hi - 1]].tobytes()
                        for o, v in zip(out, (w["doc_id"], b.column("doc_id")[r].as_py(), w["shift"], lo, piece)):
                            o.append(v)
                        held += len(piece)
                        if held > FLUSH_BYTES:
                            yield flush(out)
                            out, held = [[], [], [], [], []], 0
            yield flush(out)

    pieces = texts.join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(slices, f"doc_id {id_type}, src {id_type}, shift int, low int, piece binary")
    per_doc = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("src", "shift", "low", "piece")).alias("pieces"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lower = pc.utf8_lower(b.column("text"))
            data, offsets = tc.buffers(lower)
            flat = b.column("pieces").flatten()
            bound = np.asarray(b.column("pieces").offsets) - b.column("pieces").offsets[0].as_py()
            src, shift, low = flat.field(0), np.asarray(flat.field(1)), np.asarray(flat.field(2))
            piece = flat.field(3).cast(pa.large_binary())
            rows, starts, ends, of = [], [], [], []
            for a, e, t in tc.tokenised(lower):
                own = data[offsets[a] : offsets[e]]
                for r in range(a, e):
                    f, n = int(t.first[r - a]), int(t.count[r - a])
                    for k in range(bound[r], bound[r + 1]):
                        other = np.frombuffer(piece[k].as_py(), np.uint8)
                        u = tc.Tokens(other, np.array([0, len(other)]))
                        # token i of the piece stands against token i + low + shift of the document
                        d = int(low[k]) + int(shift[k])
                        i0, i1 = max(0, -d), min(len(u.hash), n - d)
                        if i1 - i0 < LEAST_WORDS:
                            continue
                        same = np.zeros(i1 - i0 + 2, np.int8)
                        same[1:-1] = u.hash[i0:i1] == t.hash[f + d + i0 : f + d + i1]
                        turn = np.flatnonzero(np.diff(same)).reshape(-1, 2)
                        for s, z in turn[(turn[:, 1] - turn[:, 0]) >= LEAST_WORDS].tolist():
                            p, q = f + d + i0 + s, i0 + s
                            if _equal(own, t, p, other, u, q, z - s):
                                rows.append(r)
                                starts.append(d + i0 + s)
                                ends.append(d + i0 + z)
                                of.append(k)
            take = pa.array(np.array(of, np.int64))
            source_start = pa.array(np.array(starts, np.int32) - shift[np.array(of, np.int64)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(np.array(rows, np.int64))), pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32)), src.take(take), source_start], names=["doc_id", "start_word", "end_word", "source_doc", "source_start"])

    schema = f"doc_id {id_type}, start_word int, end_word int, source_doc {id_type}, source_start int"
    return texts.join(per_doc, "doc_id").select("doc_id", "text", "pieces").mapInArrow(compare, schema).distinct()


def _equal(a: np.ndarray, t: tc.Tokens, p: int, b: np.ndarray, u: tc.Tokens, q: int, n: int) -> bool:
    """Whether n tokens from p on and from q on are the same bytes."""
    la, lb = t.end[p : p + n] - t.start[p : p + n], u.end[q : q + n] - u.start[q : q + n]
    if not np.array_equal(la, lb):
        return False
    ramp = np.arange(la.sum()) - np.repeat(np.cumsum(la) - la, la)
    return np.array_equal(a[np.repeat(t.start[p : p + n], la) + ramp], b[np.repeat(u.start[q : q + n], la) + ramp])


def _batches(texts: DataFrame, batches: int) -> list[DataFrame]:
    """texts in ranges of doc_id of about equal numbers of rows; ids of any type that has an order."""
    if batches < 2:
        return [texts]
    if isinstance(texts.schema["doc_id"].dataType, T.NumericType):
        ends = texts.agg(F.min("doc_id"), F.max("doc_id")).first()
        cut = [ends[0] + (ends[1] + 1 - ends[0]) * k // batches for k in range(1, batches)]
    else:
        # every id stands in the range of its first characters' place among all; the bounds are a few, whatever the input
        parts = texts.select("doc_id").repartitionByRange(batches, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("m"))
        cut = sorted(r.m for r in parts.collect())[1:]
    edges = [None, *sorted(set(cut)), None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        own = texts if lo is None else texts.where(F.col("doc_id") >= F.lit(lo))
        out.append(own if hi is None else own.where(F.col("doc_id") < F.lit(hi)))
    return out


def passages(docs: DataFrame, batches: int = BATCHES, buckets: int = BUCKETS) -> DataFrame:
    """Passages (doc_id, start_word, end_word, source_doc, source_start); docs come in batches of doc_id ranges."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    if texts.isEmpty():
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, start_word int, end_word int, source_doc {kind}, source_start int")
    index, all_found, all_places = FingerprintIndex(spark, buckets), [], []
    for batch in _batches(texts, batches):
        found, places = index.ingest(batch)
        all_found.append(found)
        # the documents are verified together below, in order of doc_id, so all places are new
        all_places.append(places.withColumn("new", F.lit(True)))
    index.remove()
    texts = texts.where("text is not null")
    return _verified(reduce(DataFrame.unionByName, all_found).unionByName(_contested(reduce(DataFrame.union, all_places), texts)), texts)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
