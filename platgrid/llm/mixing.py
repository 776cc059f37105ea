"""Mixing sources to target weights by a low-discrepancy schedule.

Documents are shuffled within their source (by the md5 of doc_id) and their words run on into blocks of
`block` words; the last block of a source may be shorter.  Slot i of the schedule has the golden-ratio point
frac(i * 0.618...), as 32-bit integer, which the cumulative weights of the sources map to a source.  The k-th slot of a source
takes its block k modulo the number of its blocks, so a source that is wanted more often than it has
blocks starts another epoch, and of any prefix of the schedule each source has its share but for a few slots.
There are as many slots as blocks.  So of a source's n blocks max(0, n - its slots) are not used, its slots being the share of its weight in all
slots: of a source with half of all words among 20 about 63 %, with the default weights.

Weights default to the square root of a source's words, rounded down.  Running sums over a hot source are taken in two levels
(over ranges of the shuffle, then inside each range), so no task sorts a whole source.

Defined results: null texts count as empty; texts without a word fill no block and do not appear.  A null
source is a source of its own, shown as null.  Rows of null doc_id are shuffled by their text, so are ties of doc_id
(repeated rows); rows equal in both follow each other.  Extra columns are ignored.  Empty tables, and weights that are all 0, give no slots; a
source without a weight gets none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

BLOCK = 1024
SEED = "mix-1"
#: Hex digits of the shuffle that make a range: a million ranges for each source, so that a third of 100 TB has 33 MB in each; slots in one range of the schedule.
RANGE_DIGITS = 5
SLOT_RANGE = 65536
GOLDEN = 2654435769  # 2**32 / golden ratio
PART = 1 << 20
WORD = re.compile(r"[^ \t\n\r]+")


def _offset(sizes: DataFrame, keys: list[str], by: str, value: str, out: str) -> DataFrame:
    """sizes with out: the sum of value over the rows of equal keys that come before, in order of by."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def _prepared(docs: DataFrame) -> DataFrame:
    """(s, s0, doc_id, text, n, k, r): source and whether it is null, words, key of the shuffle and its range."""
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("s0"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("n", F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("bigint")).where("n > 0")
    d = d.withColumn("k", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), F.lit(":" + SEED))))
    return d.withColumn("r", F.conv(F.substring("k", 1, RANGE_DIGITS), 16, 10).cast("int"))


def blocks(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(s, s0, block, n_tokens, doc_ids, text) of all blocks, and (s, s0, tokens, blocks) of the sources.

    The texts are shuffled twice: by range of the shuffle for the running sums, and by block.  The sums by range are stored;
    they have at most 16**RANGE_DIGITS rows for each source, and are merged, not broadcast."""
    d = _prepared(docs)
    ranges = stored(d.groupBy("s", "s0", "r").agg(F.sum("n").alias("sum")), "mix-ranges")
    sizes = ranges.groupBy("s", "s0").agg(F.sum("sum").alias("tokens")).withColumn("blocks", F.expr(f"(tokens + {block - 1}) div {block}"))
    before = _offset(ranges, ["s", "s0"], "r", "sum", "before").drop("sum")
    inside = Window.partitionBy("s", "s0", "r").orderBy("k", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = d.select("s", "s0", "r", "doc_id", "text", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("inside"))
    at = at.join(before.hint("merge"), ["s", "s0", "r"]).select("s", "s0", "doc_id", "text", (F.col("before") + F.col("inside")).alias("start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, s0, ids, texts, starts = (c.to_pylist() for c in b.columns)
            rows = []
            for i, text in enumerate(texts):
                words = WORD.findall(text)
                a, start = 0, starts[i]
                while a < len(words):
                    n = min(block - (start + a) % block, len(words) - a)
                    rows.append((s[i], s0[i], (start + a) // block, (start + a) % block, n, ids[i], " ".join(words[a : a + n])))
                    a += n
            kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), b.column(2).type, pa.string())
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["s", "s0", "block", "pos", "n", "doc_id", "piece"])

    pieces = at.mapInArrow(cut, f"s string, s0 boolean, block bigint, pos int, n int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece string")
    of = pieces.groupBy("s", "s0", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "doc_id", "piece"))).alias("p"))
    n = F.aggregate("p", F.lit(0), lambda a, x: a + x["n"]).cast("bigint").alias("n_tokens")
    ids, text = F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text")
    return of.select("s", "s0", "block", n, ids, text), sizes


def schedule(sizes: DataFrame) -> DataFrame:
    """(slot, s, s0, blocks, k) of sizes (s, s0, blocks, weight): which source each slot has, with its blocks, and the slot's rank in it."""
    spark = sizes.sparkSession
    w = Window.orderBy("s0", "s").rowsBetween(Window.unboundedPreceding, 0)  # a row for each source
    total = sizes.agg(F.sum("weight").alias("weights"), F.sum("blocks").alias("slots"))
    bound = sizes.withColumn("upto", F.sum("weight").over(w)).crossJoin(total).where("weight > 0")
    bound = bound.select("s", "s0", "blocks", F.expr("((upto - weight) * 4294967296) div weights").alias("low"), F.expr("(upto * 4294967296) div weights").alias("high"))
    # a source stands under each of the 4096 parts of the unit interval that its share touches, so points find it by an equal join
    bound = bound.where("high > low").withColumn("part", F.explode(F.expr(f"sequence(low div {PART}, (high - 1) div {PART})")))
    slots = total.where("weights > 0 and slots > 0").select(F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_RANGE})")).alias("range"), "slots")
    slots = slots.repartition(8 * spark.sparkContext.defaultParallelism, "range")
    slots = slots.select("range", F.explode(F.expr(f"sequence(range * {SLOT_RANGE}, least(slots, (range + 1) * {SLOT_RANGE}) - 1)")).alias("slot"))
    slots = slots.withColumn("u", F.expr(f"((slot % 4294967296) * {GOLDEN}) % 4294967296")).withColumn("part", F.expr(f"u div {PART}"))
    # Spark takes the size of the slots from before they are exploded and would broadcast them
    of = slots.join(bound.hint("shuffle_hash"), "part").where("u >= low and u < high").select("slot", "range", "s", "s0", "blocks")
    before = _offset(of.groupBy("s", "s0", "range").agg(F.count("*").alias("c")), ["s", "s0"], "range", "c", "before").drop("c")
    inside = F.row_number().over(Window.partitionBy("s", "s0", "range").orderBy("slot")) - 1
    return of.withColumn("inside", inside).join(before.hint("merge"), ["s", "s0", "range"]).select("slot", "s", "s0", "blocks", (F.col("before") + F.col("inside")).alias("k"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """(slot, source, block, epoch, n_tokens, doc_ids, text) of the whole schedule."""
    small_batches(docs.sparkSession)
    b, sizes = blocks(docs, block)
    sizes = sizes.withColumn("weight", _weight(weights))
    plan = schedule(sizes).select("slot", "s", "s0", F.expr("k % blocks").alias("block"), F.expr("k div blocks").alias("epoch"))
    # the plan has a row for each block, so it is hashed by partition and never broadcast; the blocks already stand by these keys
    return b.join(plan.hint("shuffle_hash"), ["s", "s0", "block"]).select("slot", F.expr("if(s0, null, s)").alias("source"), "block", "epoch", "n_tokens", "doc_ids", "text")


def _weight(weights: dict[str, int] | None) -> Column:
    if weights is None:
        return F.floor(F.sqrt("tokens")).cast("bigint")
    of = F.create_map(*[F.lit(x) for p in weights.items() for x in p]) if weights else F.create_map().cast("map<string,bigint>")
    return F.when(F.col("s0"), F.lit(0)).otherwise(F.coalesce(of[F.col("s")], F.lit(0))).cast("bigint")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("doc_ids", F.concat_ws(",", "doc_ids"))


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^ \\t\\n\\r]+') AS w, md5(doc_id || ':{SEED}') AS k FROM documents),
p AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY source ORDER BY k, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM d WHERE len(w) > 0),
q AS (SELECT *, unnest(range(a // {BLOCK}, (a + len(w) - 1) // {BLOCK} + 1)) AS block FROM p),
r AS (SELECT source, block, a, doc_id, w[greatest(0, block * {BLOCK} - a) + 1 : least(len(w), (block + 1) * {BLOCK} - a)] AS x FROM q),
b AS (SELECT source, block, sum(len(x))::BIGINT AS n_tokens, string_agg(doc_id::VARCHAR, ',' ORDER BY a) AS doc_ids, string_agg(array_to_string(x, ' '), chr(10) ORDER BY a) AS text FROM r GROUP BY source, block),
z AS (SELECT source, count(*) AS blocks, floor(sqrt(sum(n_tokens)))::BIGINT AS weight FROM b GROUP BY source),
y AS (SELECT *, sum(weight) OVER (ORDER BY source)::BIGINT AS upto, (sum(weight) OVER ())::BIGINT AS weights FROM z),
s AS (SELECT unnest(range((SELECT sum(blocks)::BIGINT FROM z))) AS slot),
t AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k
  FROM s JOIN y ON (slot % 4294967296 * {GOLDEN}) % 4294967296 >= (upto - weight) * 4294967296 // weights
    AND (slot % 4294967296 * {GOLDEN}) % 4294967296 < upto * 4294967296 // weights)
SELECT slot, t.source, b.block, k // blocks AS epoch, n_tokens, doc_ids, text
FROM t JOIN b ON b.source = t.source AND b.block = k % t.blocks
"""
