"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader.

Features of a text are its word and punctuation tokens and the pairs of neighbouring tokens, hashed into
2**bits places; a pair of two equal words hashes to one common place, so that repetition is seen whatever
the word.  Every feature counts log2(1 + its occurrences) and each text's vector has length 1.

Defined results: null and empty texts have no features and get the score of the bias alone; they are kept,
as nothing speaks against them.  Repeated rows get equal scores.  Rows keep all their columns; a column
that is named as one the operator adds (quality_score, quality_keep) is replaced.  Without labelled rows of
both classes every text scores 0.5 and is kept.  Labels of null are left out; several labels of a document
that differ are left out too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import small_batches, table

#: The place of every pair of equal words.
REPEAT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class QualityConfig:
    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.1
    epochs: int = 6
    #: Bound on the labelled documents that training uses: those with the least hash of doc_id.
    train_rows: int = 4000
    #: Share of them that only sets the threshold.
    held_out: float = 0.25
    #: The threshold is the lesser of 0.5 and the score that this share of held-out good documents exceeds.
    keep_good: float = 0.998


def features(column: pa.Array, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bounds of the rows' entries, places, values) of each chunk; values have length 1 by row."""
    for a, _, tokens in tc.tokenised(column, punctuation=True):
        h, row = tokens.hash, tokens.row
        pair = tokens.left() > 1
        i = np.flatnonzero(pair)
        both = tc.mix(h[i] * np.uint64(0x9E3779B97F4A7C15) + h[i + 1])
        both[h[i] == h[i + 1]] = REPEAT
        # a word that comes again after one mark, as in "so, so, so"
        skip = np.flatnonzero(tokens.left() > 2)
        skip = skip[(h[skip] == h[skip + 2]) & (tokens.kind[skip] == 1)]
        place = np.concatenate([h, both, np.full(len(skip), REPEAT)]) >> np.uint64(64 - bits)
        rows = np.concatenate([row, row[i], row[skip]]).astype(np.uint64)
        key = np.sort((rows << np.uint64(bits)) | place)
        if not len(key):
            yield a, np.zeros(tokens.rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
            continue
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([new, [len(key)]]))
        key = key[new]
        first = np.searchsorted(key >> np.uint64(bits), np.arange(tokens.rows + 1).astype(np.uint64))
        value = np.log2(1.0 + count)
        norm = np.sqrt(tc.row_sums(value * value, first))
        value /= np.repeat(norm, np.diff(first))
        yield a, first, (key & np.uint64((1 << bits) - 1)).astype(np.int64), value.astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-proximally-regularised-leader for logistic loss; the last place is the bias."""

    def __init__(self, config: QualityConfig):
        self.c = config
        self.z = np.zeros((1 << config.bits) + 1)
        self.n = np.zeros((1 << config.bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.c.l1) / ((self.c.beta + np.sqrt(n)) / self.c.alpha + self.c.l2)
        return np.where(np.abs(z) <= self.c.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * weight
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.c.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def train(texts: list[str], labels: list[int], config: QualityConfig) -> tuple[np.ndarray, float]:
    """The weights (the last is the bias) and the threshold, from texts in a set order."""
    if len(set(labels)) < 2:
        return np.zeros((1 << config.bits) + 1, np.float32), 0.0
    examples = []
    for _, first, place, value in features(pa.array(texts, pa.large_string()), config.bits):
        for r in range(len(first) - 1):
            s = slice(first[r], first[r + 1])
            examples.append((np.append(place[s], 1 << config.bits), np.append(value[s].astype(np.float64), 1.0)))
    y = np.array(labels)
    fit_to = len(y) - int(len(y) * config.held_out)
    if len(set(y[:fit_to])) < 2:
        fit_to = len(y)
    share = y[:fit_to].mean()
    model, order = Ftrl(config), np.random.default_rng(17)
    for _ in range(config.epochs):
        for i in order.permutation(fit_to):
            model.learn(*examples[i], y[i], 0.5 / share if y[i] else 0.5 / (1 - share))
    w = model.weights(slice(None)).astype(np.float32)
    good = [1 / (1 + np.exp(-float(w[at] @ x))) for (at, x), label in zip(examples[fit_to:], y[fit_to:]) if label]
    return w, min(0.5, float(np.quantile(good, 1 - config.keep_good))) if good else 0.5


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> tuple[np.ndarray, float]:
    """Trains on at most config.train_rows labelled documents, in one executor task; the driver gets the weights.

    Only the sample's texts are shuffled.  Its ids are bounded by train_rows, and so is their broadcast."""
    small_batches(docs.sparkSession)
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_y"), F.max("quality").alias("_y2"))
        .where("_y = _y2")
        .select(F.col("doc_id").alias("_id"), "_y")
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(config.train_rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        pdf = pdf.assign(_k=pd.util.hash_array(pdf["doc_id"].to_numpy()), text=pdf["text"].fillna(""))
        pdf = pdf.sort_values(["_k", "doc_id", "text"])
        w, threshold = train(pdf["text"].tolist(), pdf["_y"].astype(int).tolist(), config)
        yield pd.DataFrame({"w": [w.tobytes()], "threshold": [threshold]})

    got = sample.repartition(1).mapInPandas(learn, "w binary, threshold double").collect()
    if not got:
        return np.zeros((1 << config.bits) + 1, np.float32), 0.0
    return np.frombuffer(bytes(got[0].w), np.float32), got[0].threshold


def score_column(column: pa.Array, weights: np.ndarray, bits: int) -> np.ndarray:
    out = np.empty(len(column))
    for a, first, place, value in features(column, bits):
        dot = tc.row_sums(weights[place] * value, first) + float(weights[-1])
        out[a : a + len(first) - 1] = 1 / (1 + np.exp(-dot))
    return out


def scores(spark: SparkSession, weights: np.ndarray, bits: int):
    """The column function that gives a text's probability of being good; only texts go to Python."""
    held = spark.sparkContext.broadcast(weights)  # 1 MB whatever the input

    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.round(score_column(column, held.value, bits), 6))

    # else a filter on the score is pushed below it, and texts are scored twice
    return F.arrow_udf(run, "double").asNondeterministic()


def classify(docs: DataFrame, weights: np.ndarray, threshold: float, config: QualityConfig = QualityConfig()) -> DataFrame:
    """docs with quality_score (probability of good) and quality_keep; one pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    empty = F.coalesce(F.col("text"), F.lit("")) == ""
    docs = docs.drop("quality_score", "quality_keep").withColumn("quality_score", scores(spark, weights, config.bits)(F.col("text")))
    return docs.withColumn("quality_keep", (F.col("quality_score") >= threshold) | empty)


def quality_filter(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that the classifier trained on labels keeps, with their columns."""
    return classify(docs, *fit(docs, labels, config), config).where("quality_keep").drop("quality_score", "quality_keep")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    w, threshold = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), w, threshold).drop("text")
