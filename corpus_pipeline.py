"""From raw documents to a training mix: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to the shared
folder and read again, so a lost executor never costs more than the running stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platgrid.llm.common import forget, kept, stored, table
from platgrid.llm.decontam import decontaminate
from platgrid.llm.linededup import line_dedup
from platgrid.llm.mixing import mix
from platgrid.llm.quality import quality_filter
from platgrid.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on `labels` rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly equal an earlier line go, short ones if they equal it; the documents stay."""
    return line_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of shuffled documents in the order of the schedule."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]

#: SQL can express neither the classifier nor the fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result's table stays in the shared folder; what earlier stages wrote is removed once the next one has ended."""
    docs, before = table(spark, sf_dir, "documents"), kept()
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        forget(spark, before, but=1)
    return docs
