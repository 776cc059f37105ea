"""What several of the operators share: tables, the shared folder, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session's plans send to Python, so that long texts take no more memory than short ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only in local mode, where driver and executors are one machine, is a temporary folder set when it is unset."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = getattr(shared_dir, "made", None) or tempfile.mkdtemp(prefix="platgrid-")
        shared_dir.made = have
    return have.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


_stored: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again; it stays there until forget()."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept() -> int:
    """How many tables stored() has written in this process and forget() has left."""
    return len(_stored)


def forget(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Removes what stored() wrote in this process from the table of number `since` on, but for the last `but` ones.

    Call it once results are written: a result may still read such files."""
    gone = _stored[since : len(_stored) - but]
    del _stored[since : len(_stored) - but]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
