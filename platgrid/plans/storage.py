"""Cutting a plan: results that later stages read more than once are written to a folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only in local mode, where driver and executors are one machine, is a temporary folder made when it is unset."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        have = getattr(shared_dir, "made", None) or tempfile.mkdtemp(prefix="platgrid-")
        shared_dir.made = have
    return have.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder by way of checkpoint(), its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
