"""Descriptions as a stream: parsing is row by row and keeps no state, so the batch operators serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import tracts
from ..plans.options import Options


def stream_tracts(descriptions: DataFrame, options: Options = Options(), **how) -> DataFrame:
    return tracts(descriptions, options, **how)


def append_csv(stream: DataFrame, path: str, checkpoint: str, names: list[str], **trigger) -> StreamingQuery:
    """Adds the tracts of every micro-batch to a folder of CSV files."""
    from ..sources.csvfiles import csv_rows

    return csv_rows(stream, names).writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
