"""Event journal: append-only JSON lines with a rising number, read from an offset, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq long, at string, stage string, event string, level string, payload string, _broken string"


def append(events: DataFrame, folder: str) -> None:
    """Adds events (seq, at, stage, event, level, payload) to the journal's folder."""
    events.select("seq", "at", "stage", "event", "level", "payload").write.mode("append").json(folder)


def read(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """Events after an offset; lines that are not valid are skipped."""
    rows = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_broken").json(folder)
    return rows.filter("_broken IS NULL AND seq IS NOT NULL").filter(F.col("seq") > after).drop("_broken")


def tail(spark: SparkSession, folder: str, after: int = -1, files_per_batch: int = 100) -> DataFrame:
    """The journal as a stream from an offset; progress is kept by the query's checkpoint."""
    rows = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.filter("_broken IS NULL AND seq IS NOT NULL").filter(F.col("seq") > after).drop("_broken")
