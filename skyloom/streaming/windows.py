"""Event-time windows; the same plan runs on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _live(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, whose time is a timestamp with zone; a table as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, length: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Count, sum and mean per window and keys; streams drop what comes later than ``late``."""
    rows = _live(events, time, late)
    w = F.window(F.col(time), length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key that end after ``gap`` without events."""
    rows = _live(events, time, late)
    return rows.groupBy(F.session_window(F.col(time), gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of parquet files, ``per_trigger`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
