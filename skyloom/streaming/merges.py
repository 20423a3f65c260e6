"""Means that grow by batches: partial sums of each micro-batch in a table of their own, added up when read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partial_sums(batch: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, total, squares) of a batch's known values."""
    v = F.col(value).cast("double")
    return batch.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


def into(folder: str, keys: Sequence[str], value: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: a batch's sums go to a table that its number names.

    A batch that comes again after a failure replaces its own table, so each is counted
    once; batches in which nothing is known leave an empty table.
    """

    def write(batch: DataFrame, number: int) -> None:
        partial_sums(batch, keys, value).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch-{number:012d}")

    return write


def run(stream: DataFrame, folder: str, keys: Sequence[str], value: str) -> None:
    """Takes up what the stream has that ``folder`` has not yet, and returns; its progress is kept beside the sums."""
    writer = stream.writeStream.foreachBatch(into(f"{folder}/sums", keys, value)).option("checkpointLocation", f"{folder}/progress")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, mean, sd) of all batches together; sd is that of the population."""
    sums = spark.read.parquet(f"{folder.rstrip('/')}/sums/batch-*").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    mean = F.col("total") / F.col("n")
    return sums.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
