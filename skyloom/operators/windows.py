"""Ranking and whole-table windows: z-scores, percent ranks, min-max, step-up FDR.

Whole-table figures come from one aggregate that is joined back as a single row;
only orderings over a whole table use a global window, and those are meant for
tables of zones or tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def with_totals(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """``df`` with figures of the whole table beside each row, from one aggregate that is joined back as a single broadcast row."""
    one = df.agg(*[c.alias(n) for n, c in figures.items()]).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


def z_score(value: Column, keys: Sequence[str], flat: float | None = None) -> Column:
    """Population z-score within ``keys``; ``flat`` where there is no spread."""
    w = _over(keys)
    return F.when(F.stddev_pop(value).over(w) > 0, (value - F.avg(value).over(w)) / F.stddev_pop(value).over(w)).when(value.isNotNull(), F.lit(flat).cast("double"))


def percent_rank(value: Column, keys: Sequence[str]) -> Column:
    """Average-tie rank over the count of values; null stays null."""
    order = Window.partitionBy(*keys, value.isNull()).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / F.count(value).over(_over(keys)))


def min_max(value: Column, keys: Sequence[str]) -> Column:
    """(x - min) / (max - min) within ``keys``; 0.5 for a constant column."""
    w = _over(keys)
    spread = F.max(value).over(w) - F.min(value).over(w)
    return F.when(value.isNull(), None).when(spread == 0, 0.5).otherwise((value - F.min(value).over(w)) / spread)


def sequence_rank(value: Column, tie: Column) -> Column:
    """1, 2, ... by descending value, nulls last, ties by ``tie``."""
    return F.row_number().over(Window.orderBy(value.desc_nulls_last(), tie))


def _harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m; from 256 on by its expansion, which is exact to a double there."""
    x = m.cast("double")
    far = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    near = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(m, F.lit(1)), F.lit(256)).cast("int")), F.lit(0.0), lambda acc, k: acc + 1.0 / k)
    return F.when(m > 256, far).otherwise(near)


def step_up(df: DataFrame, p: str, key: str, alpha: float, dependent: bool = False) -> DataFrame:
    """``df`` with ``q`` and ``reject`` by Benjamini-Hochberg, or Benjamini-Yekutieli if ``dependent``.

    m counts the finite p only; q is the running minimum from the largest p of
    p * m / rank, at most 1; untested rows have null in both.  Equal p have equal q,
    that of their last rank, so distinct p are ordered, not rows: in buckets of p, a
    step of 1/512 or, below that, of a power of two, with the buckets' counts and
    minima carried from one to the other.  No task orders the whole table.
    """
    x = F.col(p).cast("double")
    tested = x.isNotNull() & ~F.isnan(x)
    bucket = F.when(x >= 1 / 512, F.floor(F.least(x, F.lit(1.0)) * 512)).when(x > 0, -F.floor(-F.log2(x))).otherwise(-2000).cast("int")
    each = df.where(tested).select(x.alias("_p"), bucket.alias("_b")).groupBy("_p", "_b").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_b").orderBy("_p")
    each = each.withColumn("_k", F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    line, later = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    sizes = each.groupBy("_b").agg(F.sum("_n").alias("_s"))
    sizes = with_totals(sizes, {"_m": F.sum("_s")}).withColumn("_before", F.coalesce(F.sum("_s").over(line), F.lit(0)))
    m = F.col("_m") * _harmonic(F.col("_m")) if dependent else F.col("_m").cast("double")
    each = each.join(F.broadcast(sizes.drop("_s")), "_b").withColumn("_v", F.col("_p") * m / (F.col("_before") + F.col("_k")))
    least = each.groupBy("_b").agg(F.min("_v").alias("_l")).select("_b", F.min("_l").over(later).alias("_l"))
    q = F.least(F.lit(1.0), F.min("_v").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.coalesce("_l", F.lit(1.0)))
    found = each.join(F.broadcast(least), "_b").select("_p", q.alias("q"))
    # Untested rows look for a p that is none, each its own, so that they do not meet in one task.
    out = df.withColumn("_x", F.when(tested, x).otherwise(-2.0 - F.pmod(F.xxhash64(key), F.lit(1 << 20)))).join(found, F.col("_x") == F.col("_p"), "left").drop("_x", "_p")
    return out.withColumn("reject", F.col("q") <= alpha)


def fdr_summary(df: DataFrame, q: str, alpha: float, direction: Column) -> DataFrame:
    """Counts of all, tested, significant rows, of significant rises and falls, and both shares."""
    hit = F.col(q) <= alpha
    return df.agg(F.count("*").alias("cells"), F.count(q).alias("tested"), F.count_if(hit).alias("significant"), F.count_if(hit & (direction > 0)).alias("rises"), F.count_if(hit & (direction < 0)).alias("falls")).select(
        "*", (F.col("significant") / F.nullif(F.col("tested"), F.lit(0))).alias("share_of_tested"), (F.col("significant") / F.nullif(F.col("cells"), F.lit(0))).alias("share_of_cells"))
