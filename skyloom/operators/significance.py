"""Significance of single zones: conditional permutations of local Moran and Gi*, false discovery, classes, panels.

Permutations are hashed draws (:mod:`skyloom.operators.draws`), so no group of zones is
gathered in one task and every engine gives the same p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import draws, windows, zones


def _adjusted(df: DataFrame, keys: Sequence[str], zone: str, alpha: float) -> DataFrame:
    """``df`` with p_adjusted and significant by Benjamini-Hochberg over the zones of each group."""
    order = Window.partitionBy(*keys, F.col("p_sim").isNull()).orderBy("p_sim", zone)
    m, k = F.count("*").over(Window.partitionBy(*keys, F.col("p_sim").isNull())), F.row_number().over(order)
    step = df.withColumn("_s", F.when(F.col("p_sim").isNotNull(), F.col("p_sim") * m / k))
    q = F.least(F.lit(1.0), F.min("_s").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    out = step.withColumn("p_adjusted", F.when(F.col("p_sim").isNotNull(), q)).drop("_s")
    return out.withColumn("significant", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False)))


#: Cluster names of the quadrants 1 to 4.
CLUSTERS = ("high_high", "low_high", "low_low", "high_low")


def local_moran(df: DataFrame, keys: Sequence[str], zone: str, value: str, near: str, permutations: int = 999, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Per group and zone: local_i, lag, p_sim, p_adjusted, significant, quadrant and cluster (not_significant where it is not)."""
    out = _adjusted(draws.local(df, keys, zone, value, near, permutations, seed, False), keys, zone, alpha)
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), 1).when((F.col("z") <= 0) & (F.col("lag") > 0), 2).when((F.col("z") <= 0) & (F.col("lag") <= 0), 3).otherwise(4)
    names = F.element_at(F.array(*map(F.lit, CLUSTERS)), F.col("quadrant"))
    out = out.withColumn("quadrant", quadrant).withColumn("cluster", F.when(F.col("significant"), names).otherwise("not_significant"))
    return out.select(*keys, zone, F.col("statistic").alias("local_i"), "lag", "p_sim", "p_adjusted", "significant", "quadrant", "cluster")


def gi_star(df: DataFrame, keys: Sequence[str], zone: str, value: str, near: str, permutations: int = 999, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Per group and zone: gi_z, p_sim, p_adjusted, significant and confidence class; negative or missing values are refused."""
    out = _adjusted(draws.local(df, keys, zone, value, near, permutations, seed, True), keys, zone, alpha)
    return out.select(*keys, zone, F.col("statistic").alias("gi_z"), "p_sim", "p_adjusted", "significant", zones.confidence_class(F.col("p_adjusted"), F.col("statistic")).alias("confidence"))


def gi_star_panel(df: DataFrame, zone: str, bin_: str, value: str, near: DataFrame, permutations: int = 99, seed: int = 42) -> DataFrame:
    """Gi* of every time bin in which all zones have a value; bins with a gap are dropped.  ``near`` is (zone, near)."""
    every = df.select(zone).distinct().agg(F.count("*").alias("_n"), F.lit(1).alias("_k"))
    whole = df.where(F.col(value).isNotNull()).groupBy(bin_).agg(F.countDistinct(zone).alias("_m"), F.lit(1).alias("_k")).join(F.broadcast(every), "_k").where("_m = _n").select(bin_)
    return gi_star(df.join(whole, bin_).join(near, zone, "left"), [bin_], zone, value, "near", permutations, seed)


def trend_table(tests: DataFrame, zone: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Trend tests of zones with p_adjusted and significant across zones; untested ones have null and false."""
    out = windows.step_up(tests, p, zone, alpha)
    return out.withColumn("significant", F.coalesce("reject", F.lit(False))).withColumnRenamed("q", "p_adjusted").drop("reject")


def bins(df: DataFrame, zone: str, year: str, value: str, width: int) -> DataFrame:
    """(zone, bin, value): means over bins of ``width`` years from the first year on; with width 1 a year that comes twice is refused."""
    if width < 1:
        raise ValueError("a bin has a year at least")
    known = df.where(F.col(year).isNotNull())
    if width == 1 and not known.groupBy(zone, year).count().where("count > 1").isEmpty():
        raise ValueError("a zone has a year twice")
    first = known.agg(F.min(year).alias("_first"), F.lit(1).alias("_k"))
    rows = known.withColumn("_k", F.lit(1)).join(F.broadcast(first), "_k")
    return rows.groupBy(zone, (F.col("_first") + F.floor((F.col(year) - F.col("_first")) / width) * width).cast("int").alias("bin")).agg(F.avg(value).alias("value"))


def model_choice(tests: dict[str, tuple[float, float]], alpha: float = 0.05) -> str:
    """ols, lag or error by the Lagrange-multiplier tests (statistic, p): classic ones first, robust ones if both are significant, the larger if those are too."""
    hit = {k: k in tests and tests[k][1] < alpha for k in ("lm_lag", "lm_error", "rlm_lag", "rlm_error")}
    if not hit["lm_lag"] and not hit["lm_error"]:
        return "ols"
    if hit["lm_lag"] != hit["lm_error"]:
        return "lag" if hit["lm_lag"] else "error"
    if hit["rlm_lag"] != hit["rlm_error"]:
        return "lag" if hit["rlm_lag"] else "error"
    a, b = ("rlm_lag", "rlm_error") if hit["rlm_lag"] else ("lm_lag", "lm_error")
    return "lag" if tests[a][0] >= tests[b][0] else "error"
