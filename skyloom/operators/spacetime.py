"""Emerging hot spots from a space-time cube: Gi* over zones around and bins before, trends of its z, categories, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import graph, trends, windows


def gi_cube(cube: DataFrame, edges: DataFrame, zone: str, bin_: str, value: str, back: int = 1, step: int = 1) -> DataFrame:
    """(zone, bin, value, gi_z, members): Gi* of each value of the cube among its neighbours in space and time.

    Neighbours are the zone itself and its neighbours by ``edges`` (i, j), in the same bin
    and in the ``back`` bins before, ``step`` apart; bins that a zone lacks are no
    neighbours.  Mean, spread and size are those of the whole cube.  A zone's neighbours
    are added up bin by bin first and then along the bins, so no pair of cells is formed
    twice.  Null values take no part; each (zone, bin) comes once; without spread, or with
    the whole cube as neighbours, gi_z is null.
    """
    rows = cube.where(F.col(value).isNotNull()).select(F.col(zone).alias("_i"), F.col(bin_).alias("_b"), F.col(value).cast("double").alias("_v"))
    rows = windows.with_totals(rows, {"_mean": F.avg("_v"), "_sd": F.stddev_pop("_v"), "_n": F.count("*").cast("double")})
    near = edges.select("i", "j").where("i <> j").distinct().union(rows.select(F.col("_i").alias("i"), F.col("_i").alias("j")).distinct())
    sums = rows.select(F.col("_i").alias("j"), "_b", "_v").join(near, "j").groupBy("i", "_b").agg(F.sum("_v").alias("_s"), F.count("*").alias("_w"))
    later = sums.select(F.col("i").alias("_i"), "_s", "_w", F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.col("_b") + k * step)).alias("_b"))
    around = later.groupBy("_i", "_b").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w"))
    w = F.col("_w").cast("double")
    scale = F.col("_sd") * F.sqrt((F.col("_n") * w - w * w) / (F.col("_n") - 1))
    z = (F.col("_s") - F.col("_mean") * w) / F.nullif(scale, F.lit(0.0))
    return rows.join(around, ["_i", "_b"]).select(F.col("_i").alias(zone), F.col("_b").alias(bin_), F.col("_v").alias(value), z.alias("gi_z"), F.col("_w").alias("members"))


def emerging_hot_spots(cube: DataFrame, edges: DataFrame, zone: str, bin_: str, value: str, back: int = 1, step: int = 1, alpha: float = 0.05, final_required: bool = True) -> DataFrame:
    """(zone, bins, share, final_run, category, last_z, s, trend_z, p_adjusted) of every zone of the cube.

    The trend is a Mann-Kendall test of the zone's gi_z series with p adjusted across
    zones; it counts where the adjusted p is at most ``alpha``.  A zone with fewer than
    three bins has no test and no trend.
    """
    panel = graph.written(gi_cube(cube, edges, zone, bin_, value, back, step).where("gi_z IS NOT NULL"))
    tests = trends.mann_kendall(panel, [zone], bin_, "gi_z").withColumn("p", trends.two_sided_p("z"))
    tests = graph.written(windows.step_up(tests.select(zone, "s", F.col("z").alias("trend_z"), "p"), "p", zone, alpha))
    sign = F.when(F.coalesce("reject", F.lit(False)), F.signum("s")).otherwise(0.0)
    labelled = graph.emerging(panel.join(tests.select(zone, sign.alias("_t")), zone), zone, bin_, "gi_z", "_t", final_required)
    last = panel.groupBy(zone).agg(F.max_by("gi_z", bin_).alias("last_z"))
    return labelled.join(last, zone).join(tests.select(zone, "s", "trend_z", F.col("q").alias("p_adjusted")), zone)
