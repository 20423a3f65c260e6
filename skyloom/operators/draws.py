"""Permutation tests whose draws are hashes, as joins and aggregates.

A draw orders the zones of a group by the MD5 of seed, draw and zone, so any engine
gives the same permutations however the rows are partitioned.  Nothing is gathered:
a group's draws are dealt over tasks, each ordering the zones of one draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits to which sums are compared, so that the order of adding does not decide.
DIGITS = 9


def standardised(df: DataFrame, keys: Sequence[str], zone: str, value: str) -> DataFrame:
    """(keys, _i, _v, _z, _n): values with their z-score in the group, null without spread, and the group's size."""
    w = Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    z = (v - F.avg(v).over(w)) / F.nullif(F.stddev_pop(v).over(w), F.lit(0.0))
    return df.select(*keys, F.col(zone).alias("_i"), v.alias("_v"), z.alias("_z"), F.count("*").over(w).alias("_n"))


def edges(df: DataFrame, keys: Sequence[str], zone: str, near: str) -> DataFrame:
    """(keys, _i, _j): the pairs of an array column of neighbours that are zones of the same group, each once, none with itself."""
    pairs = df.select(*keys, F.col(zone).alias("_i"), F.explode(near).alias("_j")).where("_i <> _j").distinct()
    return pairs.join(df.select(*keys, F.col(zone).alias("_j")), [*keys, "_j"], "left_semi")


def drawn(rows: DataFrame, keys: Sequence[str], draws: int, seed: int) -> DataFrame:
    """``rows`` (keys, _i and others) once for each draw (_d from 1), with their rank (_r from 1) in it."""
    rows = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_d").cast("string"), F.col("_i").cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_d").orderBy(code, "_i")))


def pseudo_p(larger: Column, draws: int) -> Column:
    """(min(larger, draws - larger) + 1) / (draws + 1)."""
    return (F.least(larger, F.lit(draws) - larger) + 1) / F.lit(draws + 1.0)


def moran(df: DataFrame, keys: Sequence[str], zone: str, value: str, near: str, draws: int = 999, seed: int = 42) -> DataFrame:
    """(keys, moran_i, p_sim) under weights of one over a zone's neighbours; the zones' values are dealt anew in each draw.

    A zone takes the value of the zone whose rank in the draw is its own place by key.
    Null values take no part.  A group without spread or without edges has null in both.
    """
    rows = standardised(df.where(F.col(value).isNotNull()), keys, zone, value)
    places = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_i")))
    pairs = edges(df.where(F.col(value).isNotNull()), keys, zone, near)
    pairs = pairs.withColumn("_w", 1.0 / F.count("*").over(Window.partitionBy(*keys, "_i")))
    at = lambda name: places.select(*keys, F.col("_i").alias(name), F.col("_r").alias(f"{name}r"), F.col("_z").alias(f"{name}z"))
    pairs = pairs.join(at("_i"), [*keys, "_i"]).join(at("_j"), [*keys, "_j"])
    seen = pairs.groupBy(*keys).agg(F.sum(F.col("_w") * F.col("_iz") * F.col("_jz")).alias("_seen"), F.sum("_w").alias("_s0"))
    dealt = drawn(rows.select(*keys, "_i", "_z"), keys, draws, seed).select(*keys, "_d", "_r", "_z")
    end = lambda name: dealt.select(*keys, "_d", F.col("_r").alias(f"{name}r"), F.col("_z").alias(f"{name}z"))
    each = pairs.select(*keys, "_ir", "_jr", "_w").join(end("_i"), [*keys, "_ir"]).join(end("_j"), [*keys, "_d", "_jr"])
    each = each.groupBy(*keys, "_d").agg(F.sum(F.col("_w") * F.col("_iz") * F.col("_jz")).alias("_sum"))
    larger = each.join(seen, list(keys)).groupBy(*keys).agg(F.count_if(F.round("_sum", DIGITS) >= F.round("_seen", DIGITS)).alias("_larger"), F.count("_sum").alias("_m"))
    out = rows.select(*keys).distinct().join(seen, list(keys), "left").join(larger, list(keys), "left")
    return out.select(*keys, (F.col("_seen") / F.col("_s0")).alias("moran_i"), F.when(F.col("_m") > 0, pseudo_p(F.col("_larger"), draws)).alias("p_sim"))


def local(df: DataFrame, keys: Sequence[str], zone: str, value: str, near: str, draws: int, seed: int, star: bool) -> DataFrame:
    """(keys, zone, statistic, p_sim, lag, z): Gi* with the zone itself if ``star``, else local Moran, by conditional permutations.

    A zone keeps its value while its k neighbours get those of the first k other zones of
    a draw.  Their sum is a running sum along the draw: to rank k, or to k + 1 without the
    zone's own value where it ranks among the first k itself.  So neither edges nor values
    are copied for the draws.  A zone without neighbours has p 1 (and Moran 0); without
    spread, with fewer than three zones, or with all zones around it, there is no Gi* or
    Moran and no p.  Values must not be missing, nor negative for Gi*.
    """
    v = F.col(value).cast("double")
    wrong = v.isNull() | F.isnan(v) | ((v < 0) if star else F.lit(False))
    text = f"{'Gi*' if star else 'local Moran'} needs values of all zones" + ", none of them negative" * star
    checked = df.withColumn(value, F.when(wrong, F.raise_error(F.lit(text)).cast("double")).otherwise(v))
    rows = standardised(checked, keys, zone, value).withColumn("_z", F.when(F.col("_n") >= 3, F.col("_z")))
    w = Window.partitionBy(*keys)
    spread = checked.select(*keys, F.col(zone).alias("_i"), F.avg(value).over(w).alias("_mean"), F.stddev_pop(value).over(w).alias("_sd"))
    lags = edges(df, keys, zone, near).join(rows.select(*keys, F.col("_i").alias("_j"), F.col("_z").alias("_zj")), [*keys, "_j"]).groupBy(*keys, "_i").agg(F.sum("_zj").alias("_sum"), F.count("*").alias("_k"))
    rows = rows.join(lags, [*keys, "_i"], "left").na.fill(0, ["_k"]).withColumn("_sum", F.coalesce("_sum", F.when(F.col("_z").isNotNull(), 0.0)))
    dealt = drawn(rows.select(*keys, "_i", "_z", "_k"), keys, draws, seed)
    along = Window.partitionBy(*keys, "_d").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.select(*keys, "_d", F.col("_r").alias("_to"), F.sum("_z").over(along).alias("_p"))
    asked = dealt.where("_k > 0 AND _z IS NOT NULL").withColumn("_to", F.col("_k") + (F.col("_r") <= F.col("_k")).cast("int"))
    each = asked.join(sums, [*keys, "_d", "_to"]).select(*keys, "_i", (F.col("_p") - F.when(F.col("_r") <= F.col("_k"), F.col("_z")).otherwise(0.0)).alias("_drawn"))
    sign = F.lit(1.0) if star else F.col("_z")
    larger = each.join(rows.select(*keys, "_i", "_z", "_sum"), [*keys, "_i"]).groupBy(*keys, "_i").agg(F.count_if(F.round(sign * F.col("_drawn"), DIGITS) >= F.round(sign * F.col("_sum"), DIGITS)).alias("_larger"))
    n, own = F.col("_n").cast("double"), (F.col("_k") + 1).cast("double")
    scale = F.sqrt((n * own - own * own) / (n - 1))
    statistic = (F.col("_sum") + F.col("_z")) / F.nullif(scale, F.lit(0.0)) if star else F.when(F.col("_k") > 0, F.col("_z") * F.col("_sum") / F.col("_k")).when(F.col("_z").isNotNull(), 0.0)
    out = rows.join(larger, [*keys, "_i"], "left").join(spread, [*keys, "_i"]).withColumn("statistic", statistic)
    p = F.when(F.col("statistic").isNull(), None).when(F.col("_k") == 0, 1.0).otherwise(pseudo_p(F.coalesce("_larger", F.lit(0)), draws))
    lag = F.when(F.col("_k") > 0, F.col("_sum") / F.col("_k") * F.col("_sd")).otherwise(0.0)
    return out.select(*keys, F.col("_i").alias(zone), "statistic", p.alias("p_sim"), F.coalesce(lag, F.lit(0.0)).alias("lag"), (F.col("_v") - F.col("_mean")).alias("z"))
