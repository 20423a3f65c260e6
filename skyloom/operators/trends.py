"""Robust trends of annual series: pair slopes, Mann-Kendall, decades, sensor offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import scalar

MIN_YEARS = 3


def year_pairs(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """All pairs of a series' valid years, earlier first: keys, y1, v1, y2, v2.

    The series is gathered per key and paired in place, so no row is shuffled twice;
    a series has as many values as years.
    """
    series = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v")))).alias("s"))
    first = series.select(*keys, "s", F.posexplode("s").alias("i", "a"))
    return first.select(*keys, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).select(*keys, F.col("a.y").alias("y1"), F.col("a.v").alias("v1"), F.col("b.y").alias("y2"), F.col("b.v").alias("v2"))


def sen_slope(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Theil-Sen slope and the median of value - slope * year, with the years seen."""
    pairs = year_pairs(df, keys, year, value).where("y2 <> y1")
    slopes = pairs.groupBy(*keys).agg(F.median((F.col("v2") - F.col("v1")) / (F.col("y2") - F.col("y1"))).alias("slope"))
    rows = df.where(F.col(value).isNotNull()).join(slopes, list(keys))
    return rows.groupBy(*keys, "slope").agg(F.median(F.col(value) - F.col("slope") * F.col(year)).alias("intercept"), F.count("*").alias("n_years"))


def mann_kendall(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """S, its variance without ties and continuity-corrected Z per series; null below three years."""
    s = year_pairs(df, keys, year, value).groupBy(*keys).agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).alias("s"))
    n = df.groupBy(*keys).agg(F.count(value).cast("double").alias("n"))
    out = n.join(s, list(keys), "left").withColumn("s", F.when(F.col("n") >= MIN_YEARS, F.coalesce("s", F.lit(0.0))))
    var = F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18
    out = out.withColumn("var_s", F.when(F.col("n") >= MIN_YEARS, var))
    return out.withColumn("z", F.when(F.col("s") == 0, 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt("var_s")))


def two_sided_p(z: str) -> Column:
    """Two-sided normal p of the column z."""
    return scalar.two_sided_p(F.col(z))


def decades(df: DataFrame, windows: Sequence[tuple[str, int, int]], year: str, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean, population sd and count of each inclusive window of years per key, long."""
    label = F.lit(None).cast("string")
    for name, low, high in windows:
        label = F.when(F.col(year).between(low, high), name).otherwise(label)
    return df.withColumn("decade", label).where("decade IS NOT NULL").groupBy(*keys, "decade").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def decadal_difference(df: DataFrame, first: str, last: str, keys: Sequence[str]) -> DataFrame:
    """Difference of two decades' means with its standard error sqrt(s1^2/n1 + s2^2/n2)."""
    one = lambda name, c: F.max(F.when(F.col("decade") == name, F.col(c)))
    d = df.groupBy(*keys).agg((one(last, "mean") - one(first, "mean")).alias("difference"), F.sqrt(one(first, "sd") * one(first, "sd") / one(first, "n") + one(last, "sd") * one(last, "sd") / one(last, "n")).alias("se"))
    return d


def sensor_offsets(df: DataFrame, sensor: str, year: str, value: str, least: int) -> DataFrame:
    """Mean and sd of the difference of each sensor pair over their shared years; null figures below ``least`` years."""
    a = df.select(F.col(sensor).alias("sensor_a"), F.col(year).alias("year"), F.col(value).alias("va"))
    b = df.select(F.col(sensor).alias("sensor_b"), F.col(year).alias("year"), F.col(value).alias("vb"))
    d = F.col("vb") - F.col("va")
    out = a.join(b, "year").where("sensor_a < sensor_b").groupBy("sensor_a", "sensor_b").agg(F.count(d).alias("shared"), F.avg(d).alias("offset"), F.stddev_samp(d).alias("sd"))
    enough = F.col("shared") >= least
    return out.select("sensor_a", "sensor_b", "shared", F.when(enough, F.col("offset")).alias("offset"), F.when(enough, F.col("sd")).alias("sd"))


def kendall_tau(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Kendall's tau-b per series: S over the root of all pairs times the pairs whose values differ; null for a constant series."""
    d = F.signum(F.col("v2") - F.col("v1"))
    pairs = year_pairs(df, keys, year, value).where("y2 <> y1").groupBy(*keys).agg(F.sum(d).alias("s"), F.count("*").alias("n"), F.count_if(d != 0).alias("m"))
    return pairs.select(*keys, (F.col("s") / F.nullif(F.sqrt(F.col("n").cast("double") * F.col("m")), F.lit(0.0))).alias("tau"))


#: Fixed values of the count check: correlations that are strong and that are none.
STRONG, NONE = 0.5, 0.3


def count_verdict(n: Column, r: Column, slope: Column) -> Column:
    """Whether observation counts explain a series' trend, given their correlation (null if either is constant) and the counts' slope.

    Values that fall while counts rise look like an artefact of sampling; counts that
    do not vary or do not correlate explain nothing; the rest is partial.
    """
    return (
        F.when(n < MIN_YEARS, "insufficient_data").when(r.isNull(), "not_explained_by_sampling")
        .when((r <= -STRONG) & (slope > 0), "sampling_artefact_likely").when(F.abs(r) < NONE, "not_explained_by_sampling").otherwise("partial_association")
    )


def count_check(df: DataFrame, keys: Sequence[str], year: str, value: str, count: str) -> DataFrame:
    """keys, n_years, slope and obs_slope (Theil-Sen), r and verdict over the years that have both values."""
    both = df.where(F.col(value).isNotNull() & F.col(count).isNotNull())
    # corr() itself fails on a constant column.
    r = F.covar_pop(value, count) / F.nullif(F.stddev_pop(value) * F.stddev_pop(count), F.lit(0.0))
    seen = both.groupBy(*keys).agg(F.count("*").alias("n_years"), F.when(F.count("*") >= MIN_YEARS, r).alias("r"))
    own, counts = (sen_slope(both, keys, year, v).select(*keys, F.col("slope").alias(name)) for v, name in ((value, "slope"), (count, "obs_slope")))
    out = seen.join(own, list(keys), "left").join(counts, list(keys), "left")
    return out.withColumn("verdict", count_verdict(F.col("n_years"), F.col("r"), F.col("obs_slope")))
