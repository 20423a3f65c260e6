"""Aggregation shapes: composites with spines, zonal and stratified statistics, shares, crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_spine(df: DataFrame, spine: DataFrame, on: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Every row of ``spine`` with its figures: null values but 0 for ``counts`` where nothing was seen."""
    return spine.join(df, list(on), "left").na.fill(0, list(counts))


def composite(df: DataFrame, keys: Sequence[str], value: str, spine: DataFrame | None = None) -> DataFrame:
    """Median, 90th percentile, mean and count of the valid values per key; with ``spine``, empty keys stay."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.median(v).alias("median"), F.percentile(v, F.lit(0.9)).alias("p90"), F.avg(v).alias("mean"), F.count(v).alias("n_obs"))
    return out if spine is None else with_spine(out, spine, keys, ["n_obs"])


def zonal(df: DataFrame, zone: Sequence[str], value: str) -> DataFrame:
    """One pass of mean, median, population sd, minimum, maximum, sum and count per zone."""
    v = F.col(value)
    return df.groupBy(*zone).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"), F.count(v).alias("n_obs"))


def contrast(df: DataFrame, keys: Sequence[str], value: str, inside: Column, outside: Column) -> DataFrame:
    """Mean inside minus mean outside per key with both counts; null if a side is empty."""
    v = F.col(value)
    a, b = F.when(inside, v), F.when(outside, v)
    return df.groupBy(*keys).agg(F.avg(a).alias("inside_mean"), F.avg(b).alias("outside_mean"), (F.avg(a) - F.avg(b)).alias("difference"), F.count(a).alias("inside_n"), F.count(b).alias("outside_n"))


def stratified(df: DataFrame, strata: Sequence[str], value: str, floor: int) -> DataFrame:
    """Mean, sd and count per stratum, flagged where fewer than ``floor`` values were seen."""
    v = F.col(value)
    return df.groupBy(*strata).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n_obs")).withColumn("below_floor", F.col("n_obs") < floor)


def histogram(df: DataFrame, code: Column, codes: Sequence[int]) -> DataFrame:
    """Count of each code, codes that were not seen included."""
    spine = df.sparkSession.createDataFrame([(c,) for c in codes], "code int")
    return with_spine(df.select(code.cast("int").alias("code")).groupBy("code").agg(F.count("*").alias("n")), spine, ["code"], ["n"])


def shares(df: DataFrame, keys: Sequence[str], code: str, codes: Sequence[int]) -> DataFrame:
    """Share of each counted code per key, long; the denominator is the sum over ``codes``, a zero total gives null."""
    counted = df.where(F.col(code).isin(*codes)).groupBy(*keys, code).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("share", F.col("n") / F.nullif(total, F.lit(0)))


def class_percent(df: DataFrame, keys: Sequence[str], code: str, codes: Sequence[int]) -> DataFrame:
    """Count and per cent of every one of ``codes`` per key, 0 where absent; null per cent for a key without any."""
    counted = df.groupBy(*keys).agg(*[F.count_if(F.col(code) == c).alias(f"_{c}") for c in codes])
    total = sum((F.col(f"_{c}") for c in codes), F.lit(0))
    long = counted.select(*keys, total.alias("_total"), F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"_{c}").alias("n")) for c in codes])).alias("_x"))
    return long.select(*keys, F.col("_x.code").alias(code), F.col("_x.n").alias("n"), (100 * F.col("_x.n") / F.nullif(F.col("_total"), F.lit(0))).alias("percent"))


def modal(df: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """The most frequent code per key, ties to the smallest."""
    counted = df.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.count("*").alias("n"))
    best = counted.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), F.col(code).alias("code"))).alias("x"))
    return best.select(*keys, F.col("x.code").alias("code"), (-F.col("x")["col1"]).alias("n"))


def crosstab(df: DataFrame, row: Column, column: str, values: Sequence[str], names: Sequence[str], key: str = "row") -> DataFrame:
    """Counts of ``values`` per row as columns ``names``, 0 where empty, with a total over all values."""
    seen = [F.count_if(F.col(column) == v).alias(n) for v, n in zip(values, names, strict=True)]
    return df.groupBy(row.alias(key)).agg(*seen, F.count("*").alias("total"))


def weighted_share(df: DataFrame, keys: Sequence[str], weight: str, condition: Column) -> DataFrame:
    """Weight under the condition as per cent of all weight per key; null without weight."""
    w = F.col(weight)
    return df.groupBy(*keys).agg((100 * F.sum(F.when(condition, w).otherwise(0.0)) / F.nullif(F.sum(w), F.lit(0.0))).alias("percent"), F.sum(w).alias("weight"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, required: Sequence[str] = ()) -> DataFrame:
    """The n rows of least md5(key, seed) among those complete in ``required``: exact in count and the same everywhere."""
    code = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.na.drop(subset=list(required) or [key]).withColumn("code", code).orderBy("code", key).limit(n).drop("code")


def mentions(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str) -> DataFrame:
    """(item, documents, first_doc): how many ``docs`` hold an item's text anywhere in theirs, 0 for none.

    ``items`` is broadcast and must be bounded; every item is sought in every whole text.
    """
    wanted = F.broadcast(items.select(item, F.col(text).alias("_wanted")))
    found = docs.select(doc, text).join(wanted, F.contains(F.col(text), F.col("_wanted"))).groupBy(F.col(item).alias("_item"))
    found = found.agg(F.count(doc).alias("documents"), F.min(doc).alias("first_doc"))
    return items.select(item).distinct().join(found, F.col(item).eqNullSafe(F.col("_item")), "left").select(item, F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), "first_doc")
