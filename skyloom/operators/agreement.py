"""Splits, agreement of class maps, transitions, fit measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_blocks(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """``df`` with ``block``: dense ids from 0 of floor(x/size), floor(y/size) in lexicographic order.

    Ids are made on the distinct blocks, not on the rows.
    """
    at = df.withColumns({"bx": F.floor(F.col(x) / size), "by": F.floor(F.col(y) / size)})
    blocks = at.select("bx", "by").distinct().withColumn("block", F.row_number().over(Window.orderBy("bx", "by")) - 1)
    return at.join(blocks, ["bx", "by"])


def shuffled(blocks: Column, seed: int) -> Column:
    """A seeded order of blocks that every engine gives alike."""
    return F.md5(F.concat_ws(":", blocks.cast("string"), F.lit(str(seed))))


def blocked_folds(df: DataFrame, block: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: whole blocks in seeded order, cut into near-equal parts."""
    dealt = df.select(block).distinct().withColumn("fold", F.ntile(folds).over(Window.orderBy(shuffled(F.col(block), seed), block)))
    return df.join(dealt, block)


def held_blocks(sizes: DataFrame, block: str, share: float, seed: int) -> DataFrame:
    """``sizes``, a row a block with its rows ``n``, with ``held_out``: blocks in seeded order until the share of rows is reached."""
    order = Window.orderBy(shuffled(F.col(block), seed), block).rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("n").over(order), F.lit(0)), F.sum("n").over(Window.partitionBy(F.lit(0)))
    return sizes.withColumn("held_out", before < share * total)


def blocked_split(df: DataFrame, block: str, share: float, seed: int) -> DataFrame:
    """``df`` with ``held_out``: whole blocks in seeded order until the share of rows is reached."""
    sizes = df.groupBy(block).agg(F.count("*").alias("n"))
    return df.join(held_blocks(sizes, block, share, seed).select(block, "held_out"), block)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Counts of (truth, guess) pairs, both known."""
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def agreement(counts: DataFrame) -> DataFrame:
    """Overall agreement, kappa (null if chance agreement is 1), quantity and allocation disagreement."""
    total = counts.agg(F.sum("n").cast("double").alias("total"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("same"))
    rows = counts.groupBy(F.col("truth").alias("code")).agg(F.sum("n").alias("a"))
    cols = counts.groupBy(F.col("guess").alias("code")).agg(F.sum("n").alias("b"))
    margins = rows.join(cols, "code", "outer").na.fill(0, ["a", "b"]).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("apart"))
    one = total.withColumn("k", F.lit(1)).join(margins.withColumn("k", F.lit(1)), "k")
    overall, chance = F.col("same") / F.col("total"), F.col("ab") / (F.col("total") * F.col("total"))
    quantity = F.col("apart") / 2 / F.col("total")
    return one.select(overall.alias("overall"), F.when(chance < 1, (overall - chance) / (1 - chance)).alias("kappa"), quantity.alias("quantity"), (1 - overall - quantity).alias("allocation"))


def figure_of_merit(df: DataFrame, before: str, truth: str, guess: str) -> DataFrame:
    """Hits over hits, misses, wrong hits and false alarms of predicted change."""
    b, t, g = F.col(before), F.col(truth), F.col(guess)
    hit, wrong = F.count_if((t != b) & (g == t)), F.count_if((t != b) & (g != b) & (g != t))
    miss, alarm = F.count_if((t != b) & (g == b)), F.count_if((t == b) & (g != b))
    return df.agg(hit.alias("hits"), wrong.alias("wrong_hits"), miss.alias("misses"), alarm.alias("false_alarms"), (hit / F.nullif(hit + wrong + miss + alarm, F.lit(0))).alias("merit"))


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """(a, b, p): shares of next states; a state never left becomes the identity."""
    step = df.withColumn("_next", F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))).where("_next IS NOT NULL")
    counts = step.groupBy(F.col(state).alias("a"), F.col("_next").alias("b")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    spine = spark.createDataFrame([(x, y) for x in states for y in states], "a string, b string")
    full = spine.join(counts, ["a", "b"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("a"))
    return full.select("a", "b", F.when(total > 0, F.col("n") / total).otherwise((F.col("a") == F.col("b")).cast("double")).alias("p"))


def markov_step(p: DataFrame, q: DataFrame) -> DataFrame:
    """The product of two transition tables."""
    right = q.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("p").alias("q"))
    return p.join(right, "b").groupBy("a", "c").agg(F.sum(F.col("p") * F.col("q")).alias("p")).withColumnRenamed("c", "b")


def projected_areas(areas: DataFrame, p: DataFrame) -> DataFrame:
    """(code, cells): projected whole cells; fractions are floored and the rest goes to the largest class."""
    raw = areas.select(F.col("code").alias("a"), F.col("cells")).join(p, "a").groupBy(F.col("b").alias("code")).agg(F.sum(F.col("cells") * F.col("p")).alias("raw"))
    whole = Window.partitionBy(F.lit(0))
    raw = raw.withColumns({"low": F.floor(F.round("raw", 9)), "order": F.row_number().over(Window.orderBy(F.desc(F.round("raw", 9)), "code"))})
    rest = F.round(F.sum("raw").over(whole)).cast("long") - F.sum("low").over(whole)
    return raw.select("code", (F.col("low") + F.when(F.col("order") == 1, rest).otherwise(0)).alias("cells"))


def r_squared(truth: Column, guess: Column) -> Column:
    """R2 about the mean of the rows, as an aggregate; null without spread."""
    e = truth - guess
    return 1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))


def fit_measures(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """RMSE, and R2 about the mean of the given rows; it may be negative, and is null without spread."""
    t, e = F.col(truth), F.col(truth) - F.col(guess)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), r_squared(t, F.col(guess)).alias("r2"), F.count(e).alias("n"))


def extrapolated(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``outside``: whether any feature leaves the training range; the ranges are one broadcast row."""
    ends = train.agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("min", F.min), ("max", F.max))])
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(ends.withColumn("_k", F.lit(1))), "_k")
    outside = F.lit(False)
    for c in features:
        outside = outside | (F.col(c) < F.col(f"_min_{c}")) | (F.col(c) > F.col(f"_max_{c}"))
    return joined.select(*df.columns, outside.alias("outside"))


def class_profiles(df: DataFrame, code: str, features: Sequence[str], floor: int) -> DataFrame:
    """Median of each feature per class, its count, and whether it is thin."""
    return df.groupBy(code).agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in features]).withColumn("thin", F.col("n") < floor)
