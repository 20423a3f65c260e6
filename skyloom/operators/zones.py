"""Zone tables: joins whose left side wins, criteria with gates, comparison of rankings, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import windows


def merged(tables: Sequence[DataFrame], key: str, how: str = "outer") -> DataFrame:
    """Tables joined on ``key``; of columns with one name the first table's stays."""
    if not tables:
        raise ValueError("no tables were given")

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.drop(*[c for c in right.columns if c in left.columns and c != key]), key, how)

    return reduce(add, tables[1:], tables[0])


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population z-scores of the columns over the whole table, whose moments are one broadcast row; 0 without spread."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).withColumn("_k", F.lit(1))
    out = df.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns}
    return out.withColumns(z).select(*df.columns)


def model_frame(tables: Sequence[DataFrame], key: str, response: str, predictors: Sequence[str], standardise: bool = True) -> DataFrame:
    """Key, response and predictors of the zones that have all of them; predictors as z-scores if asked."""
    joined = merged(tables, key)
    if absent := [c for c in (response, *predictors) if c not in joined.columns]:
        raise ValueError(f"the joined tables have no {absent}")
    whole = joined.select(key, response, *predictors).na.drop(subset=[response, *predictors])
    return standardised(whole, predictors) if standardise else whole


def usable(df: DataFrame, criteria: Sequence[tuple[str, str | None]], floor: int) -> DataFrame:
    """``df`` with ``<column>_usable`` (not null, and its count column at the floor at least) and ``n_least``, the least of the counts."""
    flags = {f"{c}_usable": F.col(c).isNotNull() & (F.coalesce(F.col(n) >= floor, F.lit(False)) if n else F.lit(True)) for c, n in criteria}
    counts = [F.col(n).cast("double") for _, n in criteria if n]
    least = F.least(*counts) if len(counts) > 1 else counts[0] if counts else F.lit(None).cast("double")
    return df.withColumns({**flags, "n_least": least})


#: What becomes of a zone's scores.
SCORED, PARTIAL, INSUFFICIENT = "scored", "partial", "insufficient"


def prepared(df: DataFrame, criteria: Sequence[tuple[str, str | None, float, bool]], floor: int, most_missing: float) -> DataFrame:
    """Criteria (column, count column, weight, benefit) gated by their counts, turned so that more is better, and ranked to 0..1.

    Adds ``<column>_norm`` (null where not usable), ``missing_weight`` and ``status``:
    insufficient above ``most_missing``, partial with something missing, else scored.
    """
    out = usable(df, [(c, n) for c, n, _, _ in criteria], floor)
    gated = {c: F.when(F.col(f"{c}_usable"), F.col(c)) for c, *_ in criteria}
    out = out.withColumns(gated)
    out = out.withColumns({f"{c}_norm": windows.percent_rank(F.col(c) if benefit else -F.col(c), []) for c, _, _, benefit in criteria})
    total = float(sum(w for *_, w, _ in criteria))
    missing = sum((F.when(F.col(f"{c}_usable"), 0.0).otherwise(float(w)) for c, _, w, _ in criteria), F.lit(0.0)) / total
    status = F.when(F.col("missing_weight") > most_missing, INSUFFICIENT).when(F.col("missing_weight") > 0, PARTIAL).otherwise(SCORED)
    return out.withColumn("missing_weight", missing).withColumn("status", status)


def at_the_cut(ranked: DataFrame, score: str) -> DataFrame:
    """One row about a ranking with ``eligible`` and ``in_top``: how many are in the top, the score gap at the cut, and how many below it tie."""
    top, rest = F.col("in_top"), F.col("eligible") & ~F.col("in_top")
    one = ranked.agg(F.count_if("in_top").alias("n_top"), F.count_if("eligible").alias("n_eligible"), F.min(F.when(top, F.col(score))).alias("_low"), F.max(F.when(rest, F.col(score))).alias("_high"), F.collect_list(F.when(rest, F.col(score))).alias("_rest"))
    return one.select("n_top", "n_eligible", (F.col("_low") - F.col("_high")).alias("gap"), F.size(F.filter("_rest", lambda x: x >= F.col("_low") - 1e-12)).cast("long").alias("tied"))


def shifts(left: DataFrame, right: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """The n zones whose rank differs most between two rankings, ties by key."""
    both = left.select(key, F.col(a).alias("left_rank")).join(right.select(key, F.col(b).alias("right_rank")), key)
    both = both.withColumn("shift", F.col("right_rank") - F.col("left_rank")).withColumn("size", F.abs("shift"))
    return both.orderBy(F.desc("size"), key).limit(n)


def agreement_of(left: DataFrame, right: DataFrame, key: str, a: str, b: str, n: int) -> DataFrame:
    """One row on two rankings without ties: n, Spearman's rho, Kendall's tau, common zones of both first n and their Jaccard share.

    Concordant pairs are counted in one sort: zones in the order of one rank, and the
    sum over pairs of whether the other rank rises.
    """
    both = left.select(key, F.col(a).alias("ra")).join(right.select(key, F.col(b).alias("rb")), key)
    line = both.agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("s"), F.lit(1).alias("_k"))
    rise = F.aggregate(F.transform("s", lambda x, i: F.aggregate(F.slice("s", i + 2, F.size("s")), F.lit(0).cast("long"), lambda acc, y: acc + F.signum((y["rb"] - x["rb"]).cast("double")).cast("long"))), F.lit(0).cast("long"), lambda p, q: p + q)
    common = F.count_if((F.col("ra") <= n) & (F.col("rb") <= n))
    either = F.count_if((F.col("ra") <= n) | (F.col("rb") <= n))
    one = both.agg(F.count("*").alias("n"), (F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))).alias("rho"), common.alias("common_top"), (common / F.nullif(either, F.lit(0))).alias("jaccard"), F.lit(1).alias("_k"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return one.join(line, "_k").select("n", "rho", (rise / F.nullif(pairs, F.lit(0.0))).alias("tau"), "common_top", "jaccard")


def top_zones(ranked: DataFrame, rank: str, score: str, n: int, status: str | None = None, left_out: Sequence[str] = (), flagged: bool = False) -> DataFrame:
    """The first n zones by rank; without ``flagged``, those without score or with a status that is left out do not count."""
    keep = F.lit(True) if flagged else F.col(score).isNotNull() & (~F.coalesce(F.col(status).isin(*left_out), F.lit(False)) if status and left_out else F.lit(True))
    return ranked.where(keep).orderBy(F.col(rank).asc_nulls_last()).limit(n)


def long_contrast(wide: DataFrame, keys: Sequence[str], definitions: Sequence[str]) -> DataFrame:
    """Wide rows with ``<definition>_<inside|outside>_<mean|count>`` made long: keys, definition, both means, their difference, both counts."""
    need = [f"{d}_{side}_{what}" for d in definitions for side in ("inside", "outside") for what in ("mean", "count")]
    if absent := [c for c in need if c not in wide.columns]:
        raise ValueError(f"the table has no {absent}")
    each = F.array(*[F.struct(F.lit(d).alias("definition"), *[F.col(f"{d}_{side}_{what}").alias(f"{side}_{what}") for side in ("inside", "outside") for what in ("mean", "count")]) for d in definitions])
    long = wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
    return long.select(*keys, "definition", "inside_mean", "outside_mean", (F.col("inside_mean") - F.col("outside_mean")).alias("difference"), "inside_count", "outside_count")


def stacked(parts: Sequence[tuple[str, DataFrame]], name: str) -> DataFrame:
    """Tables of the same columns one after the other, with the name of each."""
    return reduce(lambda a, b: a.unionByName(b), (df.withColumn(name, F.lit(label)) for label, df in parts))


def inventory(rows: DataFrame, year: str, column: str, values: Sequence[str], first: int, last: int) -> DataFrame:
    """Counts by year and value with a total of these values; every year from first to last is there, 0 where empty."""
    spine = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    counted = rows.groupBy(F.col(year).cast("int").alias("year")).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return spine.join(counted, "year", "left").na.fill(0, list(values)).withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def steps_between(means: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Change of a value from each step to the next, whether the series never turns, and its largest step's place."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = means.withColumn("change", F.col(value) - F.lag(value).over(w))
    whole = Window.partitionBy(*keys)
    ups, downs = F.count_if(F.col("change") > 0).over(whole), F.count_if(F.col("change") < 0).over(whole)
    return out.withColumns({"monotonic": (ups == 0) | (downs == 0), "largest": F.coalesce(F.abs("change") == F.max(F.abs("change")).over(whole), F.lit(False))})


def correlations(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """(predictor, r, n) over the rows that have both; null r below three rows or without spread."""

    def one(x: str) -> Column:
        both = F.col(x).isNotNull() & F.col(response).isNotNull()
        a, b = F.when(both, F.col(x)), F.when(both, F.col(response))
        r = F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
        return F.struct(F.lit(x).alias("predictor"), F.when(F.count_if(both) >= 3, r).alias("r"), F.count_if(both).alias("n"))

    return df.agg(F.array(*map(one, predictors)).alias("x")).select(F.inline("x"))


def quality_share(df: DataFrame, fields: Sequence[tuple[str, Column, Sequence[int]]]) -> DataFrame:
    """(field, code, n, share) of every code of every bit field in one pass, absent ones as 0; an empty total counts as 1."""
    counts = df.agg(*[F.count_if(value == c).alias(f"{name}:{c}") for name, value, codes in fields for c in codes])
    rows = [F.struct(F.lit(name).alias("field"), F.lit(c).alias("code"), F.col(f"`{name}:{c}`").alias("n"), (F.col(f"`{name}:{c}`") / F.greatest(F.lit(1), sum((F.col(f"`{name}:{x}`") for x in codes), F.lit(0)))).alias("share")) for name, _, codes in fields for c in codes]
    return counts.select(F.inline(F.array(*rows)))


def power_share(df: DataFrame, category: str, underpowered: str, limit: str, none: str = "no_pattern") -> DataFrame:
    """One row: zones, zones without pattern, underpowered ones, their share of those without pattern, median limit and verdict."""
    out = df.agg(F.count("*").alias("zones"), F.count_if(F.col(category) == none).alias("no_pattern"), F.count_if(F.coalesce(underpowered, F.lit(False))).alias("underpowered"), F.median(limit).alias("median_limit"))
    share = F.col("underpowered") / F.nullif(F.col("no_pattern"), F.lit(0))
    verdict = F.when(F.col("zones") == 0, "no zones").when(F.col("no_pattern") == 0, "power is no constraint").when(share >= 0.5, "mostly underpowered").otherwise("mostly without pattern")
    return out.select("zones", "no_pattern", "underpowered", share.alias("share"), "median_limit", verdict.alias("verdict"))


#: Adjusted p up to which a hot or cold spot is one of 99, 95 or 90 per cent.
CONFIDENCE = ((0.01, "99"), (0.05, "95"), (0.10, "90"))


def confidence_class(p: Column, z: Column) -> Column:
    """hot_99 to cold_90 by adjusted p and the sign of z, else not_significant."""
    side = F.when(z > 0, "hot").when(z < 0, "cold")
    level = F.lit(None).cast("string")
    for limit, name in reversed(CONFIDENCE):
        level = F.when(p <= limit, name).otherwise(level)
    return F.coalesce(F.concat(side, F.lit("_"), level), F.lit("not_significant"))


def validity(p: Column, slope: Column, n: Column, floor: int) -> Column:
    """Whether a trend can be reported: p and slope are numbers and there are enough years."""
    number = lambda c: F.coalesce(~F.isnan(c.cast("double")), F.lit(False))
    return number(p) & number(slope) & number(n) & F.coalesce(n >= floor, F.lit(False))


def equal_split(groups: dict[str, Sequence[str]]) -> dict[str, float]:
    """Weights of a two-level hierarchy with equal parts for groups and for the members of each."""
    members = [m for ms in groups.values() for m in ms]
    if not groups or not all(groups.values()) or len(set(members)) < len(members):
        raise ValueError("groups must have members, and each member only one group")
    return {m: 1.0 / len(groups) / len(ms) for ms in groups.values() for m in ms}
