"""One table of statistics at several nested levels of zones, from one pass by grouping sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics over a level's units, with the units that each needs.
NEEDS = {"mean": 1, "weighted_mean": 1, "sd": 2, "variation": 2, "correlation": 3, "slope": 3}


def units(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, other: str | None = None) -> DataFrame:
    """(level, unit, value, other, n): means over the units of every level, each row read once.

    ``levels`` maps a level's name to the columns that name its units, a coarser one's
    being among a finer one's; none for the whole table.  Rows without a unit at a level
    take no part there; null values count neither in means nor in n.
    """
    columns = sorted({c for keys in levels.values() for c in keys})
    if not columns:
        raise ValueError("some level needs columns")
    known = [*[F.col(c) for c in columns], F.col(value).cast("double").alias("_v"), (F.col(other) if other else F.lit(None)).cast("double").alias("_o")]
    sums = df.select(*known).groupingSets([[F.col(c) for c in keys] for keys in levels.values()], *columns).agg(F.grouping_id().alias("_g"), F.avg("_v").alias("value"), F.avg("_o").alias("other"), F.count("_v").alias("n"))
    # A grouping id has a bit for each column, set where the column is summed over.
    code = lambda keys: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)
    name, complete = F.lit(None).cast("string"), F.lit(True)
    for level, keys in levels.items():
        here = F.col("_g") == code(keys)
        name = F.when(here, level).otherwise(name)
        for c in keys:
            complete = complete & (~here | F.col(c).isNotNull())
    unit = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return sums.where(complete).select(name.alias("level"), unit.alias("unit"), "value", "other", "n")


def _figures() -> dict[str, Column]:
    """Each statistic over units; correlation and slope of other on value only where both are known."""
    v, o = F.col("value"), F.col("other")
    both = v.isNotNull() & o.isNotNull()
    x, y = F.when(both, v), F.when(both, o)
    sd = F.stddev_pop(v)
    return {
        "mean": F.avg(v), "weighted_mean": F.sum(v * F.col("n")) / F.nullif(F.sum(F.when(v.isNotNull(), F.col("n"))).cast("double"), F.lit(0.0)), "sd": sd, "variation": sd / F.nullif(F.abs(F.avg(v)), F.lit(0.0)),
        "correlation": F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), "slope": F.covar_pop(x, y) / F.nullif(F.var_pop(x), F.lit(0.0)),
    }


def comparison(df: DataFrame, levels: Mapping[str, Sequence[str]], value: str, other: str | None = None, statistics: Sequence[str] = tuple(NEEDS)) -> DataFrame:
    """(statistic, level, n_units, status, value, reason): how statistics depend on the units they are taken over.

    Every statistic has a row at every level, those of an empty table included.  One that
    cannot be estimated has status ``not_estimable``, a null value and the reason: fewer
    units than it needs, or no spread among them.  n_units counts units with the
    statistic's values.
    """
    wrong = [s for s in statistics if s not in NEEDS]
    if wrong:
        raise ValueError(f"unknown statistics {wrong}; known are {sorted(NEEDS)}")
    figures = _figures()
    both = F.col("value").isNotNull() & F.col("other").isNotNull()
    by = units(df, levels, value, other).groupBy("level").agg(F.count("value").alias("_one"), F.count_if(both).alias("_two"), *[figures[s].alias(s) for s in statistics])
    spine = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    rows = spine.join(by, "level", "left").na.fill(0, ["_one", "_two"])
    of = F.array(*[F.struct(F.lit(s).alias("statistic"), F.lit(NEEDS[s]).alias("needs"), F.col("_two" if NEEDS[s] > 2 else "_one").alias("n_units"), F.col(s).alias("value")) for s in statistics])
    rows = rows.select("level", F.inline(of))
    few = F.col("n_units") < F.col("needs")
    reason = F.when(few, F.concat_ws(" ", F.col("n_units").cast("string"), F.lit("units of"), F.col("needs").cast("string"), F.lit("needed"))).when(F.col("value").isNull(), "no spread among units").otherwise("")
    value_ = F.when(~few, F.col("value"))
    return rows.select("statistic", "level", "n_units", F.when(value_.isNull(), "not_estimable").otherwise("ok").alias("status"), value_.alias("value"), reason.alias("reason"))
