"""Multi-criteria ranking: pairwise weights, weighted overlay, TOPSIS, comparison of rankings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import windows

#: Saaty's random consistency index by matrix size.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def pairwise_weights(matrix: Sequence[Sequence[float]]) -> tuple[list[float], float]:
    """Principal-eigenvector weights of a reciprocal matrix and its consistency ratio.

    At most ten criteria, so it is the driver's work.  Refuses matrices that are not
    square, positive and reciprocal.
    """
    a = np.asarray(matrix, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or len(a) not in RANDOM_INDEX:
        raise ValueError("the judgements are no square matrix of 1 to 10 criteria")
    if not (a > 0).all() or not np.allclose(a * a.T, 1):
        raise ValueError("the judgements are not positive and reciprocal")
    values, vectors = np.linalg.eig(a)
    top = int(values.real.argmax())
    w = np.abs(vectors[:, top].real)
    n = len(a)
    index = (values[top].real - n) / (n - 1) if n > 2 else 0.0
    return (w / w.sum()).tolist(), float(index / RANDOM_INDEX[n]) if RANDOM_INDEX[n] else 0.0


def overlay(scores: Sequence[tuple[Column, float]], most_missing: float = 0.5) -> Column:
    """Weighted mean of 0-1 scores; a missing one's weight is shared out, above ``most_missing`` the result is null."""
    total = sum(w for _, w in scores)
    have = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in scores), F.lit(0.0))
    value = sum((F.coalesce(c * F.lit(float(w)), F.lit(0.0)) for c, w in scores), F.lit(0.0))
    return F.when(F.lit(total) - have <= most_missing * total, value / F.nullif(have, F.lit(0.0)))


def ranked(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """``df`` with ``rank`` by descending score (nulls last, ties by key), ``eligible`` and ``in_top``: among the first n eligible rows."""
    order = Window.orderBy(F.col(score).desc_nulls_last(), key)
    out = df.withColumns({"rank": F.row_number().over(order), "eligible": F.col(score).isNotNull()})
    seen = F.sum(F.col("eligible").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("in_top", F.col("eligible") & (seen <= n))


def topsis(df: DataFrame, key: str, criteria: Sequence[tuple[str, float, bool]]) -> DataFrame:
    """(key, closeness) from (column, weight, benefit); costs are negated, negative floors shifted to 0, nulls add nothing."""
    turned = {n: F.col(n) if benefit else -F.col(n) for n, _, benefit in criteria}
    out = windows.with_totals(df, {f"_m_{n}": F.min(c) for n, c in turned.items()})
    out = out.withColumns({f"_s_{n}": c - F.least(F.col(f"_m_{n}"), F.lit(0.0)) for n, c in turned.items()})
    square = lambda c: c * c
    out = windows.with_totals(out, {f"_{k}_{n}": f(F.col(f"_s_{n}")) for n in turned for k, f in (("q", lambda s: F.sqrt(F.sum(square(s)))), ("hi", F.max), ("lo", F.min))})
    best, worst = F.lit(0.0), F.lit(0.0)
    for n, weight, _ in criteria:
        scale = F.lit(float(weight)) / F.nullif(F.col(f"_q_{n}"), F.lit(0.0))
        best = best + F.coalesce(square((F.col(f"_s_{n}") - F.col(f"_hi_{n}")) * scale), F.lit(0.0))
        worst = worst + F.coalesce(square((F.col(f"_s_{n}") - F.col(f"_lo_{n}")) * scale), F.lit(0.0))
    near, far = F.sqrt(best), F.sqrt(worst)
    return out.select(key, F.when(near + far == 0, 0.5).otherwise(far / (near + far)).alias("closeness"))


def compared(a: DataFrame, b: DataFrame, key: str, rank: str, n: int) -> DataFrame:
    """Rank correlation and size of the common top n of two rankings of the same keys."""
    both = a.select(key, F.col(rank).alias("ra")).join(b.select(key, F.col(rank).alias("rb")), key)
    return both.agg(F.corr("ra", "rb").alias("spearman"), F.count_if((F.col("ra") <= n) & (F.col("rb") <= n)).alias("common_top"), F.count("*").alias("n"), F.max(F.abs(F.col("ra") - F.col("rb"))).alias("largest_move"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> None:
    """Refuses rankings of different sets of keys."""
    left, right = a.select(key), b.select(key)
    if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
        raise ValueError(f"the rankings are of different sets of {key}")


def verdict(need: Column, supply: Column) -> Column:
    """Five-way compliance from two pass flags; unknown on either side is not assessable."""
    return F.when(need.isNull() & supply.isNull(), "no_data").when(need.isNull() | supply.isNull(), "not_assessable").when(need & supply, "both").when(need, "first_only").when(supply, "second_only").otherwise("neither")


def geometric_weights(matrix: Sequence[Sequence[float]]) -> list[float]:
    """Row geometric means of the judgements, normalised."""
    means = np.exp(np.log(np.asarray(matrix, float)).mean(axis=1))
    return (means / means.sum()).tolist()


def effective_dimensions(correlation: Sequence[Sequence[float]]) -> float:
    """Exponential of the entropy of the correlation matrix's eigenvalue shares."""
    values = np.clip(np.linalg.eigvalsh(np.asarray(correlation, float)), 0, None)
    share = values / values.sum()
    return float(np.exp(-(share[share > 0] * np.log(share[share > 0])).sum()))


def urgency(df: DataFrame, terms: Sequence[tuple[str, float]]) -> Column:
    """Interim priority: weighted sum of average-tie percent ranks in which a null takes the last place, as the most urgent."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    out = F.lit(0.0)
    for name, weight in terms:
        order = Window.partitionBy(F.lit(0)).orderBy(F.col(name).asc_nulls_last())
        ties = F.count("*").over(Window.partitionBy(name))
        out = out + F.lit(float(weight)) * (F.rank().over(order) + (ties - 1) / F.lit(2.0)) / n
    return out


def rank_correlations(df: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """(a, b, rho): Spearman's correlation of each pair of criteria over complete rows, by average-tie ranks."""
    ranked_ = df.na.drop(subset=list(criteria))
    for c in criteria:
        ties = F.count("*").over(Window.partitionBy(c))
        ranked_ = ranked_.withColumn(f"_r_{c}", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(c)) + (ties - 1) / F.lit(2.0))
    pairs = [(a, b) for i, a in enumerate(criteria) for b in criteria[i + 1 :]]
    one = ranked_.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}:{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}:{b}`").alias("rho")) for a, b in pairs]))
    return one.select(rows.alias("x")).select("x.*")


def ablated(criteria: Sequence[tuple[str, float]]) -> list[tuple[str, list[tuple[str, float]]]]:
    """Each criterion left out in turn, the others' weights scaled to the old sum."""
    total = sum(w for _, w in criteria)
    return [(name, [(n, w * total / (total - weight)) for n, w in criteria if n != name]) for name, weight in criteria]


def coverage(observed: Column, land: Column) -> Column:
    """Observed over land area, at most 1; null without land."""
    return F.least(F.lit(1.0), observed / F.nullif(land, F.lit(0.0)))
