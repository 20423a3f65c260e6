"""Least squares over zones and Lagrange-multiplier tests for spatial dependence, by aggregates and edge joins.

Nothing of n by n is formed: the tests need sums over zones and, for the weights, sums
over edges.  Only sums of predictors' products, a handful of numbers, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import scalar


def _total(terms: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def least_squares(zones: DataFrame, response: str, predictors: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(coefficients with the constant first, inverse of the predictors' products, n) over rows without nulls; refuses a rank-deficient design."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in predictors]]
    y, k = F.col(response).cast("double"), len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = zones.agg(F.count("*"), *[F.sum(x[i] * x[j]) for i, j in pairs], *[F.sum(v * y) for v in x]).first()
    n, products = sums[0], np.zeros((k, k))
    for (i, j), v in zip(pairs, sums[1:], strict=False):
        products[i, j] = products[j, i] = v or 0.0
    # Rank is judged with columns of one length, so that units do not decide.
    size = np.sqrt(np.maximum(np.diag(products), 1e-300))
    if n <= k or np.linalg.cond(products / np.outer(size, size)) > 1e12:
        raise ValueError("the design is rank-deficient")
    inverse = np.linalg.inv(products / np.outer(size, size)) / np.outer(size, size)
    return inverse @ np.array([v or 0.0 for v in sums[1 + len(pairs) :]]), inverse, n


def spatial_tests(zones: DataFrame, edges: DataFrame, key: str, response: str, predictors: Sequence[str]) -> DataFrame:
    """One row: n, coefficients, r2, sigma2, the residuals' Moran, and for ``lag``, ``error`` and both made robust to the other the statistic lm_* and its p_*.

    Weights are one over a zone's neighbours by ``edges`` (i, j); zones with a null in any
    variable take no part, nor do edges to them, and a zone without neighbours has a lag of
    0.  Without any edge, or where a test has no variance, its statistic and p are null.
    """
    names = [response, *predictors]
    rows = zones.select(F.col(key).alias("_i"), *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    beta, inverse, n = least_squares(rows, response, predictors)
    fitted = _total([F.lit(float(b)) * c for b, c in zip(beta, [F.lit(1.0), *map(F.col, predictors)], strict=True)])
    rows = rows.withColumn("_f", fitted).withColumn("_e", F.col(response) - F.col("_f"))
    known = rows.select(F.col("_i").alias("j"), F.col("_e").alias("_ej"), F.col(response).alias("_yj"), F.col("_f").alias("_fj"))
    pairs = edges.select("i", "j").where("i <> j").distinct().join(rows.select(F.col("_i").alias("i")), "i", "left_semi").join(known, "j")
    lags = pairs.groupBy("i").agg(F.avg("_ej").alias("_we"), F.avg("_yj").alias("_wy"), F.avg("_fj").alias("_wf"), F.count("*").alias("_k")).withColumnRenamed("i", "_i")
    # tr(W'W + WW): an edge adds 1/k^2, and 1/(k k') more where it goes both ways.
    degree = lags.select("_i", F.col("_k").cast("double").alias("_k"))
    back = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(1).alias("_back"))
    traces = pairs.select("i", "j").join(back, ["i", "j"], "left").join(degree.select(F.col("_i").alias("i"), F.col("_k").alias("_ki")), "i").join(degree.select(F.col("_i").alias("j"), F.col("_k").alias("_kj")), "j", "left")
    trace = traces.agg(F.sum(1 / (F.col("_ki") * F.col("_ki")) + F.when(F.col("_back") == 1, 1 / (F.col("_ki") * F.col("_kj"))).otherwise(0.0)).alias("t"), F.count_distinct("i").alias("s0"))
    rows = rows.join(lags, "_i", "left").na.fill(0.0, ["_we", "_wy", "_wf"])
    x = [F.lit(1.0), *map(F.col, predictors)]
    one = rows.agg(
        F.sum(F.col("_e") * F.col("_e")).alias("ee"), F.sum(F.col("_e") * F.col("_we")).alias("ewe"), F.sum(F.col("_e") * F.col("_wy")).alias("ewy"), F.sum(F.col("_wf") * F.col("_wf")).alias("ff"),
        (F.var_pop(response) * F.count("*")).alias("yy"), *[F.sum(v * F.col("_wf")).alias(f"_x{i}") for i, v in enumerate(x)])
    project = _total([F.lit(float(inverse[i, j])) * F.col(f"_x{i}") * F.col(f"_x{j}") for i in range(len(x)) for j in range(len(x))])
    s2 = F.col("ee") / n
    none = F.lit(0.0)
    out = one.withColumn("_k", F.lit(1)).join(trace.withColumn("_k", F.lit(1)), "_k").withColumns({"s2": s2, "d": (F.col("ff") - project) / s2, "a": F.col("ewy") / s2, "b": F.col("ewe") / s2})
    j = F.col("d") + F.col("t")
    tests = {
        "lag": F.col("a") * F.col("a") / F.nullif(j, none), "error": F.col("b") * F.col("b") / F.nullif(F.col("t"), none),
        "robust_lag": (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / F.when(F.col("d") > 1e-12 * j, F.col("d")),
        "robust_error": (F.col("b") - F.col("t") / j * F.col("a")) * (F.col("b") - F.col("t") / j * F.col("a")) / F.when(F.col("d") > 1e-12 * j, F.col("t") * F.col("d") / j),
    }
    out = out.withColumns({f"lm_{k}": v for k, v in tests.items()})
    p = [scalar.two_sided_p(F.sqrt(f"lm_{k}")).alias(f"p_{k}") for k in tests]
    return out.select(F.lit(n).cast("long").alias("n"), F.array(*[F.lit(float(b)) for b in beta]).alias("coefficients"), (1 - F.col("ee") / F.nullif(F.col("yy"), none)).alias("r2"), F.col("s2").alias("sigma2"), (F.col("ewe") / F.nullif(F.col("ee"), none) * n / F.nullif(F.col("s0").cast("double"), none)).alias("residual_moran"), *[f"lm_{k}" for k in tests], *p)
