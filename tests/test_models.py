"""Forests on sums by cell against pyspark.ml and brute force."""

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from skyloom.plans import models


def _few_values(spark, n=3000):
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(0, 50, n), rng.integers(0, 11, n), rng.integers(0, 9, n)
    y = 3.0 * a + np.where(b > 5, 20.0, 0.0) + rng.normal(0, 5, n)
    return spark.createDataFrame([(i, i // 60, float(p), float(q) / 100, float(r) / 100, float(s)) for i, (p, q, r, s) in enumerate(zip(a, b, c, y))], "k long, block long, a double, b double, c double, y double")


def test_tree_on_sums_is_the_tree_on_rows(spark):
    """Sums by cell give the tree that pyspark.ml grows from the rows."""
    df, names = _few_values(spark).where("a < 30"), ["a", "b", "c"]
    ends = models._ends(df, names)
    shape = [len(x) + 1 for x in ends]
    assert shape == [30, 11, 9]
    local = df.select("*", models._cell(names, ends).alias("cell")).toPandas()
    sums = [np.bincount(local["cell"], w, math.prod(shape)) for w in (np.ones(len(local)), local["y"])]
    mine = models._tree(*sums, shape, np.random.default_rng(0), 3)[local["cell"]]
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(df)
    theirs = DecisionTreeRegressor(featuresCol="x", labelCol="y", maxDepth=models.DEPTH).fit(rows).transform(rows).select("k", "prediction").toPandas().set_index("k")["prediction"]
    assert np.allclose(mine, theirs[local["k"]], rtol=1e-9) and len(set(mine)) > 20


def test_bootstrap_goes_by_the_row_number(spark):
    rows = np.arange(40_000) + (np.arange(40_000) % 3 << 33)
    drawn = models._bootstrap(rows, 10, 7)
    assert drawn.shape == (10, 40_000) and (models._bootstrap(rows[::-1], 10, 7)[:, ::-1] == drawn).all() and not (models._bootstrap(rows, 10, 8) == drawn).all()
    shares = np.bincount(drawn.ravel(), minlength=6)[:6] / drawn.size
    assert np.allclose(shares, [1 / math.e / math.factorial(k) for k in range(6)], atol=0.003)
    assert np.abs(np.corrcoef(drawn) - np.eye(10)).max() < 0.03


def _rows_are_not_fitted(monkeypatch):
    def no(*_, **__):
        raise AssertionError("a forest is fitted on all rows, level by level")

    monkeypatch.setattr(models, "RandomForestRegressor", no)


def test_split_strategies_fit_on_sums(spark, monkeypatch):
    """F1: all fits read the rows once; scores are those of pyspark.ml's forests but for their draws."""
    df, names = _few_values(spark), ["a", "b", "c"]
    ask = lambda: {r["method"]: r for r in models.split_strategies(df, names, "y", "block", ["k"], 0.3, 2, 20, 1).collect()}
    with monkeypatch.context() as m:
        m.setattr(models, "CELLS", 1)
        rows = ask()
    _rows_are_not_fitted(monkeypatch)
    sums = ask()
    for method in ("block", "row"):
        assert sums[method]["n_repeats"] == 2 and sums[method]["r2_least"] <= sums[method]["r2_mean"] <= sums[method]["r2_most"]
        assert abs(sums[method]["r2_mean"] - rows[method]["r2_mean"]) < 0.1 and sums[method]["r2_mean"] > 0.7
    assert all(abs(r["r2_mean"] - sums[method]["r2_mean"]) < 1e-9 for method, r in ask().items())


def test_permutation_importance_deals_in_place(spark, monkeypatch):
    """every bin is dealt to exactly one row, without a shuffle of the rows; losses are those of the join's dealing but for its draws."""
    df, names = _few_values(spark), ["a", "b", "c"]
    ask = lambda: {r["predictor"]: r for r in models.permutation_importance(df, names, "y", ["k"], 20, 3, 1).collect()}
    monkeypatch.setattr(models, "FIT_ROWS", 500)
    with monkeypatch.context() as m:
        m.setattr(models, "CELLS", 1)
        rows = ask()
    _rows_are_not_fitted(monkeypatch)
    sums = ask()
    assert [sums[c]["rank"] for c in names] == [rows[c]["rank"] for c in names]
    assert all(abs(sums[c]["importance"] - rows[c]["importance"]) < 0.05 + 0.1 * rows[c]["importance"] for c in names) and sums["a"]["sd"] > 0


def test_losses_are_those_of_the_dealt_bins():
    rng, shape, sizes, per = np.random.default_rng(3), [5, 4, 3], [700, 0, 900, 400], 500
    n = sum(sizes)
    cell, y, model = rng.integers(0, 60, n).astype(np.int32), rng.normal(0, 1, n), rng.normal(0, 1, 60)
    bins = np.array(np.unravel_index(cell, shape))
    mixes = [[rng.multinomial(np.bincount(b, minlength=k), [per / n] * (n // per)) for b, k in zip(bins, shape)] for _ in range(2)]
    row = np.concatenate([(part << 33) + np.arange(m) for part, m in enumerate(sizes)])
    run = models._losses(shape, model, mixes, np.cumsum(sizes) - sizes, 9, "y")
    got = {}
    for some in np.array_split(rng.permutation(n), 3):
        batches = [pa.RecordBatch.from_pydict({"_row": row[x], "_cell": cell[x], "y": y[x]}) for x in np.array_split(some, 4)]
        for r in pa.Table.from_batches(run(iter(batches))).to_pylist():
            got[r["turn"], r["feature"]] = got.get((r["turn"], r["feature"]), 0.0) + r["loss"]
    assert np.isclose(got[-1, 0], ((y - model[cell]) ** 2).sum())
    for turn in range(2):
        for i in range(3):
            new = np.concatenate([models._anew(mixes, 9, turn, i, b) for b in range(n // per)])
            assert (np.sort(new) == np.sort(bins[i])).all() and (new != bins[i]).any()
            dealt = np.ravel_multi_index([*bins[:i], new, *bins[i + 1 :]], shape)
            assert np.isclose(got[turn, i], ((y - model[dealt]) ** 2).sum())


def test_forest_cv_fits_on_sums(spark, monkeypatch):
    """all folds read the rows once; scores are those of pyspark.ml's forests but for their draws, missing values and constants included."""
    df, names = _few_values(spark), ["a", "b", "c"]
    df = df.withColumn("a", F.when(F.col("k") != 7, F.col("a")))
    ask = lambda df: {r["fold"]: r for r in models.forest_cv(df, names, "y", "block", 3, 20, 1).collect()}
    with monkeypatch.context() as m:
        m.setattr(models, "CELLS", 1)
        rows = ask(df)
    _rows_are_not_fitted(monkeypatch)
    sums = ask(df)
    assert sorted(sums) == [1, 2, 3] and sum(r["n"] for r in sums.values()) == 2999
    assert all(abs(r["r2"] - sums[fold]["r2"]) < 1e-9 for fold, r in ask(df.repartition(7)).items())
    assert all(sums[i]["n"] == rows[i]["n"] and abs(sums[i]["r2"] - rows[i]["r2"]) < 0.1 for i in sums)
    flat = ask(df.withColumn("y", F.lit(0.1)))
    assert all(r["r2"] is None and r["rmse"] < 1e-12 for r in flat.values())
