"""Landscape metrics, levels of units, space-time hot spots, regression and the normal p against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalar
from skyloom.operators import inference, levels, patches, regression, spacetime


def flood(cells, corners):
    """Patches of a dict place -> label, as lists of places."""
    left, out = set(cells), []
    while left:
        todo, patch = [left.pop()], []
        while todo:
            r, c = todo.pop()
            patch.append((r, c))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    p = (r + a, c + b)
                    if p in left and (corners or a * b == 0) and cells[p] == cells[r, c]:
                        left.remove(p)
                        todo.append(p)
        out.append(patch)
    return out


def plain_landscape(cells, classes, corners, least):
    out = {}
    zones = {z for z, _ in cells.values() if z is not None}
    for zone in zones:
        inside = {p: c for p, (z, c) in cells.items() if z == zone}
        for k in classes:
            seen = {p for p, c in inside.items() if c is not None}
            own = {p: 1 for p in seen if inside[p] == k}
            found = [q for q in flood(own, corners) if len(q) >= least]
            kept = {p for q in found for p in q}
            sides = lambda p: [(p[0] + a, p[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            around = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
            edge = sum(q in seen and q not in kept for p in kept for q in sides(p))
            core = sum(all(q in kept for q in around(p)) for p in kept)
            shapes = [0.25 * sum(q not in kept for p in patch for q in sides(p)) / math.sqrt(len(patch)) for patch in found]
            out[zone, k] = (len(seen), len(kept), len(found), edge, core, max(map(len, found), default=0), sum(shapes) / len(shapes) if shapes else None, len(seen) / len(inside))
    return out


@pytest.mark.parametrize(("corners", "least"), [(True, 1), (False, 1), (True, 3)])
def test_landscape(spark, corners, least):
    rng = random.Random(4)
    cells = {(r, c): (None if rng.random() < 0.04 else r // 6 * 2 + c // 7, rng.choice([1, 1, 2, 3, None])) for r in range(12) for c in range(14)}
    cells |= {(20, c): (9, 3) for c in range(4)} | {(22, c): (10, None) for c in range(3)}
    df = spark.createDataFrame([(r, c, z, k) for (r, c), (z, k) in cells.items()], "row int, col int, z int, k int")
    got = {(r["zone"], r["class"]): r for r in patches.by_zone(df, "z", "k", [1, 2], 10.0, corners, least).collect()}
    want = plain_landscape(cells, [1, 2], corners, least)
    assert set(got) == set(want)
    for key, (seen, n, count, edge, core, most, shape, observed) in want.items():
        r = got[key]
        assert (r["landscape_ha"], r["class_ha"], r["core_ha"]) == pytest.approx((seen / 100, n / 100, core / 100)) and r["patches"] == count and r["edge_m"] == pytest.approx(10 * edge)
        assert r["mean_shape"] == (None if shape is None else pytest.approx(shape)) and r["observed_share"] == pytest.approx(observed) and r["below_floor"] == (observed < 0.5)
        assert r["largest_patch_index"] == (pytest.approx(100 * most / seen) if seen else None)


def test_compact_patches(spark):
    """A square has shape 1, index 100 and a core; a lone cell has index 0."""
    df = spark.createDataFrame([(r, c, 1, 1 if r < 4 and c < 4 or (r, c) == (8, 8) else 2) for r in range(9) for c in range(9)], "row int, col int, z int, k int")
    r = patches.by_zone(df.where("NOT (row = 8 AND col = 8)"), "z", "k", [1], 10.0).first()
    assert (r["mean_shape"], r["aggregation_index"], r["core_ha"]) == (1.0, 100.0, 0.04)
    assert patches.by_zone(df.where("row = 8"), "z", "k", [1], 10.0).first()["aggregation_index"] == 0.0


def test_levels(spark):
    rows = [("A", "a", 1.0, 2.0), ("A", "a", 3.0, None), ("A", "b", 5.0, 1.0), ("B", "c", None, 4.0), ("B", None, 9.0, 3.0), (None, None, 7.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, z string, v double, o double")
    names = {"zone": ["g", "z"], "group": ["g"], "all": []}
    got = {(r["statistic"], r["level"]): r for r in levels.comparison(df, names, "v", "o").collect()}
    assert got["mean", "zone"]["value"] == pytest.approx(3.5) and got["mean", "zone"]["n_units"] == 2 and got["mean", "group"]["value"] == pytest.approx(6.0) and got["mean", "all"]["value"] == pytest.approx(5.0)
    assert got["weighted_mean", "zone"]["value"] == pytest.approx(3.0) and got["sd", "group"]["value"] == pytest.approx(3.0)
    assert got["sd", "all"]["status"] == "not_estimable" and got["sd", "all"]["reason"] == "1 units of 2 needed" and got["correlation", "zone"]["value"] is None
    flat = levels.comparison(df.withColumn("v", F.lit(2.0)), names, "v", "o")
    assert {r["reason"] for r in flat.where("statistic = 'slope' AND level = 'group'").collect()} == {"2 units of 3 needed"}
    empty = levels.comparison(df.limit(0), names, "v", "o").collect()
    assert len(empty) == 18 and all(r["status"] == "not_estimable" for r in empty)


def test_normal_p(spark):
    z = [0.0, 1e-9, 0.3, -1.0, 1.96, 3.0, 3.5, 3.54, 5.0, 9.0, 30.0]
    got = spark.createDataFrame([(x,) for x in [*z, None, math.nan]], "z double").select(scalar.two_sided_p(F.col("z")).alias("p")).collect()
    assert [r["p"] for r in got[:-2]] == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=1e-12) and got[-1]["p"] is None and got[-2]["p"] is None


def test_cube(spark):
    """Gi* of a cube with gaps, against sums over all its cells; a zone that turns hot is told from the others."""
    rng = np.random.default_rng(3)
    near = {i: [j for j in (i - 1, i + 1) if 0 <= j < 20] for i in range(20)}
    cube = {(i, t): float(rng.normal(10, 1) + (2 * (t - 2000) if i in (9, 10, 11) else 0)) for i in range(20) for t in range(2000, 2010) if (i, t) != (5, 2003)}
    df = spark.createDataFrame([(i, t, v) for (i, t), v in cube.items()] + [(5, 2003, None)], "zone int, t int, v double")
    edges = spark.createDataFrame([(i, j) for i, n in near.items() for j in n], "i int, j int")
    v = np.array(list(cube.values()))
    for back in (0, 1, 2):
        got = {(r["zone"], r["t"]): (r["gi_z"], r["members"]) for r in spacetime.gi_cube(df, edges, "zone", "t", "v", back).collect()}
        assert set(got) == set(cube)
        for i, t in cube:
            members = [cube[j, u] for j in [i, *near[i]] for u in range(t - back, t + 1) if (j, u) in cube]
            w, n = len(members), len(v)
            assert got[i, t] == (pytest.approx((sum(members) - v.mean() * w) / (v.std() * math.sqrt((n * w - w * w) / (n - 1)))), w)
    got = {r["zone"]: r for r in spacetime.emerging_hot_spots(df, edges, "zone", "t", "v").collect()}
    assert got[10]["last_z"] > 1.96 and got[10]["p_adjusted"] < 0.05 and got[10]["s"] > 0 and got[10]["category"].endswith("hot_spot")
    assert not got[0]["category"].endswith("hot_spot") and not got[17]["category"].endswith("hot_spot")


def test_regression_against_the_dense_form(spark):
    rng = np.random.default_rng(6)
    side = 9
    near = {r * side + c: [a * side + b for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= a < side and 0 <= b < side] for r in range(side) for c in range(side)}
    n = side * side
    x = rng.normal(0, 1, (n, 2)) * (1, 1000)
    w = np.zeros((n, n))
    for i, own in near.items():
        w[i, own] = 1 / len(own)
    y = np.linalg.solve(np.eye(n) - 0.4 * w, 3 + x @ (1.0, 0.002) + rng.normal(0, 1, n))
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)] + [(900, None, 1.0, 1.0)], "k long, y double, a double, b double")
    edges = spark.createDataFrame([(i, j) for i, own in near.items() for j in own] + [(0, 900), (900, 0), (3, 3)], "i long, j long")
    got = regression.spatial_tests(df, edges, "k", "y", ["a", "b"]).first()
    full = np.column_stack([np.ones(n), x])
    want, fit = inference.lagrange(y, full, w), inference.ols(y, full)
    assert got["n"] == n and got["coefficients"] == pytest.approx(fit["b"].tolist()) and got["r2"] == pytest.approx(fit["r2"]) and got["residual_moran"] == pytest.approx(want["residual_moran"])
    for k in ("lag", "error", "robust_lag", "robust_error"):
        assert got[f"lm_{k}"] == pytest.approx(want[f"lm_{k}"], rel=1e-7) and got[f"p_{k}"] == pytest.approx(want[f"p_{k}"], rel=1e-6)
    with pytest.raises(ValueError, match="rank"):
        regression.spatial_tests(df.withColumn("b", 2 * F.col("a")), edges, "k", "y", ["a", "b"])
    lone = regression.spatial_tests(df, edges.limit(0), "k", "y", ["a", "b"]).first()
    assert lone["lm_error"] is None and lone["p_error"] is None
