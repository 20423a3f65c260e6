"""Spatial joins and weights, significance of zones, zone tables, land-change tests, products, rules and colours."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import colour, rules, settings
from skyloom.operators import guards, masks, prediction, ranking, significance, spatial, windows, zones
from skyloom.plans import models
from skyloom.sources import products, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def grid(spark, text):
    return spark.createDataFrame([(r, c, int(v)) for r, line in enumerate(text.split()) for c, v in enumerate(line)], "row long, col long, code int")


# --- spatial ------------------------------------------------------------------

def test_points_in_concave_polygons(spark):
    u = [(0, 0), (0, 9), (3, 9), (3, 3), (6, 3), (6, 9), (9, 9), (9, 0)]
    polygons = spark.createDataFrame([("u", [(float(x), float(y)) for x, y in u]), ("none", None)], "name string, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.5, 5.5), (2, 4.5, 5.5), (3, 7.5, 5.5), (4, 4.5, 1.5), (5, -1.0, 1.0), (6, None, 1.0)], "k int, x double, y double")
    assert rows(spatial.points_in_polygons(points, polygons, "x", "y", "ring", 2.0).select("k", "name"), "k") == [(1, "u"), (3, "u"), (4, "u")]
    assert polygons.select(spatial.planar_area(F.col("ring"))).first()[0] == 63


def test_rook_and_queen_of_a_lattice(spark):
    boxes = spark.createDataFrame([(4 * r + c, float(c), float(r), c + 1.0, r + 1.0) for r in range(4) for c in range(4)], "k int, x0 double, y0 double, x1 double, y1 double")
    rook, queen = spatial.touching(boxes, "k", 1.5, rook=True), spatial.touching(boxes, "k", 1.5)
    count = lambda e: sorted(r[1] for r in e.groupBy("i").count().collect())
    assert count(rook) == [2] * 4 + [3] * 8 + [4] * 4 and count(queen) == [3] * 4 + [5] * 8 + [8] * 4
    assert rows(spatial.weights_report(boxes, "k", rook)) == [(16, 0, 2, 3.0, 4, pytest.approx(100 * 48 / 256), True)]


def test_island_policies(spark):
    keys = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 9.0, 0.0)], "k int, x double, y double")
    edges = spark.createDataFrame([(1, 2), (2, 1)], "i int, j int")
    near = spark.createDataFrame([(3, 2, 1), (1, 2, 1), (2, 1, 1)], "i int, j int, rank int")
    assert rows(spatial.weights(keys, "k", edges, near), "i", "j") == [(1, 2, 1.0), (2, 1, 0.5), (2, 3, 0.5), (3, 2, 1.0)]
    assert rows(spatial.weights(keys, "k", edges, policy="keep", transform="b"), "i") == [(1, 2, 1.0), (2, 1, 1.0)]
    with pytest.raises(ValueError, match="without a neighbour"):
        spatial.weights(keys, "k", edges, policy="error")
    assert rows(spatial.islands(keys, "k", edges)) == [(3,)]


def test_ocean_is_a_large_water(spark):
    cells = grid(spark, "1110000000 1110000000 1110000010 0000000000")
    got = {(r, c): d for r, c, d in rows(spatial.ocean_distance(cells, "code", 1, 4, 2.0))}
    assert got[0, 0] == 0 and got[2, 8] == pytest.approx(2 * 6) and got[3, 9] == pytest.approx(2 * math.sqrt(1 + 49)) and len(got) == 40
    assert spatial.ocean_distance(cells, "code", 1, 400, 2.0).count() == 0


def test_nearest_target_is_exact(spark):
    rng = np.random.default_rng(0)
    at = [tuple(map(int, x)) for x in rng.integers(0, 60, (150, 2))]
    targets = [tuple(map(int, x)) for x in rng.integers(0, 60, (4, 2))]
    got = {(r, c): d for r, c, d in rows(spatial.nearest_target(spark.createDataFrame(sorted(set(at)), "row long, col long"), spark.createDataFrame(targets, "row long, col long")))}
    assert got == {p: pytest.approx(min(math.dist(p, t) for t in targets)) for p in set(at)}


def test_zones_beside_wetland(spark):
    z = spark.createDataFrame([(i,) for i in range(4)], "k int")
    d = spark.createDataFrame([(i, j, 100.0 * abs(i - j)) for i in range(4) for j in range(4) if i != j], "i int, j int, distance double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2)], "i int, j int")
    got = rows(spatial.adjacent_zones(z, "k", F.col("k") == 0, d, edges, [150, 250]), "i")
    assert got == [(0, True, False, False, False), (1, False, True, True, True), (2, False, False, True, False), (3, False, False, False, False)]


# --- significance ------------------------------------------------------------------

def _clustered(spark, side=6):
    near = lambda r, c: [a * side + b for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= a < side and 0 <= b < side]
    data = [("t", r * side + c, 100.0 if r < 2 and c < 3 else 1.0 + (r * 7 + c * 3) % 5 / 10, near(r, c)) for r in range(side) for c in range(side)]
    return spark.createDataFrame(data, "bin string, k long, v double, near array<long>")


def test_clusters_are_found_and_reproducible(spark):
    df = _clustered(spark)
    got = {r["k"]: r for r in significance.gi_star(df, ["bin"], "k", "v", "near", 199).collect()}
    assert got[1]["confidence"].startswith("hot_") and got[1]["gi_z"] > 2 and got[35]["confidence"] == "not_significant" and all(r["p_adjusted"] >= r["p_sim"] - 1e-12 for r in got.values())
    local = {r["k"]: r for r in significance.local_moran(df, ["bin"], "k", "v", "near", 999).collect()}
    assert local[1]["cluster"] == "high_high" and local[1]["quadrant"] == 1 and local[35]["quadrant"] == 3
    again = {r["k"]: r["p_sim"] for r in significance.gi_star(df.repartition(3), ["bin"], "k", "v", "near", 199).collect()}
    assert again == {k: r["p_sim"] for k, r in got.items()}
    with pytest.raises(Exception, match="negative"):
        significance.gi_star(df.withColumn("v", -F.col("v")), ["bin"], "k", "v", "near", 9).collect()


def test_panel_drops_bins_with_gaps(spark):
    df = spark.createDataFrame([(b, k, None if (b, k) == (2, 1) else float(k * b)) for b in (1, 2, 3) for k in range(4)], "bin int, zone long, v double")
    near = spark.createDataFrame([(k, [(k + 1) % 4, (k + 3) % 4]) for k in range(4)], "zone long, near array<long>")
    assert sorted({r["bin"] for r in significance.gi_star_panel(df, "zone", "bin", "v", near, 9).collect()}) == [1, 3]


def test_trends_adjusted_across_zones(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "zone string, p double")
    got = {r["zone"]: (r["p_adjusted"], r["significant"]) for r in significance.trend_table(df, "zone", "p").collect()}
    assert got == {"a": (pytest.approx(0.03), True), "b": (pytest.approx(0.04), True), "c": (pytest.approx(0.04), True), "d": (None, False)}


def test_bins_start_at_the_first_year(spark):
    df = spark.createDataFrame([("a", 2001, 1.0), ("a", 2002, 3.0), ("a", 2003, 5.0), ("a", None, 7.0)], "z string, y int, v double")
    assert rows(significance.bins(df, "z", "y", "v", 2), "bin") == [("a", 2001, 2.0), ("a", 2003, 5.0)]
    with pytest.raises(ValueError, match="twice"):
        significance.bins(df.union(df), "z", "y", "v", 1)


# --- zone tables -------------------------------------------------------------------

def test_left_columns_win_and_incomplete_zones_go(spark):
    a = spark.createDataFrame([("x", 1.0, 10.0), ("y", 2.0, None)], "z string, v double, u double")
    b = spark.createDataFrame([("x", 9.0, 3.0), ("w", 9.0, 5.0)], "z string, v double, t double")
    assert rows(zones.merged([a, b], "z"), "z") == [("w", None, None, 5.0), ("x", 1.0, 10.0, 3.0), ("y", 2.0, None, None)]
    assert rows(zones.model_frame([a, b], "z", "v", ["u", "t"])) == [("x", 1.0, 0.0, 0.0)]
    with pytest.raises(ValueError, match="no \\['q'\\]"):
        zones.model_frame([a, b], "z", "v", ["q"])


def test_criteria_are_gated_and_status_is_told(spark):
    df = spark.createDataFrame([("a", 1.0, 50, 5.0), ("b", 2.0, 1, 4.0), ("c", None, 50, None), ("d", 4.0, 50, 3.0)], "z string, v double, n int, u double")
    got = {r["z"]: r for r in zones.prepared(df, [("v", "n", 3.0, True), ("u", None, 1.0, False)], 10, 0.5).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "scored", "b": "insufficient", "c": "insufficient", "d": "scored"}
    assert got["b"]["v"] is None and got["a"]["v_norm"] == 0.5 and got["d"]["v_norm"] == 1.0 and got["d"]["u_norm"] == 1.0 and got["b"]["missing_weight"] == 0.75


def test_cut_shift_and_agreement(spark):
    a = spark.createDataFrame([(k, float(10 - k)) for k in range(6)] + [(6, None)], "z int, s double")
    ranked = ranking.ranked(a, "s", "z", 2)
    assert rows(zones.at_the_cut(ranked, "s")) == [(2, 6, 1.0, 0)]
    tied = ranking.ranked(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 1.0)], "z int, s double"), "s", "z", 2)
    assert rows(zones.at_the_cut(tied, "s")) == [(2, 4, 0.0, 1)]
    left = spark.createDataFrame([(k, k) for k in range(1, 6)], "z int, r int")
    right = spark.createDataFrame([(1, 1), (2, 5), (3, 3), (4, 4), (5, 2)], "z int, r int")
    assert rows(zones.shifts(left, right, "z", "r", "r", 2)) == [(2, 2, 5, 3, 3), (5, 5, 2, -3, 3)]
    n, rho, tau, common, jaccard = rows(zones.agreement_of(left, right, "z", "r", "r", 2))[0]
    assert (n, common, jaccard) == (5, 1, pytest.approx(1 / 3)) and rho == pytest.approx(1 - 6 * 18 / 120) and tau == pytest.approx(0.0)


def test_top_zones_leave_out_by_status(spark):
    df = spark.createDataFrame([("a", 1, 0.9, "scored"), ("b", 2, 0.8, "insufficient"), ("c", 3, 0.7, None), ("d", 4, None, "scored")], "z string, rank int, s double, status string")
    pick = lambda **x: [r["z"] for r in zones.top_zones(df, "rank", "s", 3, "status", ["insufficient"], **x).collect()]
    assert pick() == ["a", "c"] and pick(flagged=True) == ["a", "b", "c"]


def test_missing_sides_of_rankings(spark):
    """What whole tables do not have: zones without one side, or without a criterion."""
    df = spark.createDataFrame([("a", True, None), ("b", None, None), ("c", False, True), ("d", True, True)], "z string, need boolean, supply boolean")
    assert dict(rows(df.select("z", ranking.verdict(F.col("need"), F.col("supply"))))) == {"a": "not_assessable", "b": "no_data", "c": "second_only", "d": "both"}
    x = spark.createDataFrame([("a", 0.2, None), ("b", 0.4, 0.8), ("c", None, 0.6)], "z string, a double, c double")
    got = dict(rows(x.select("z", ranking.overlay([(F.col("a"), 0.6), (F.col("c"), 0.4)]))))
    assert got == {"a": pytest.approx(0.2), "b": pytest.approx(0.56), "c": None}
    urgent = dict(rows(x.select("z", ranking.urgency(x, [("c", 1.0)]))))
    assert urgent["a"] == 1.0 and urgent["c"] == pytest.approx(1 / 3)


def test_whole_table_totals(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    plan = windows.with_totals(df, {"m": F.avg("v")})
    assert rows(plan, "k") == [(1, 2.0, 3.0), (2, 4.0, 3.0)] and "Window" not in plan._jdf.queryExecution().executedPlan().toString()


# --- land change -------------------------------------------------------------------

def test_no_change_map_scores_its_own_kappa(spark):
    cells = spark.createDataFrame([(0, i, b, t, g) for i, (b, t, g) in enumerate([(1, 1, 1), (1, 1, 1), (1, 2, 2), (2, 2, 2), (2, 2, 1), (2, 1, 1)])], "row int, col int, b int, t int, g int")
    kappa, null, above, *_ , merit = rows(prediction.validated(cells, "b", "t", "g"))[0]
    assert null == pytest.approx((4 / 6 - 0.5) / 0.5) and kappa == pytest.approx((5 / 6 - 0.5) / 0.5) and above == pytest.approx(kappa - null) and merit == pytest.approx(2 / 3)


def test_masks_and_profiles(spark):
    cells = spark.createDataFrame([(0, 0, 1, 0.0), (0, 1, 2, 10.0), (0, 2, 3, 20.0), (0, 3, None, 30.0)], "row int, col int, code int, x double")
    assert rows(prediction.mask_report(cells, ["code"], [3])) == [(4, 3, 1, 0.25)]
    profile = spark.createDataFrame([(1, 100.0), (2, 50.0)], "code int, x double")
    assert [r[3] for r in rows(prediction.painted(cells, "code", profile, ["x"]).select("row", "col", "code", "x"), "col")] == [100.0, 50.0, None, None]
    moved = prediction.shifted(cells, "code", F.col("code") != 3, profile, 1, 0.5, ["x"])
    assert [r[3] for r in rows(moved, "col")] == [50.0, 55.0, 20.0, 30.0]
    with pytest.raises(ValueError, match="between 0 and 1"):
        prediction.shifted(cells, "code", F.lit(True), profile, 1, 1.5, ["x"])


def test_projected_map_meets_its_demand(spark):
    rng = np.random.default_rng(3)
    before = rng.integers(0, 2, (12, 12))
    after = np.where((rng.random((12, 12)) < 0.2) & (before == 0), 1, before)
    cells = spark.createDataFrame([(r, c, int(before[r, c]), int(after[r, c])) for r in range(12) for c in range(12)], "row long, col long, a int, b int")
    got = dict(rows(prediction.projected(cells, "a", "b", [0, 1], 1).groupBy("code").count()))
    stay = (after[before == 0] == 0).mean()
    assert got[0] == math.floor((after == 0).sum() * stay + 1e-9) and got[0] + got[1] == 144


def test_projection_steps():
    assert prediction.projection_steps(2018, 2021, [2024, 2030, 2025], 2) == [(2024, 1, 2024), (2030, 3, 2030), (2025, 1, 2024)]
    with pytest.raises(ValueError, match="nearest step"):
        prediction.projection_steps(2010, 2020, [2024], 2)
    with pytest.raises(ValueError, match="not after"):
        prediction.projection_steps(2018, 2021, [2021], 2)


def test_modal_grid_needs_coverage(spark):
    cells = grid(spark, "1122 1222").withColumn("code", F.when(~((F.col("row") == 1) & (F.col("col") >= 2)), F.col("code")))
    assert rows(prediction.modal_grid(cells, "code", 2, 0.75), "col") == [(0, 0, 1, 1.0), (0, 1, None, 0.5)]


def test_forest_helpers(spark):
    rng = np.random.default_rng(5)
    data = [(i, i // 20, float(a), float(b), 5.0 * float(a)) for i, (a, b) in enumerate(rng.random((400, 2)))]
    df = spark.createDataFrame(data, "k long, block long, a double, b double, y double")
    imp = models.permutation_importance(df, ["a", "b"], "y", ["k"], 5, 1, 1).collect()
    assert imp[0]["predictor"] == "a" and imp[0]["rank"] == 1 and imp[0]["importance"] > 0.5 > abs(imp[1]["importance"])
    model, assembler = models.forest(df, ["a", "b"], "y", 5, 1)
    gap = models.predicted(model, assembler, spark.createDataFrame([(0.5, 0.5), (None, 0.5)], "a double, b double"), ["a", "b"])
    assert [r["prediction"] is None for r in gap.collect()] == [False, True] and gap.columns == ["a", "b", "prediction"]
    split = {r["method"]: r for r in models.split_strategies(df, ["a", "b"], "y", "block", ["k"], 0.3, 1, 5, 1).collect()}
    assert set(split) == {"block", "row"} and all(r["r2_mean"] > 0.9 for r in split.values())


def test_forest_plans_read_narrow_equal_parts(spark, monkeypatch):
    """Forests are fitted on a stored table of the needed columns in many parts, not on one task's wide rows."""
    stored, real = [], models.graph.written
    monkeypatch.setattr(models.graph, "written", lambda df: (stored.append((set(df.columns), df.rdd.getNumPartitions())), real(df))[1])
    monkeypatch.setattr(models, "FIT_ROWS", 100)
    df = spark.range(600).coalesce(1).select(F.col("id").alias("k"), F.floor(F.col("id") / 20).alias("block"), F.rand(3).alias("a"), F.rand(4).alias("b"), F.lit("a long remark").alias("remark")).withColumn("y", 5 * F.col("a"))
    scores = models.forest_cv(df, ["a", "b"], "y", "block", 3, 5, 1).collect()
    assert sorted(r["fold"] for r in scores) == [1, 2, 3] and sum(r["n"] for r in scores) == 600 and all(r["r2"] > 0.8 for r in scores)
    models.split_strategies(df, ["a", "b"], "y", "block", ["k"], 0.3, 1, 5, 1).collect()
    imp = models.permutation_importance(df, ["a", "b"], "y", ["k"], 5, 2, 1).collect()
    assert imp[0]["predictor"] == "a" and imp[0]["importance"] > 0.5 > abs(imp[1]["importance"])
    assert len(stored) == 3 and all("remark" not in c for c, _ in stored) and stored[2][1] == 6


# --- products ------------------------------------------------------------------------

@pytest.mark.parametrize("kind", products.FORMATS)
def test_products_come_back(spark, tmp_path, kind):
    ring = "array<struct<x: double, y: double>>"
    df = spark.createDataFrame([("a", 1.5, None, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]), ("b", None, "x, \"y\"\n", [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])], f"zone string, v double, note string, ring {ring}")
    path = products.write_product(df, str(tmp_path), rules.product_name("Priority table", "Zone A", 2000, 2020, 30), kind, ["zone", "v", "note"], ["zone"], products.ring_geometry(F.col("ring")), {"source": "test"})
    assert path.endswith("priority_table_zone_a_2000_2020_30m")
    assert products.read_notes(spark, path) == {"columns": ["zone", "v", "note"], "format": kind, "rows": 2, "source": "test"}
    back = products.read_product(spark, path, "zone string, v double, note string")
    if kind == "geojson":
        got = {r["id"]: (r["properties"], json.loads(r["geometry"])) for r in back.collect()}
        assert got["a"][0]["v"] == "1.5" and got["a"][0]["note"] is None and got["a"][1]["coordinates"] == [[[0, 0], [1, 0], [0, 1], [0, 0]]] and len(got["b"][1]["coordinates"][0]) == 3
    else:
        assert rows(back, "zone") == [("a", 1.5, None), ("b", None, "x, \"y\"\n")]
    with pytest.raises(Exception, match="(?i)exist"):
        products.write_product(df, str(tmp_path), path.rsplit("/", 1)[1], kind, ["zone"], ["zone"])


def test_csv_products_come_back_whole(spark, tmp_path):
    """Line ends, quotes, separators, blanks at the ends, empty strings, nulls and strings that look like the mark of nulls."""
    texts = ["plain", "", None, "two\nlines", "a \"quoted\" word", "x, y;z", "  blanks  ", r"\N", r"\\N", "\\", "ends with \\", "\"", "\n", "é 😀"]
    df = spark.createDataFrame([(i, t, None if i % 3 else float(i)) for i, t in enumerate(texts)], "k long, note string, v double")
    path = products.write_product(df.repartition(3), str(tmp_path), "notes", "csv", ["k", "note", "v"], ["k"])
    assert products.read_notes(spark, path)["rows"] == len(texts)
    back = products.read_product(spark, path, "k long, note string, v double")
    assert rows(back, "k") == [(i, t, None if i % 3 else float(i)) for i, t in enumerate(texts)]


def test_products_are_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("a", 1.0)], "zone string, v double")
    for match, args, more in (("no \\['w'\\]", (["zone", "w"], ["zone"]), {}), ("not unique", (["zone"], ["zone"]), {})):
        with pytest.raises(ValueError, match=match):
            products.write_product(df, str(tmp_path), "x", "csv", *args, **more)
    with pytest.raises(ValueError, match="nulls"):
        products.write_product(df.limit(1), str(tmp_path), "x", "csv", ["v"], ["zone"], complete=True)
    with pytest.raises(ValueError, match="known are"):
        products.write_product(df, str(tmp_path), "x", "shp", ["zone"], ["zone"])
    assert list(tmp_path.iterdir()) == []
    known = tables.aliased(df, {"id": ["pcode", "ZONE"], "value": ["v"]})
    assert known.columns == ["id", "value"]


def test_provenance(spark):
    got = products.provenance({"land_cover": {"bands": ["a", "b"], "scale": 10.0, "start": "2015", "end": None}, "heights": {}}, {"land_cover": ["x.py"]}, spark)
    assert rows(got) == [("heights", "Heights", "", None, None, 0, None), ("land_cover", "Land Cover", "a, b", "10", "2015 to ongoing", 1, None)]


# --- rules and colours ---------------------------------------------------------------

def test_rules(spark):
    assert rules.bit_mask([0, 3, 3]) == 9 and rules.bit_range([2, 3, 4]) == (2, 7)
    with pytest.raises(ValueError, match="adjacent"):
        rules.bit_range([2, 4])
    with pytest.raises(ValueError, match="no labels"):
        rules.label_map({0: "good"}, 1)
    with pytest.raises(ValueError, match="longer"):
        rules.product_name("p" * 90, "a", 2000, 2001, 30)
    assert rules.band_names("lst", "percentile", 90) == ("lst_p90", "lst_count") and rules.band_names("lst", "median") == ("lst_median", "lst_count")
    s, tau = rules.detection_threshold(10)
    assert s == pytest.approx(1.959963984540054 * math.sqrt(125) + 1) and tau == pytest.approx(s / 45)
    p, threshold, can = rules.power_floor(10, 1000)
    assert p == pytest.approx(math.erfc(44 / math.sqrt(125) / math.sqrt(2))) and threshold == 5e-5 and not can is True
    assert rules.normal_cdf(0) == 0.5 and rules.plain(0.00001) == "0.00001" and rules.plain(30.0) == "30" and rules.signed(-0.5) == "- 0.5"
    assert rules.value_paths({"a": {"b": "x", "c": ["y", "x"]}, "d": "x"}, "x") == ["a.b", "a.c[1]", "d"]
    df = spark.createDataFrame([(0.2, 5.0), (1.0, 2.0), (0.0, 4.0)], "tau double, n double")
    assert rows(df.select(rules.s_from_tau(F.col("tau"), F.col("n")), rules.z_from_tau(F.col("tau"), F.col("n")))) == [(2.0, pytest.approx(1 / math.sqrt(50 / 3))), (None, None), (0.0, 0.0)]
    assert [r[0] for r in df.select(zones.validity(F.col("tau"), F.when(F.col("n") > 3, F.col("n")), F.col("n"), 5)).collect()] == [True, False, False]
    assert zones.equal_split({"a": ["x", "y"], "b": ["z"]}) == {"x": 0.25, "y": 0.25, "z": 0.5}


def test_colours():
    assert colour.lightness("#fff") == pytest.approx(100) and colour.lightness("#000000") == pytest.approx(0)
    assert colour.lab("#ff0000") == pytest.approx((53.24, 80.09, 67.20), abs=0.05)
    assert colour.difference("#123456", "#123456") == 0 and colour.difference("#000", "#fff") == pytest.approx(100)
    assert all(colour.seen_as("#808080", v) in ("#808080", "#7f7f7f", "#818181") for v in colour.VISION)
    assert colour.difference(colour.seen_as("#ff0000", "deutan"), colour.seen_as("#8a8a00", "deutan")) < colour.difference("#ff0000", "#8a8a00")
    assert colour.is_monotonic([1, 2, 3]) and not colour.is_monotonic([1, 3, 2]) and colour.is_diverging([1, 3, 2]) and colour.is_diverging([1, 3, 3.5, 2]) and not colour.is_diverging([1, 2, 3])
    assert colour.failures(["#d62728", "#2ca02c"], 60) and colour.failures(["#000000", "#ffffff"], 60) == []
    with pytest.raises(ValueError, match="no colour"):
        colour.channels("#12345")


# --- masks, settings, guards ---------------------------------------------------------

def test_masks(spark):
    df = spark.createDataFrame([(0.5, 0.0, None), (None, 0.6, None), (None, None, 90.0), (None, None, None), (0.1, 0.1, 10.0)], "i double, f double, o double")
    assert [r[0] for r in df.select(masks.water(F.col("i"), F.col("f"), F.col("o"), (0.2, 0.5, 80))).collect()] == [True, True, True, False, False]
    months = spark.range(1, 13).select("id", masks.months_between(F.col("id"), 11, 2).alias("m"))
    assert [r["id"] for r in months.where("m").collect()] == [1, 2, 11, 12]
    for bad in (([], [11]), ([11], [12]), ([1], [10])):
        with pytest.raises(ValueError, match="classes"):
            masks.checked_classes(*bad)
    with pytest.raises(ValueError, match="ring"):
        masks.checked_ring(5, 5)
    side = spark.createDataFrame([(True, 0.0, 2, False, 5.0), (False, 3.0, 12, False, 5.0), (False, 3.0, 12, False, 500.0), (False, 3.0, 12, True, 5.0), (False, 9.0, None, None, None)], "z boolean, d double, c int, w boolean, h double")
    cols = lambda method: masks.contrast_sides(method, F.col("z"), F.col("d"), F.col("c"), F.col("w"), F.col("h"), (1, 5), [2], [12], 100)
    assert rows(side.select(*cols("ring"))) == [(True, False), (False, True), (False, False), (False, False), (False, False)]
    assert rows(side.select(*cols("climate"))) == [(True, False), (False, True), (False, False), (False, False), (False, False)]


def test_settings():
    config = {"trends": {"alpha": 0.05, "years": 10, "decades": {"b": [2010, 2019], "a": [2000, 2009]}}, "rf": {"trees": 500, "predictors": ["x", "y", "x"]}}
    assert settings.setting(config, "trends.alpha", kind=float, above=0, below=1) == 0.05 and settings.setting(config, "trends.years", 12, least=3) == 12
    assert settings.names(config, "rf.predictors") == ["x", "y"] and settings.spans(config, "trends.decades") == [("a", 2000, 2009), ("b", 2010, 2019)]
    assert settings.overridden(config, "rf", trees=10)["trees"] == 10 and settings.increasing([0, 1], ["a", "b", "c"]) == [0.0, 1.0]
    assert [c["name"] for c in settings.criteria([{"name": "a", "direction": "cost"}, {"name": "b", "direction": "benefit"}], ["b"])] == ["b"]
    for call in (
        lambda: settings.setting(config, "trends.alpha", 1.0, below=1), lambda: settings.setting(config, "trends.years", 2, least=3), lambda: settings.names(config, "rf.predictors", []), lambda: settings.names(config, "rf.predictors", response="x"),
        lambda: settings.increasing([1, 1]), lambda: settings.increasing([1], ["a"]), lambda: settings.spans(config, "x", {"a": [2, 1]}), lambda: settings.split_method(config, "x", "random"), lambda: settings.overridden(config, "rf", leaves=1), lambda: settings.criteria([{"name": "a", "direction": "up"}]),
    ):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError, match="trends.beta"):
        settings.at(config, "trends.beta")


def test_guards(spark):
    df = spark.createDataFrame([("a", 2000, 0.5), ("a", 2001, 0.7), ("b", 2000, 0.1), ("b", 2001, 0.2)], "k string, y int, p double")
    assert guards.enough_blocks(df, "k", 2) == {"rows": 4, "blocks": 2, "median": 2.0} and guards.within_ranges(df, {"p": (0, 1)}) == {"p": (0.1, 0.7)}
    assert guards.annual_series(df, ["k"], "y", 2000, 2001) is df and guards.consistent(0.05) == 0.05 and guards.refinement([20, 10], [4, 2], 5) == 5
    assert guards.expected_area(1100, 1000, 1000) == pytest.approx(0.1) and guards.scored_share(df.withColumn("s", F.lit("scored")), "s", "insufficient", 0.5) == 1.0
    for call in (
        lambda: guards.enough_blocks(df, "k", 3), lambda: guards.within_ranges(df, {"p": (0, 0.6)}), lambda: guards.annual_series(df.where("p < 0.7"), ["k"], "y", 2000, 2001), lambda: guards.annual_series(df.union(df), ["k"], "y", 2000, 2001), lambda: guards.consistent(float("nan")),
        lambda: guards.refinement([21, 10], [4, 2], 5), lambda: guards.expected_area(2000, 1000, 1000), lambda: guards.scored_share(df.limit(0).withColumn("s", F.lit("x")), "s", "y", 0.0),
    ):
        with pytest.raises(ValueError):
            call()
