"""Rules that are easily got wrong, on small tables made here."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.functions import scalar
from skyloom.operators import aggregates, agreement, graph, grids, guards, ranking, trends, windows
from skyloom.sources import tables
from skyloom.streaming import windows as event_windows


def one(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bucket_is_left_closed_and_null_is_minus_one(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,), (0.02,), (None,)], "x double").select("x", scalar.bucket(F.col("x"), (0.0, 0.005, 0.010, 0.015, 0.020)).alias("b"))
    assert dict(map(tuple, df.collect())) == {0.0: 1, -0.1: 0, 0.02: 5, None: -1}


def test_mask_keeps_the_row(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0)], "q int, s int, v double")
    assert [r[0] for r in df.select(scalar.masked(F.col("v"), scalar.is_clear(F.col("q"), 5, F.col("s")))).collect()] == [1.0, None, None]


def test_empty_year_stays(spark):
    df = spark.createDataFrame([(1, 2000, 5.0)], "z int, y int, v double")
    spine = spark.createDataFrame([(1, 2000), (1, 2001)], "z int, y int")
    got = one(aggregates.composite(df, ["z", "y"], "v", spine).select("y", "median", "n_obs"), "y")
    assert got == [(2000, 5.0, 1), (2001, None, 0)]


def test_percent_rank_averages_ties_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", None)], "k string, v double")
    got = dict(map(tuple, df.select("k", windows.percent_rank(F.col("v"), [])).collect()))
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0, "d": None}


def test_constant_column(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "k int, v double")
    got = one(df.select("k", windows.min_max(F.col("v"), []), windows.z_score(F.col("v"), []), windows.z_score(F.col("v"), [], 0.0)), "k")
    assert got == [(1, 0.5, None, 0.0), (2, 0.5, None, 0.0), (3, None, None, None)]


def test_step_up(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double")
    got = dict((r["k"], (r["q"], r["reject"])) for r in windows.step_up(df, "p", "k", 0.05).collect())
    assert got[1] == (pytest.approx(0.03), True) and got[3] == (pytest.approx(0.04), True) and got[2] == (pytest.approx(0.04), True) and got[4] == (None, None)


def test_sen_and_mann_kendall(spark):
    df = spark.createDataFrame([(1, y, 2.0 * y + 1) for y in range(2000, 2010)] + [(2, 2000, 1.0), (2, 2001, 2.0)], "z int, y int, v double")
    slope = {r["z"]: r for r in trends.sen_slope(df, ["z"], "y", "v").collect()}
    assert slope[1]["slope"] == 2.0 and slope[1]["intercept"] == 1.0
    mk = {r[0]: r for r in trends.mann_kendall(df.withColumnRenamed("z", "zone"), ["zone"], "y", "v").withColumn("p", trends.two_sided_p("z")).collect()}
    assert mk[1]["s"] == 45 and mk[1]["var_s"] == 125 and mk[1]["z"] == pytest.approx(44 / math.sqrt(125)) and mk[1]["p"] < 0.001
    assert mk[2]["s"] is None and mk[2]["z"] is None


def test_checkerboard_moran_is_minus_one(spark):
    cells = [(r * 4 + c, 10.0 if (r + c) % 2 else 20.0) for r in range(4) for c in range(4)]
    edges = [(r * 4 + c, a * 4 + b) for r in range(4) for c in range(4) for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if 0 <= a < 4 and 0 <= b < 4]
    got = graph.moran(spark.createDataFrame(cells, "k long, v double"), spark.createDataFrame(edges, "i long, j long"), "k", "v").first()
    assert got["moran_i"] == pytest.approx(-1)


def test_components(spark):
    got = one(graph.connected(spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(50, 51)], "i long, j long")), "i")
    assert all(c == (10 if i < 40 else 50) for i, c in got) and len(got) == 23


@pytest.mark.parametrize(
    ("series", "trend", "want"),
    [
        ([0, 0, 0], 0, "no_pattern"), ([-3, 0, 3], 0, "oscillating_hot_spot"), ([0, 0, 3], 0, "new_hot_spot"), ([0, 3, 3], 0, "consecutive_hot_spot"), ([3, 3, 3], 1, "intensifying_hot_spot"),
        ([3, 3, 3], -1, "diminishing_hot_spot"), ([3, 3, 3], 0, "persistent_hot_spot"), ([3] * 19 + [0], 0, "historical_hot_spot"), ([3, 0, 3], 0, "sporadic_hot_spot"), ([3, 0, 0], 0, "no_pattern"), ([-3, -3, -3], -1, "intensifying_cold_spot"),
    ],
)
def test_emerging(spark, series, trend, want):
    df = spark.createDataFrame([(1, i, float(z), trend) for i, z in enumerate(series)], "zone int, b int, z double, t int")
    assert graph.emerging(df, "zone", "b", "z", "t").first()["category"] == want


def test_kappa(spark):
    counts = lambda m: spark.createDataFrame([(i, j, n) for i, row in enumerate(m) for j, n in enumerate(row)], "truth int, guess int, n long")
    assert agreement.agreement(counts([[20, 5], [10, 15]])).first()["kappa"] == pytest.approx(0.4)
    assert agreement.agreement(counts([[25, 25], [25, 25]])).first()["kappa"] == pytest.approx(0)
    assert agreement.agreement(counts([[10]])).first()["kappa"] is None


def test_topsis(spark):
    df = spark.createDataFrame([(1, 7.0, 9.0), (2, 8.0, 6.0), (3, 9.0, 5.0)], "k int, a double, b double")
    got = [x for _, x in one(ranking.topsis(df, "k", [("a", 0.6, True), ("b", 0.4, True)]), "k")]
    assert got == pytest.approx([0.609140, 0.332713, 0.390860], abs=1e-6)


def test_overlay_redistributes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(ranking.overlay([(F.col("a"), 0.7), (F.col("b"), 0.3)])).collect()]
    assert got == [pytest.approx(0.7), pytest.approx(1.0), None]


def test_unseen_state_is_identity(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "u int, t int, s string")
    got = {(r["a"], r["b"]): r["p"] for r in agreement.transitions(df, ["u"], ["t"], "s", ["a", "b"]).collect()}
    assert got == {("a", "a"): 0.0, ("a", "b"): 1.0, ("b", "a"): 0.0, ("b", "b"): 1.0}


def test_focal_share_counts_grid_neighbours_only(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0)], "row int, col int, code int")
    assert one(grids.focal_share(df, "code", 1, 1), "row", "col")[0][2] == pytest.approx(1 / 3)


def test_weights_and_refusals(spark):
    w, ratio = ranking.pairwise_weights([[1, 2], [0.5, 1]])
    assert w == pytest.approx([2 / 3, 1 / 3]) and ratio == 0
    with pytest.raises(ValueError):
        ranking.pairwise_weights([[1, 2], [2, 1]])
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        guards.unique(df, ["k"])
    with pytest.raises(ValueError):
        ranking.same_keys(df, spark.createDataFrame([(2,)], "k int"), "k")
    with pytest.raises(ValueError):
        guards.product({"kappa": 0.8, "no_change_kappa": 0.9, "outside_share": 0.0, "held_out": True})
    assert guards.product({"kappa": 0.9, "no_change_kappa": 0.8, "outside_share": 0.0, "held_out": True})


def test_guarded_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    tables.write(df, str(tmp_path / "x"), keys=["k"], columns=["k", "v"], notes={"made": "here"})
    assert tables.read(spark, str(tmp_path / "x")).count() == 1
    assert "made" in tables.read(spark, str(tmp_path / "x.notes"), "text").first()[0]
    with pytest.raises(ValueError):
        tables.write(df.union(df), str(tmp_path / "y"), keys=["k"])
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path), "csv")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    live = event_windows.stream(spark, str(tmp_path / "in"), events.schema.simpleString()[7:-1].replace(":", " "))
    q = event_windows.tumbling(live, "ts", "1 day", ["event_type"], "value", "60 days").writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    count = lambda df: one(df.select(F.col("start").cast("string"), "event_type", "n"), "start", "event_type")
    assert count(spark.table("tumbled")) == count(event_windows.tumbling(events, "ts", "1 day", ["event_type"], "value"))


def test_mentions_anywhere(spark):
    """Whole item texts are found beyond a document's opening and inside words; the two-word prefix finds none of them."""
    items = {1: "cd ef gh", 2: "cd ef zz", 3: "q", 4: ""}
    texts = {10: "ab cd ef gh ij", 11: "xcd ef ghx " * 3, 12: "cd ef", 13: None, 14: "w " * 5000 + "cd ef zz"}
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["item_id"]: (r["documents"], r["first_doc"]) for r in aggregates.mentions(b, docs, "item_id", "doc_id", "text").collect()}
    found = {i: [d for d, t in texts.items() if t is not None and x in t] for i, x in items.items()}
    assert got == {i: (len(f), min(f, default=None)) for i, f in found.items()}


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_of_all_points(spark, k):
    """Clusters, outliers, equal places and points without coordinates against brute force; groups do not limit the search."""
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 50)) for i in range(150)] + [(200 + i, 1000.0, 7.0) for i in range(6)] + [(300, -9000.0, 4.0), (301, None, 1.0), (302, 1.0, float("nan"))]
    got = {(r["i"], r["rank"]): (r["j"], r["distance"]) for r in graph.nearest_all(spark.createDataFrame(rows, "s long, x double, y double"), "s", "x", "y", k).collect()}
    known = [r for r in rows if r[1] is not None and r[2] == r[2]]
    want = {}
    for i, x, y in known:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in known if j != i)
        want |= {(i, n + 1): (j, pytest.approx(d)) for n, (d, j) in enumerate(near[:k])}
    assert got == want


def test_variance_index_divides_by_the_mean_and_absent_classes_stay(spark):
    df = spark.createDataFrame([(2000, 30.0), (2000, 33.0), (2000, 27.0), (2000, None)], "y int, x double")
    rows = df.withColumn("c", scalar.bucket(scalar.variance_index(F.col("x"), F.lit(30.0)), (0.0, 0.005, 0.010, 0.015, 0.020)))
    got = one(aggregates.class_percent(rows, ["y"], "c", range(6)), "c")
    third = pytest.approx(100 / 3)
    assert got == [(2000, 0, 1, third), (2000, 1, 1, third), (2000, 2, 0, 0.0), (2000, 3, 0, 0.0), (2000, 4, 0, 0.0), (2000, 5, 1, third)]
    assert [r[0] for r in df.select(scalar.variance_index(F.col("x"), F.lit(0.0))).collect()] == [None] * 4


@pytest.mark.parametrize(
    ("v", "n", "verdict"),
    [
        ([5.0, 4.0, 3.0, 2.0], [1.0, 2.0, 3.0, 4.0], "sampling_artefact_likely"), ([2.0, 3.0, 4.0, 5.0], [4.0, 3.0, 2.0, 1.0], "partial_association"), ([2.0, 3.0, 4.0, 5.0], [1.0, 2.0, 3.0, 4.0], "partial_association"),
        ([2.0, 3.0, 4.0, 5.0], [7.0] * 4, "not_explained_by_sampling"), ([1.0, 2.0, 1.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0, 5.0], "not_explained_by_sampling"), ([1.0, 2.0, None, None], [1.0, 2.0, 3.0, 4.0], "insufficient_data"),
    ],
)
def test_count_check(spark, v, n, verdict):
    df = spark.createDataFrame([("a", 2000 + i, x, c) for i, (x, c) in enumerate(zip(v, n, strict=True))], "k string, y int, v double, n double")
    assert [r["verdict"] for r in trends.count_check(df, ["k"], "y", "v", "n").collect()] == [verdict]


def test_tau_b_counts_ties(spark):
    df = spark.createDataFrame([("a", y, v) for y, v in enumerate([1.0, 1.0, 2.0, 3.0])] + [("b", y, 5.0) for y in range(4)], "k string, y int, v double")
    assert one(trends.kendall_tau(df, ["k"], "y", "v"), "k") == [("a", pytest.approx(5 / math.sqrt(6 * 5))), ("b", None)]


@pytest.mark.parametrize("dependent", [False, True])
def test_step_up_of_many_and_tied_tests(spark, dependent):
    """Against the plain procedure, with ties, zeros, ones, tiny values and untested rows."""
    random.seed(4)
    p = [random.choice([0.0, 1.0, 0.5, 1e-9, 1e-300, random.random(), random.random() ** 6]) for _ in range(700)] + [None, float("nan")]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    known = sorted(x for x in p if x is not None and x == x)
    m = len(known)
    c = sum(1 / k for k in range(1, m + 1)) if dependent else 1.0
    want, least = {}, 1.0
    for k in range(m, 0, -1):
        least = min(least, known[k - 1] * m * c / k)
        want.setdefault(known[k - 1], least)
        want[known[k - 1]] = min(want[known[k - 1]], least) if known[k - 1] not in known[k:] else want[known[k - 1]]
    got = windows.step_up(df, "p", "k", 0.05, dependent).collect()
    assert len(got) == len(p)
    for r in got:
        if r["p"] is None or r["p"] != r["p"]:
            assert r["q"] is None and r["reject"] is None
        else:
            assert r["q"] == pytest.approx(want[r["p"]], rel=1e-9, abs=0) and r["reject"] == (want[r["p"]] <= 0.05)


def test_focal_share_sorts_no_pairs(spark):
    """Neighbours' marks are summed by place: no join of all pairs of neighbours; lone, null and repeated places as before."""
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 1), (5, 5, 1), (None, 3, 1), (0, 2, None), (0, 1, 2)], "row long, col long, code int")
    out = grids.focal_share(cells, "code", 1, 1)
    assert {(r["row"], r["col"]): round(r["share"], 6) for r in out.collect()} == {(0, 0): round(1 / 3, 6), (0, 1): round(2 / 3, 6), (1, 1): 0.25, (0, 2): round(1 / 3, 6)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_components_send_no_tables_to_the_driver(spark):
    """Joins of the labelling are never broadcast, and nearest points can be sought from some points only."""
    edges = spark.range(200).where("id % 10 <> 9").select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    jobs = []
    real = graph.written
    graph.written = lambda df: (jobs.append(df), real(df))[1]
    try:
        got = {r["i"]: r["component"] for r in graph.connected(edges).collect()}
    finally:
        graph.written = real
    assert got == {i: i - i % 10 for i in range(200)}
    assert all("BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() for df in jobs)
    points = spark.createDataFrame([(i, float(i * i), 0.0) for i in range(30)], "k long, x double, y double")
    every = {tuple(r) for r in graph.nearest_all(points, "k", "x", "y", 2).collect()}
    some = {tuple(r) for r in graph.nearest_all(points, "k", "x", "y", 2, spark.createDataFrame([(3,), (17,)], "i long")).collect()}
    assert some == {r for r in every if r[0] in (3, 17)}
