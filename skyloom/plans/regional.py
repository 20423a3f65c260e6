"""Queries of zones: landscape metrics, levels of units, space-time hot spots, polygons, models and surfaces.

Cells are parts on a grid of fifty columns, zones nations or blocks of cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyloom.operators import graph, levels, patches, polygons, regression
from skyloom.plans.catalog import NORMAL_P, QUERIES, query, r6  # noqa: F401
from skyloom.sources.tables import table
from skyloom.streaming import merges

# --- landscape -----------------------------------------------------------------

BLOCKED = "c AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 97 > 0 THEN p_partkey // 500 * 5 + p_partkey % 50 // 10 END AS zone, CASE WHEN p_size % 10 > 0 THEN p_size % 4 END AS code FROM part)"


def _blocked(spark, d):
    """Cells in zones of ten by ten, some in none, some without a code."""
    k, s = F.col("p_partkey"), F.col("p_size")
    zone = F.when(k % 97 > 0, F.floor(k / 500) * 5 + F.floor(k % 50 / 10))
    return table(spark, d, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), zone.alias("zone"), F.when(s % 10 > 0, s % 4).alias("code"))


LANDSCAPE = f"""WITH RECURSIVE {BLOCKED}, z AS (SELECT zone, count(*) AS total, count(code) AS seen FROM c WHERE zone IS NOT NULL GROUP BY zone),
x AS (SELECT row * 1000 + col AS i, row, col, zone, code FROM c WHERE zone IS NOT NULL AND code IN (1, 2)),
n AS (SELECT a.i, b.row * 1000 + b.col AS j, coalesce(b.code = a.code, false) AS alike, a.row = b.row OR a.col = b.col AS side FROM x a JOIN c b ON b.zone = a.zone AND b.code IS NOT NULL AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)),
w AS (SELECT i, i AS r FROM x UNION SELECT n.j, w.r FROM w JOIN n ON n.i = w.i AND n.alike), p AS (SELECT i, min(r) AS patch FROM w GROUP BY i),
s AS (SELECT i, count(*) FILTER (side AND alike) AS alike4, count(*) FILTER (side AND NOT alike) AS edge, count(*) FILTER (alike) AS same FROM n GROUP BY i),
"""


def _landscape_rest(least: int) -> str:
    """Sums by patch and zone of the cells of ``x`` with their patch, from LANDSCAPE's steps."""
    return f"""f AS (SELECT x.zone, x.code, p.patch, count(*) AS n, sum(coalesce(alike4, 0)) AS alike4, sum(coalesce(edge, 0)) AS edge, count(*) FILTER (same = 8) AS core FROM x JOIN p ON p.i = x.i LEFT JOIN s ON s.i = x.i GROUP BY ALL HAVING count(*) >= {least}),
g AS (SELECT zone, code, sum(n) AS n, count(*) AS patches, max(n) AS most, avg(0.25 * (4 * n - alike4) / sqrt(n::DOUBLE)) AS mean_shape, sum(core) AS core, sum(edge) AS edge, sum(alike4) / 2 AS alike4 FROM f GROUP BY ALL),
h AS (SELECT z.zone, k.code, total, seen, coalesce(n, 0) AS n, coalesce(patches, 0) AS patches, most, mean_shape, coalesce(core, 0) AS core, coalesce(edge, 0) AS edge, alike4, floor(sqrt(n::DOUBLE))::BIGINT AS q FROM z CROSS JOIN (VALUES (1), (2)) k(code) LEFT JOIN g ON g.zone = z.zone AND g.code = k.code)
SELECT zone::BIGINT AS zone, code::INTEGER AS class, round(seen * 0.09::DOUBLE, 6) AS landscape_ha, round(n * 0.09::DOUBLE, 6) AS class_ha, round(n / nullif(seen, 0)::DOUBLE, 6) AS class_share, patches::BIGINT AS patches, round(100 * patches / nullif(seen * 0.09::DOUBLE, 0), 6) AS patches_per_100ha,
round(edge * 30::DOUBLE, 6) AS edge_m, round(edge * 30 / nullif(seen * 0.09::DOUBLE, 0), 6) AS edge_m_per_ha, round(n / nullif(patches, 0)::DOUBLE * 0.09, 6) AS mean_patch_ha, round(100::DOUBLE * coalesce(most, CASE WHEN seen > 0 THEN 0 END) / nullif(seen, 0), 6) AS largest_patch_index, round(mean_shape, 6) AS mean_shape, round(core * 0.09::DOUBLE, 6) AS core_ha,
round(CASE WHEN n = 1 THEN 0 WHEN n > 0 THEN 100::DOUBLE * alike4 / (2 * q * (q - 1) + CASE WHEN n = q * q THEN 0 WHEN n - q * q <= q THEN 2 * (n - q * q) - 1 ELSE 2 * (n - q * q) - 2 END) END, 6) AS aggregation_index, round(seen / total::DOUBLE, 6) AS observed_share, seen < 0.5 * total AS below_floor FROM h"""


@query(LANDSCAPE + _landscape_rest(1))
def landscape_by_zone(spark, d):
    """Landscape metrics of two codes within every zone, patches cut at its border."""
    out = patches.by_zone(_blocked(spark, d), "zone", "code", [1, 2], 30.0)
    return out.select(*[r6(c) if t == "double" else c for c, t in out.dtypes])


# --- levels of units -------------------------------------------------------------

@query("""WITH r AS (SELECT n_regionkey AS region, n_nationkey AS nation, o_totalprice AS v, c_acctbal AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
u AS (SELECT CASE grouping(nation) + 2 * grouping(region) WHEN 0 THEN 'nation' WHEN 1 THEN 'region' ELSE 'all' END AS level, avg(v) AS v, avg(o) AS o, count(v) AS n FROM r GROUP BY GROUPING SETS ((region, nation), (region), ())),
a AS (SELECT level, count(*) AS k, avg(v) AS mean, sum(v * n) / sum(n) AS weighted_mean, stddev_pop(v) AS sd, stddev_pop(v) / abs(avg(v)) AS variation, CASE WHEN stddev_pop(v) > 0 AND stddev_pop(o) > 0 THEN corr(v, o) END AS correlation, covar_pop(v, o) / nullif(var_pop(v), 0) AS slope FROM u GROUP BY level),
t AS (SELECT level, k, unnest([{'s': 'mean', 'm': 1, 'x': mean}, {'s': 'weighted_mean', 'm': 1, 'x': weighted_mean}, {'s': 'sd', 'm': 2, 'x': sd}, {'s': 'variation', 'm': 2, 'x': variation}, {'s': 'correlation', 'm': 3, 'x': correlation}, {'s': 'slope', 'm': 3, 'x': slope}], recursive := true) FROM a)
SELECT s AS statistic, level, k::BIGINT AS n_units, CASE WHEN k < m OR x IS NULL THEN 'not_estimable' ELSE 'ok' END AS status, CASE WHEN k >= m THEN round(x, 4) END AS value, CASE WHEN k < m THEN k || ' units of ' || m || ' needed' WHEN x IS NULL THEN 'no spread among units' ELSE '' END AS reason FROM t""")
def level_comparison(spark, d):
    """Means of prices against balances over nations, over regions and over all, with a reason where a statistic has too few units."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = levels.comparison(rows, {"nation": ["n_regionkey", "n_nationkey"], "region": ["n_regionkey"], "all": []}, "o_totalprice", "c_acctbal")
    return out.select("statistic", "level", "n_units", "status", F.round("value", 4).alias("value"), "reason")


# --- polygons ------------------------------------------------------------------

BRICKS = "b AS (SELECT p_partkey AS k, p_partkey // 50 AS row, p_partkey % 50 + CASE WHEN p_partkey // 50 % 3 = 0 THEN 0.5 ELSE 0 END AS x FROM part)"


def _bricks(spark, d):
    """Cells as polygons, every third row half a cell aside, so that borders meet at corners of one side only."""
    k = F.col("p_partkey")
    at = table(spark, d, "part").select(k.alias("k"), F.floor(k / 50).cast("double").alias("y"), (k % 50 + F.when(F.floor(k / 50) % 3 == 0, 0.5).otherwise(0.0)).alias("x"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return at.select("k", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))


@query(f"WITH {BRICKS} SELECT a.k AS i, b.k AS j, round(CASE WHEN a.row = b.row THEN 1 ELSE 1 - abs(a.x - b.x) END, 6)::DOUBLE AS length FROM b a JOIN b ON (a.row = b.row AND abs(a.x - b.x) = 1) OR (abs(a.row - b.row) = 1 AND abs(a.x - b.x) < 1)")
def border_lengths(spark, d):
    """Pairs of all cells' polygons with a common border, and how long it is."""
    return polygons.shared_borders(_bricks(spark, d), "k", "rings", 0.001).select("i", "j", r6("length"))


@query(f"WITH {BRICKS} SELECT a.k AS i, b.k AS j FROM b a JOIN b ON a.k <> b.k AND abs(a.row - b.row) <= 1 AND abs(a.x - b.x) <= 1")
def border_meetings(spark, d):
    """Pairs of all cells' polygons whose borders meet, in a point at least."""
    return polygons.touching(_bricks(spark, d), "k", "rings", 0.001, 8.0, 2_000)


@query("""WITH p AS (SELECT c_custkey, c_acctbal / 100 AS x, (c_custkey % 100)::DOUBLE AS y FROM customer), z AS (SELECT n_nationkey AS zone, n_nationkey * 3 + 0.00303::DOUBLE AS x, n_nationkey % 5 * 15 + 0.5::DOUBLE AS y FROM nation)
SELECT c_custkey, zone FROM p JOIN z ON (p.x > z.x AND p.x < z.x + 20 AND p.y > z.y AND p.y < z.y + 20 AND NOT (p.x > z.x + 5 AND p.x < z.x + 15 AND p.y > z.y + 5 AND p.y < z.y + 15)) OR (p.x > z.x + 30 AND p.x < z.x + 34 AND p.y > z.y AND p.y < z.y + 4)""")
def points_in_parts(spark, d):
    """Customers in nations' areas, which have a hole and a second part, by buckets that split where many are."""
    k = F.col("n_nationkey")
    x, y = k * 3 + 0.00303, k % 5 * 15 + 0.5
    box = lambda a, b, c, e: F.array(*[F.struct((x + p).alias("x"), (y + q).alias("y")) for p, q in ((a, b), (c, b), (c, e), (a, e))])
    areas = table(spark, d, "nation").select(k.alias("zone"), F.array(box(0.0, 0.0, 20.0, 20.0), box(5.0, 5.0, 15.0, 15.0), box(30.0, 0.0, 34.0, 4.0)).alias("rings"))
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return polygons.points_in_polygons(points, areas, "x", "y", "rings", 20.0, 5_000).select("c_custkey", "zone")


# --- spatial regression -----------------------------------------------------------

@query(f"""WITH e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
v AS (SELECT c_nationkey AS i, avg(c_acctbal) AS x, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
b AS (SELECT count(*)::DOUBLE AS n, covar_pop(x, y) / var_pop(x) AS b1, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS b0, avg(x) AS mx, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS yy FROM v),
f AS (SELECT i, x, y, b0 + b1 * x AS f, y - b0 - b1 * x AS r FROM v, b), l AS (SELECT e.i, avg(f.r) AS wr, avg(f.y) AS wy, avg(f.f) AS wf, count(*)::DOUBLE AS k FROM e JOIN f ON f.i = e.j WHERE e.i IN (SELECT i FROM v) GROUP BY e.i),
t AS (SELECT sum(1 / (a.k * a.k) + 1 / (a.k * c.k)) AS t FROM e JOIN l a ON a.i = e.i JOIN l c ON c.i = e.j),
s AS (SELECT sum(r * r) AS ee, sum(r * coalesce(wr, 0)) AS ewe, sum(r * coalesce(wy, 0)) AS ewy, sum(coalesce(wf, 0) * coalesce(wf, 0)) AS ff, sum(coalesce(wf, 0)) AS f0, sum((x - mx) * coalesce(wf, 0)) AS f1, count(k) AS s0 FROM f LEFT JOIN l ON l.i = f.i, b),
q AS (SELECT n, b0, b1, 1 - ee / yy AS r2, ee / n AS s2, ewe / ee * n / s0 AS moran, t, (ff - f0 * f0 / n - f1 * f1 / sxx) / (ee / n) AS d, ewy / (ee / n) AS a, ewe / (ee / n) AS c FROM s, b, t),
z AS (SELECT *, a * a / (d + t) AS lm_lag, c * c / t AS lm_error, (a - c) * (a - c) / d AS lm_robust_lag, (c - t / (d + t) * a) * (c - t / (d + t) * a) / (t * d / (d + t)) AS lm_robust_error FROM q)
SELECT n::BIGINT AS n, round(b0, 3) AS b0, round(b1, 6) AS b1, round(r2, 6) AS r2, round(moran, 6) AS residual_moran, round(lm_lag, 6) AS lm_lag, round(lm_error, 6) AS lm_error, round(lm_robust_lag, 5) AS lm_robust_lag, round(lm_robust_error, 5) AS lm_robust_error, round({NORMAL_P.format(z='sqrt(lm_lag)')}, 6) AS p_lag, round({NORMAL_P.format(z='sqrt(lm_error)')}, 6) AS p_error FROM z""")
def spatial_dependence(spark, d):
    """Least squares of nations' mean prices on balances, with Lagrange-multiplier tests under weights within regions."""
    v = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("i")).agg(F.avg("c_acctbal").alias("x"), F.avg("o_totalprice").alias("y"))
    out = regression.spatial_tests(v, graph.contiguity(table(spark, d, "nation"), "n_nationkey", "n_regionkey"), "i", "y", ["x"])
    beta = [F.round(F.get("coefficients", F.lit(k)), n).alias(f"b{k}") for k, n in ((0, 3), (1, 6))]
    return out.select("n", *beta, r6("r2"), r6("residual_moran"), r6("lm_lag"), r6("lm_error"), F.round("lm_robust_lag", 5).alias("lm_robust_lag"), F.round("lm_robust_error", 5).alias("lm_robust_error"), r6("p_lag"), r6("p_error"))


# --- growing series ------------------------------------------------------------------

@query("SELECT o_orderpriority AS sensor, year(o_orderdate)::INTEGER AS year, count(o_totalprice)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 3) AS sd FROM orders GROUP BY ALL")
def incremental_means(spark, d):
    """Yearly means by sensor from a stream over the table's files, a file at a time, merged from stored sums."""
    orders = table(spark, d, "orders")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/orders.parquet*")
    rows = stream.select(F.col("o_orderpriority").alias("sensor"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"))
    folder = f"{graph.shared_folder(spark)}/series-{uuid.uuid4().hex}"
    merges.run(rows, folder, ["sensor", "year"], "price")
    return merges.merged(spark, folder, ["sensor", "year"]).select("sensor", "year", "n", F.round("mean", 4).alias("mean"), F.round("sd", 3).alias("sd"))
