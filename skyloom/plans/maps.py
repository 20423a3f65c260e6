"""Further queries over the driver's tables: spatial joins and weights, zone tables, rankings, land-change tests.

Cells are parts on a grid of fifty columns, zones are nations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import rules
from skyloom.operators import aggregates, graph, masks, prediction, ranking, significance, spatial, trends, zones
from skyloom.plans.catalog import CELLS, MK, NORMAL_P, QUERIES, SERIES, YEARLY, cells, query, r6, series, yearly_orders  # noqa: F401
from skyloom.sources.tables import table

# --- spatial joins and weights ---------------------------------------------------


def _boxes(spark, d):
    """Cells of code 0 as unit boxes."""
    c = cells(spark, d).where("code = 0").select((F.col("row") * 50 + F.col("col")).alias("k"), F.col("col").cast("double").alias("x0"), F.col("row").cast("double").alias("y0"))
    return c.withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})


BOXES = f"{CELLS}, b AS (SELECT row * 50 + col AS k, row, col FROM c WHERE code = 0)"
ROOK = "e AS (SELECT a.k AS i, b.k AS j FROM b a JOIN b ON abs(a.row - b.row) + abs(a.col - b.col) = 1)"


@query(f"WITH {BOXES}, {ROOK} SELECT i, j FROM e")
def contiguity_rook(spark, d):
    """Edges between boxes that share more than a point."""
    return spatial.touching(_boxes(spark, d), "k", 8.0, rook=True)


@query(f"WITH {BOXES} SELECT a.k AS i, b.k AS j FROM b a JOIN b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.k <> b.k")
def contiguity_queen(spark, d):
    """Edges between boxes that meet, in a point at least."""
    return spatial.touching(_boxes(spark, d), "k", 8.0)


@query(f"""WITH {BOXES}, {ROOK}, l AS (SELECT k FROM b WHERE k NOT IN (SELECT i FROM e)),
n AS (SELECT a.k AS i, arg_min(b.k, struct_pack(d := (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col), k := b.k)) AS j FROM b a JOIN b ON a.k <> b.k WHERE a.k IN (SELECT k FROM l) GROUP BY a.k),
u AS (SELECT i, j FROM e UNION SELECT i, j FROM n UNION SELECT j, i FROM n) SELECT i, j, round(1::DOUBLE / count(*) OVER (PARTITION BY i), 6) AS w FROM u""")
def weights_repaired(spark, d):
    """Row-standardised rook weights; a box without neighbour gets its nearest one, both ways."""
    b = _boxes(spark, d)
    edges = graph.written(spatial.touching(b, "k", 8.0, rook=True))
    return spatial.weights(b, "k", edges, graph.nearest_all(b, "k", "x0", "y0", 1, spatial.islands(b, "k", edges))).select("i", "j", r6("w"))


@query(f"""WITH {BOXES}, {ROOK}, m AS (SELECT b.k, count(e.j) AS n FROM b LEFT JOIN e ON e.i = b.k GROUP BY b.k)
SELECT count(*)::BIGINT AS n, count(*) FILTER (n = 0)::BIGINT AS islands, min(n)::BIGINT AS least, round(avg(n), 6) AS mean, max(n)::BIGINT AS most, round(100 * sum(n) / (count(*) * count(*))::DOUBLE, 6) AS percent_nonzero, true AS symmetric FROM m""")
def weights_report(spark, d):
    """Figures of the rook weights before any repair."""
    b = _boxes(spark, d)
    return spatial.weights_report(b, "k", spatial.touching(b, "k", 8.0, rook=True)).select("n", "islands", "least", r6("mean"), "most", r6("percent_nonzero"), "symmetric")


DIAMONDS = [(1, 10.0, 30.0, 17.00001), (2, 60.0, 40.0, 33.00001), (3, 80.0, 80.0, 25.00001)]


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 100 AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier), z AS (SELECT * FROM (VALUES (1, 10.0, 30.0, 17.00001), (2, 60.0, 40.0, 33.00001), (3, 80.0, 80.0, 25.00001)) t(zone, cx, cy, r))
SELECT s_suppkey, zone::INTEGER AS zone FROM p JOIN z ON abs(x - cx) + abs(y - cy) < r""")
def points_in_zones(spark, d):
    """Suppliers in polygons by even and odd crossings; a point may lie in several."""
    rows = [(k, [(x - r, y), (x, y + r), (x + r, y), (x, y - r)]) for k, x, y, r in DIAMONDS]
    polygons = spark.createDataFrame(rows, "zone int, ring array<struct<x: double, y: double>>")
    points = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return spatial.points_in_polygons(points, polygons, "x", "y", "ring", 20.0).select("s_suppkey", "zone")


NEAREST = f"WITH {CELLS}, d AS (SELECT a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS d FROM c a JOIN c b ON b.code = 3 AND b.col % 9 = 0 GROUP BY a.row, a.col)"


@query(f"{NEAREST} SELECT row, col, round(sqrt(d), 6) AS distance FROM d")
def target_distance(spark, d):
    """Distance of every cell to the nearest target cell, however far."""
    c = cells(spark, d)
    return spatial.nearest_target(c, c.where("code = 3 AND col % 9 = 0")).select("row", "col", r6("distance"))


@query(f"{NEAREST} SELECT row, col, round(sqrt(d), 6) AS distance FROM d WHERE d > 4 AND d <= 16")
def ring_cells(spark, d):
    """Cells in the ring from two to four cells around a base."""
    c = cells(spark, d)
    return spatial.ring(c, c.where("code = 3 AND col % 9 = 0"), 2, 4).select("row", "col", r6("distance"))


BURNT = f"{CELLS}, z AS (SELECT n_nationkey + 1 AS zone, (n_nationkey * 2)::DOUBLE AS x0, (n_nationkey * 2 + 5)::DOUBLE AS x1, (n_nationkey % 5 * 8)::DOUBLE AS y0, (n_nationkey % 5 * 8 + 6)::DOUBLE AS y1 FROM nation)"


def _burnt(spark, d):
    k = F.col("n_nationkey")
    boxes = table(spark, d, "nation").select((k + 1).alias("code"), (k * 2).cast("double").alias("x0"), (k * 2 + 5).cast("double").alias("x1"), (k % 5 * 8).cast("double").alias("y0"), (k % 5 * 8 + 6).cast("double").alias("y1"))
    return spatial.burnt(cells(spark, d).withColumnRenamed("code", "own"), boxes, "code", 10.0)


@query(f"WITH {BURNT} SELECT row, col, coalesce(min(zone), 0)::INTEGER AS zone FROM c LEFT JOIN z ON col + 0.5 >= x0 AND col + 0.5 < x1 AND row + 0.5 >= y0 AND row + 0.5 < y1 GROUP BY row, col")
def zone_raster(spark, d):
    """Cells with the first zone whose box holds their centre, 0 outside."""
    return _burnt(spark, d).select("row", "col", "zone")


@query(f"WITH {CELLS}, k AS (SELECT row // 5 AS row, col // 5 AS col, count(*) AS n, count(*) FILTER (code = 1) AS ones FROM c GROUP BY ALL) SELECT c.row, c.col, round(ones / n::DOUBLE, 6) AS share FROM c JOIN k ON c.row // 5 = k.row AND c.col // 5 = k.col")
def nested_grids(spark, d):
    """Cells with a figure of the coarse cell around them."""
    c = cells(spark, d)
    coarse = c.groupBy(F.floor(F.col("row") / 5).alias("row"), F.floor(F.col("col") / 5).alias("col")).agg((F.count_if(F.col("code") == 1) / F.count("*")).alias("share"))
    return spatial.nested(c, coarse, 5).select("row", "col", r6("share"))


@query(f"WITH {CELLS} SELECT min(row)::BIGINT AS row0, (max(row) + 1)::BIGINT AS row1, min(col)::BIGINT AS col0, (max(col) + 1)::BIGINT AS col1 FROM c WHERE code = 2 AND col BETWEEN 7 AND 31")
def work_envelope(spark, d):
    """Bounds of the cells under a mask."""
    return spatial.envelope(cells(spark, d), (F.col("code") == 2) & F.col("col").between(7, 31))


@query("""WITH z AS (SELECT n_nationkey AS i, n_regionkey AS g, n_nationkey % 5 AS x, n_nationkey // 5 AS y, n_nationkey % 6 = 0 AS w FROM nation)
SELECT a.i, a.w AS within, NOT a.w AND coalesce(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) FILTER (b.w) <= 1, false) AS within_1,
NOT a.w AND coalesce(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) FILTER (b.w) <= 2, false) AS within_2, NOT a.w AND coalesce(bool_or(b.w AND a.g = b.g), false) AS borders FROM z a JOIN z b ON a.i <> b.i GROUP BY a.i, a.w""")
def adjacent_zones(spark, d):
    """Zones within, near by two reaches, and bordering."""
    z = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), "n_regionkey", (F.col("n_nationkey") % 5).cast("double").alias("x"), F.floor(F.col("n_nationkey") / 5).cast("double").alias("y"))
    near = graph.nearest_all(z, "i", "x", "y", 24).select("i", "j", "distance")
    return spatial.adjacent_zones(z, "i", F.col("i") % 6 == 0, near, graph.contiguity(z, "i", "n_regionkey"), [1, 2])


# --- zone tables and rankings ----------------------------------------------------

ZONE_TABLES = """a AS (SELECT c_nationkey AS zone, avg(c_acctbal) AS balance, count(*)::BIGINT AS n FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS zone, avg(s_acctbal) AS supply, count(*)::BIGINT AS m FROM supplier GROUP BY 1), j AS (SELECT coalesce(a.zone, b.zone) AS zone, balance, supply, n, m FROM a FULL JOIN b ON a.zone = b.zone)"""


def _tables(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("n"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.avg("s_acctbal").alias("supply"), F.count("*").alias("m"), F.max("s_acctbal").alias("balance"))
    return [a, b]


@query(f"""WITH {ZONE_TABLES}, w AS (SELECT * FROM j WHERE balance IS NOT NULL AND supply IS NOT NULL AND n IS NOT NULL)
SELECT zone, round(balance, 6) AS balance, round(coalesce((supply - avg(supply) OVER ()) / nullif(stddev_pop(supply) OVER (), 0), 0), 6) AS supply, round(coalesce((n - avg(n) OVER ()) / nullif(stddev_pop(n) OVER (), 0), 0), 6) AS n FROM w""")
def model_frame(spark, d):
    """Two zone tables joined with the first one's columns winning, complete zones, predictors standardised."""
    a, b = _tables(spark, d)
    out = zones.model_frame([a.withColumn("n", F.col("n").cast("double")), b], "zone", "balance", ["supply", "n"])
    return out.select("zone", r6("balance"), r6("supply"), r6("n"))


@query(f"""WITH {ZONE_TABLES}, g AS (SELECT zone, CASE WHEN n >= 4 THEN balance END AS balance, CASE WHEN m >= 4 THEN supply END AS supply, balance IS NOT NULL AND coalesce(n >= 4, false) AS bu, supply IS NOT NULL AND coalesce(m >= 4, false) AS su, least(n, m)::DOUBLE AS n_least FROM j),
r AS (SELECT zone, bu, su, n_least, CASE WHEN balance IS NOT NULL THEN (rank() OVER (PARTITION BY balance IS NULL ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0::DOUBLE) / count(balance) OVER () END AS bn,
CASE WHEN supply IS NOT NULL THEN (rank() OVER (PARTITION BY supply IS NULL ORDER BY -supply) + (count(*) OVER (PARTITION BY supply) - 1) / 2.0::DOUBLE) / count(supply) OVER () END AS sn,
(CASE WHEN bu THEN 0 ELSE 2 END + CASE WHEN su THEN 0 ELSE 1 END) / 3.0::DOUBLE AS mw FROM g)
SELECT zone, bu AS balance_usable, su AS supply_usable, n_least, round(bn, 6) AS balance_norm, round(sn, 6) AS supply_norm, round(mw, 6) AS missing_weight, CASE WHEN mw > 0.5 THEN 'insufficient' WHEN mw > 0 THEN 'partial' ELSE 'scored' END AS status FROM r""")
def prepared_criteria(spark, d):
    """Two criteria gated by their counts, turned, ranked to 0..1, with what is missing."""
    out = _prepared(spark, d)
    return out.select("zone", "balance_usable", "supply_usable", "n_least", r6("balance_norm"), r6("supply_norm"), r6("missing_weight"), "status")


def _prepared(spark, d):
    return zones.prepared(zones.merged(_tables(spark, d), "zone"), [("balance", "n", 2.0, True), ("supply", "m", 1.0, False)], 4, 0.5)


RANKED = """ra AS (SELECT c_nationkey AS zone, avg(c_acctbal) AS score, row_number() OVER (ORDER BY avg(c_acctbal) DESC NULLS LAST, c_nationkey) AS rank FROM customer GROUP BY 1),
rb AS (SELECT c_nationkey AS zone, median(c_acctbal) AS score, row_number() OVER (ORDER BY median(c_acctbal) DESC NULLS LAST, c_nationkey) AS rank FROM customer GROUP BY 1)"""


def _ranked(spark, d):
    by = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone"))
    return [ranking.ranked(by.agg(f("c_acctbal").alias("score")), "score", "zone", 8) for f in (F.avg, F.median)]


@query(f"WITH {RANKED} SELECT zone, left_rank::INTEGER AS left_rank, right_rank::INTEGER AS right_rank, shift::INTEGER AS shift, size::INTEGER AS size FROM (SELECT ra.zone, ra.rank AS left_rank, rb.rank AS right_rank, rb.rank - ra.rank AS shift, abs(rb.rank - ra.rank) AS size FROM ra JOIN rb ON ra.zone = rb.zone) ORDER BY size DESC, zone LIMIT 6")
def rank_shifts(spark, d):
    """The six zones that move most between two rankings; a top-k report."""
    a, b = _ranked(spark, d)
    return zones.shifts(a, b, "zone", "rank", "rank", 6)


@query(f"""WITH {RANKED}, j AS (SELECT ra.zone, ra.rank AS a, rb.rank AS b FROM ra JOIN rb ON ra.zone = rb.zone), t AS (SELECT sum(sign(y.b - x.b)) / count(*)::DOUBLE AS tau FROM j x JOIN j y ON x.a < y.a)
SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS rho, round(any_value(tau), 6) AS tau, count(*) FILTER (a <= 8 AND b <= 8)::BIGINT AS common_top, round(count(*) FILTER (a <= 8 AND b <= 8) / (count(*) FILTER (a <= 8 OR b <= 8))::DOUBLE, 6) AS jaccard FROM j, t""")
def ranking_agreement(spark, d):
    """Correlations and common top of two rankings."""
    a, b = _ranked(spark, d)
    return zones.agreement_of(a, b, "zone", "rank", "rank", 8).select("n", r6("rho"), r6("tau"), "common_top", r6("jaccard"))


@query(f"WITH {RANKED}, m AS (SELECT min(score) AS low FROM ra WHERE rank <= 8), h AS (SELECT max(score) AS high FROM ra WHERE rank > 8) SELECT 8::BIGINT AS n_top, (SELECT count(*) FROM ra)::BIGINT AS n_eligible, round(low - high, 6) AS gap, (SELECT count(*) FROM ra, m WHERE rank > 8 AND score >= low - 1e-12)::BIGINT AS tied FROM m, h")
def priority_cut(spark, d):
    """What happens at the cut of a ranking's first eight."""
    return zones.at_the_cut(_ranked(spark, d)[0], "score").select("n_top", "n_eligible", r6("gap"), "tied")


@query(f"WITH {RANKED} SELECT zone, rank::INTEGER AS rank FROM ra WHERE score IS NOT NULL AND zone <> 3 ORDER BY rank LIMIT 5")
def top_priority(spark, d):
    """The first five zones without those whose status is left out; a top-k report."""
    a = _ranked(spark, d)[0].withColumn("status", F.when(F.col("zone") == 3, zones.INSUFFICIENT).otherwise(zones.SCORED))
    return zones.top_zones(a, "rank", "score", 5, "status", [zones.INSUFFICIENT]).select("zone", "rank")


WIDE = f"""WITH {YEARLY}, w AS (SELECT year, avg(price) FILTER (sensor = '1-URGENT') AS ui, count(*) FILTER (sensor = '1-URGENT') AS nu, avg(price) FILTER (sensor = '5-LOW') AS lo, count(*) FILTER (sensor = '5-LOW') AS nl, avg(price) FILTER (sensor = '2-HIGH') AS hi, count(*) FILTER (sensor = '2-HIGH') AS nh FROM y GROUP BY year),
l AS (SELECT year, 'low' AS definition, ui AS inside_mean, lo AS outside_mean, nu AS inside_count, nl AS outside_count FROM w UNION ALL SELECT year, 'high', ui, hi, nu, nh FROM w)"""


def _wide(spark, d):
    mean = lambda s: F.avg(F.when(F.col("sensor") == s, F.col("price")))
    count = lambda s: F.count_if(F.col("sensor") == s)
    out = yearly_orders(spark, d).groupBy("year").agg(*[f(s).alias(f"{name}_{side}_{what}") for name, other in (("low", "5-LOW"), ("high", "2-HIGH")) for side, s in (("inside", "1-URGENT"), ("outside", other)) for what, f in (("mean", mean), ("count", count))])
    return zones.long_contrast(out, ["year"], ["low", "high"])


@query(f"{WIDE} SELECT year, definition, round(inside_mean, 4) AS inside_mean, round(outside_mean, 4) AS outside_mean, round(inside_mean - outside_mean, 4) AS difference, inside_count::BIGINT AS inside_count, outside_count::BIGINT AS outside_count FROM l")
def contrast_long(spark, d):
    """Wide contrasts of two definitions made long."""
    return _wide(spark, d).select("year", "definition", *[F.round(c, 4).alias(c) for c in ("inside_mean", "outside_mean", "difference")], "inside_count", "outside_count")


@query(f"{WIDE}, k AS (SELECT year, definition, inside_mean - outside_mean AS difference, 'orders' AS source FROM l UNION ALL SELECT year + 100, definition, 2 * (inside_mean - outside_mean), 'doubled' FROM l) SELECT source, year::INTEGER AS year, definition, round(difference, 4) AS difference FROM k")
def contrast_all_sources(spark, d):
    """Contrasts of several sources in one table."""
    one = _wide(spark, d).select("year", "definition", "difference")
    two = one.select((F.col("year") + 100).alias("year"), "definition", (2 * F.col("difference")).alias("difference"))
    return zones.stacked([("orders", one), ("doubled", two)], "source").select("source", "year", "definition", F.round("difference", 4).alias("difference"))


@query(f"WITH {YEARLY}, k AS (SELECT g::INTEGER AS year FROM generate_series(1990, 2004) t(g)) SELECT k.year, count(*) FILTER (sensor = '1-URGENT')::BIGINT AS \"1-URGENT\", count(*) FILTER (sensor = '3-MEDIUM')::BIGINT AS \"3-MEDIUM\", count(*) FILTER (sensor IN ('1-URGENT', '3-MEDIUM'))::BIGINT AS total FROM k LEFT JOIN y ON y.year = k.year GROUP BY k.year")
def inventory_years(spark, d):
    """Counts by year and sensor, empty years included."""
    return zones.inventory(yearly_orders(spark, d), "year", "sensor", ["1-URGENT", "3-MEDIUM"], 1990, 2004)


@query(f"""{SERIES}, t AS (SELECT zone, year, v, v - lag(v) OVER (PARTITION BY zone ORDER BY year) AS change FROM s)
SELECT zone, year, round(change, 4) AS change, count(*) FILTER (change > 0) OVER (PARTITION BY zone) = 0 OR count(*) FILTER (change < 0) OVER (PARTITION BY zone) = 0 AS monotonic, coalesce(abs(change) = max(abs(change)) OVER (PARTITION BY zone), false) AS largest FROM t""")
def yearly_steps(spark, d):
    """Change from year to year by nation, whether it never turns, and the largest step."""
    return zones.steps_between(series(spark, d), ["zone"], "year", "v").select("zone", "year", F.round("change", 4).alias("change"), "monotonic", "largest")


@query("""SELECT * FROM (SELECT 'l_discount' AS predictor, round(corr(l_discount, l_extendedprice), 6) AS r, count(*)::BIGINT AS n FROM lineitem UNION ALL SELECT 'l_quantity', round(corr(l_quantity, l_extendedprice), 6), count(*) FROM lineitem)""")
def driver_correlations(spark, d):
    """Correlation of prices with two drivers."""
    return zones.correlations(table(spark, d, "lineitem"), "l_extendedprice", ["l_discount", "l_quantity"]).select("predictor", r6("r"), "n")


@query("""WITH f AS (SELECT 'low' AS field, l_orderkey & 3 AS code FROM lineitem UNION ALL SELECT 'high', (l_orderkey >> 4) & 7 FROM lineitem), k AS (SELECT 'low' AS field, g::INTEGER AS code FROM generate_series(0, 3) t(g) UNION ALL SELECT 'high', g::INTEGER FROM generate_series(0, 7) t(g))
SELECT k.field, k.code, count(f.code)::BIGINT AS n, round(count(f.code) / greatest(1, sum(count(f.code)) OVER (PARTITION BY k.field))::DOUBLE, 6) AS share FROM k LEFT JOIN f ON f.field = k.field AND f.code = k.code GROUP BY k.field, k.code""")
def quality_fields(spark, d):
    """Counts and shares of all codes of two bit fields in one pass."""
    key = F.col("l_orderkey")
    out = zones.quality_share(table(spark, d, "lineitem"), [("low", key.bitwiseAND(F.lit(3)), range(4)), ("high", F.shiftright(key, 4).bitwiseAND(F.lit(7)), range(8))])
    return out.select("field", "code", "n", r6("share"))


@query(f"WITH {YEARLY}, m AS (SELECT min(year) AS f FROM y) SELECT zone, (f + (year - f) // 3 * 3)::INTEGER AS bin, round(avg(price), 2) AS value FROM y, m GROUP BY ALL")
def space_time_bins(spark, d):
    """Means by nation over bins of three years from the first year on."""
    return significance.bins(yearly_orders(spark, d), "zone", "year", "price", 3).select("zone", "bin", F.round("value", 2).alias("value"))


@query("""WITH k AS (SELECT c_custkey, (c_custkey * 37 % 1000) / 1000::DOUBLE * 0.15::DOUBLE AS p, c_acctbal AS z FROM customer) SELECT c_custkey, CASE WHEN z > 0 AND p <= 0.01::DOUBLE THEN 'hot_99' WHEN z > 0 AND p <= 0.05::DOUBLE THEN 'hot_95' WHEN z > 0 AND p <= 0.10::DOUBLE THEN 'hot_90'
WHEN z < 0 AND p <= 0.01::DOUBLE THEN 'cold_99' WHEN z < 0 AND p <= 0.05::DOUBLE THEN 'cold_95' WHEN z < 0 AND p <= 0.10::DOUBLE THEN 'cold_90' ELSE 'not_significant' END AS confidence FROM k""")
def confidence_classes(spark, d):
    """Hot and cold classes by adjusted p and sign."""
    p = F.col("c_custkey") * 37 % 1000 / 1000.0 * 0.15
    return table(spark, d, "customer").select("c_custkey", zones.confidence_class(p, F.col("c_acctbal")).alias("confidence"))


@query(f"{SERIES}, p AS (SELECT a.zone, sum(sign(b.v - a.v))::DOUBLE AS s, count(*)::DOUBLE AS m FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone), k AS (SELECT zone, count(*)::DOUBLE AS n FROM s GROUP BY zone) SELECT k.zone, s, round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END, 6) AS z FROM k JOIN p ON k.zone = p.zone WHERE n >= 3")
def tests_from_tau(spark, d):
    """S and Z of trends, from tau and the number of years alone."""
    s = series(spark, d)
    tau = trends.kendall_tau(s, ["zone"], "year", "v").join(s.groupBy("zone").agg(F.count("*").cast("double").alias("n")), "zone").where("n >= 3")
    return tau.select("zone", rules.s_from_tau(F.col("tau"), F.col("n")).alias("s"), F.round(rules.z_from_tau(F.col("tau"), F.col("n")), 6).alias("z"))


@query(f"WITH {YEARLY}, q AS (SELECT c_nationkey AS zone, year(o_orderdate)::INTEGER AS year, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE month(o_orderdate) IN (1, 2, 3)), k AS (SELECT DISTINCT zone, year FROM y) SELECT k.zone, k.year, round(median(price), 4) AS median, count(price)::BIGINT AS n_obs FROM k LEFT JOIN q ON q.zone = k.zone AND q.year = k.year GROUP BY ALL")
def dry_season_composite(spark, d):
    """Medians of January to March by nation and year; years without such orders stay."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_nationkey").alias("zone"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").alias("price"))
    out = aggregates.composite(rows.where(F.col("month").isin(1, 2, 3)), ["zone", "year"], "price", rows.select("zone", "year").distinct())
    return out.select("zone", "year", F.round("median", 4).alias("median"), "n_obs")


@query(f"""{SERIES}, p AS (SELECT a.zone, median((b.v - a.v) / (b.year - a.year)) AS slope FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone)
SELECT n_regionkey, round(avg(slope), 4) AS mean, round(stddev_pop(slope), 4) AS sd, count(*)::BIGINT AS n_obs, count(*) < 6 AS below_floor FROM p JOIN nation ON n_nationkey = zone GROUP BY 1""")
def trend_by_class(spark, d):
    """Slopes of nations by region, thin classes flagged."""
    slopes = trends.sen_slope(series(spark, d), ["zone"], "year", "v")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), "n_regionkey")
    out = aggregates.stratified(slopes.join(nations, "zone"), ["n_regionkey"], "slope", 6)
    return out.select("n_regionkey", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n_obs", "below_floor")


@query(f"""{MK}, v AS (SELECT *, {NORMAL_P.format(z='z')} AS p FROM m), o AS (SELECT *, count(p) OVER (ORDER BY p) AS k, count(p) OVER () AS c FROM v),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1::DOUBLE, min(p * c / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM o)
SELECT zone, n, s, round(z, 6) AS z, round(p, 9) AS p, round(q, 6) AS p_adjusted, coalesce(q <= 0.05, false) AS significant FROM q""")
def zonal_trends(spark, d):
    """Mann-Kendall of nations with p adjusted across them."""
    tests = trends.mann_kendall(series(spark, d), ["zone"], "year", "v").withColumn("p", trends.two_sided_p("z"))
    return significance.trend_table(tests, "zone", "p").select("zone", "n", "s", r6("z"), F.round("p", 9).alias("p"), r6("p_adjusted"), "significant")


def _near(spark, d):
    return graph.contiguity(table(spark, d, "nation"), "n_nationkey", "n_regionkey").groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("near")).withColumnRenamed("i", "zone")


#: Draws of the zones of a year (s: zone, year, v) and what both permutation queries take from them.
DRAWS = """e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
z AS (SELECT zone, year, v - avg(v) OVER y AS dev, CASE WHEN count(*) OVER y >= 3 THEN (v - avg(v) OVER y) / nullif(stddev_pop(v) OVER y, 0) END AS z, stddev_pop(v) OVER y AS sd, count(*) OVER y AS n FROM s WINDOW y AS (PARTITION BY year)),
k AS (SELECT z.*, coalesce(q.total, CASE WHEN z.z IS NOT NULL THEN 0 END) AS total, coalesce(q.k, 0) AS k FROM z LEFT JOIN (SELECT a.year, e.i, sum(b.z) AS total, count(*) AS k FROM e JOIN z a ON a.zone = e.i JOIN z b ON b.zone = e.j AND b.year = a.year GROUP BY ALL) q ON q.year = z.year AND q.i = z.zone),
d AS (SELECT k.*, d, row_number() OVER (PARTITION BY year, d ORDER BY md5('42:' || d || ':' || zone), zone) AS r FROM k, range(1, 100) x(d)),
p AS (SELECT year, d, r, sum(z) OVER (PARTITION BY year, d ORDER BY r ROWS UNBOUNDED PRECEDING) AS p FROM d),
c AS (SELECT d.year, d.zone, d.z, d.total, p.p - CASE WHEN d.r <= k THEN d.z ELSE 0 END AS drawn FROM d JOIN p ON p.year = d.year AND p.d = d.d AND p.r = k + (d.r <= k)::INTEGER WHERE k > 0 AND z IS NOT NULL)"""
#: Benjamini-Hochberg over the zones of a year (f: zone, year, p_sim and others).
ADJUSTED = """o AS (SELECT *, p_sim * count(*) OVER (PARTITION BY year, p_sim IS NULL) / row_number() OVER (PARTITION BY year, p_sim IS NULL ORDER BY p_sim, zone) AS step FROM f),
a AS (SELECT *, CASE WHEN p_sim IS NOT NULL THEN least(1::DOUBLE, min(step) OVER (PARTITION BY year, p_sim IS NULL ORDER BY p_sim, zone ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM o)"""


@query(f"""{SERIES}, {DRAWS}, l AS (SELECT year, zone, count(*) FILTER (round(z * drawn, 9) >= round(z * total, 9)) AS l FROM c GROUP BY ALL),
f AS (SELECT k.*, CASE WHEN k > 0 THEN z * total / k WHEN z IS NOT NULL THEN 0 END AS local_i, CASE WHEN z IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE (least(l, 99 - l) + 1) / 100.0::DOUBLE END AS p_sim, coalesce(CASE WHEN k > 0 THEN total / k * sd END, 0) AS lag FROM k LEFT JOIN l ON l.year = k.year AND l.zone = k.zone),
{ADJUSTED}, b AS (SELECT *, coalesce(q <= 0.05, false) AS significant, CASE WHEN dev > 0 AND lag > 0 THEN 1 WHEN dev <= 0 AND lag > 0 THEN 2 WHEN dev <= 0 AND lag <= 0 THEN 3 ELSE 4 END AS quadrant FROM a)
SELECT year, zone, round(local_i, 6) AS local_i, round(lag, 6) AS lag, p_sim, round(q, 6) AS p_adjusted, significant, quadrant::INTEGER AS quadrant, CASE WHEN significant THEN ['high_high', 'low_high', 'low_low', 'high_low'][quadrant] ELSE 'not_significant' END AS cluster FROM b""")
def local_significance(spark, d):
    """Local Moran of yearly mean prices with conditional permutations, adjusted p and clusters."""
    out = significance.local_moran(series(spark, d).join(_near(spark, d), "zone"), ["year"], "zone", "v", "near", 99)
    return out.select("year", "zone", r6("local_i"), r6("lag"), "p_sim", r6("p_adjusted"), "significant", "quadrant", "cluster")


@query(f"""WITH {YEARLY}, s0 AS (SELECT zone, year, avg(price) AS v FROM y GROUP BY zone, year), s AS (SELECT * FROM s0 WHERE year IN (SELECT year FROM s0 GROUP BY year HAVING count(v) = (SELECT count(DISTINCT zone) FROM s0))), {DRAWS},
l AS (SELECT year, zone, count(*) FILTER (round(drawn, 9) >= round(total, 9)) AS l FROM c GROUP BY ALL),
g AS (SELECT k.*, (total + z) / nullif(sqrt((n * (k + 1) - (k + 1) * (k + 1)) / (n - 1)::DOUBLE), 0) AS gi_z, l FROM k LEFT JOIN l ON l.year = k.year AND l.zone = k.zone),
f AS (SELECT *, CASE WHEN gi_z IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE (least(l, 99 - l) + 1) / 100.0::DOUBLE END AS p_sim FROM g), {ADJUSTED}
SELECT year, zone, round(gi_z, 6) AS gi_z, p_sim, round(q, 6) AS p_adjusted, coalesce(q <= 0.05, false) AS significant,
CASE WHEN gi_z > 0 AND q <= 0.01 THEN 'hot_99' WHEN gi_z > 0 AND q <= 0.05 THEN 'hot_95' WHEN gi_z > 0 AND q <= 0.10 THEN 'hot_90' WHEN gi_z < 0 AND q <= 0.01 THEN 'cold_99' WHEN gi_z < 0 AND q <= 0.05 THEN 'cold_95' WHEN gi_z < 0 AND q <= 0.10 THEN 'cold_90' ELSE 'not_significant' END AS confidence FROM a""")
def gi_panel(spark, d):
    """Gi* of every year in which all nations have a price, with significance and classes."""
    out = significance.gi_star_panel(series(spark, d), "zone", "year", "v", _near(spark, d))
    return out.select("year", "zone", r6("gi_z"), "p_sim", r6("p_adjusted"), "significant", "confidence")


# --- land change -----------------------------------------------------------------

CHANGED = "m AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_size % 4 AS before, (p_size + (p_partkey % 7 = 0)::INTEGER) % 4 AS truth, (p_size + (p_partkey % 5 = 0)::INTEGER) % 4 AS guess, p_retailprice AS x, (p_size % 10)::DOUBLE AS y FROM part)"


def _changed(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    moved = lambda n: ((s + (k % n == 0).cast("int")) % 4)
    return table(spark, d, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), (s % 4).alias("before"), moved(7).alias("truth"), moved(5).alias("guess"), F.col("p_retailprice").alias("x"), (s % 10).cast("double").alias("y"))


def _kappa(a: str, b: str) -> str:
    return f"(SELECT (o - e) / (1 - e) FROM (SELECT avg(({a} = {b})::INTEGER) AS o FROM m), (SELECT sum(p * q) AS e FROM (SELECT {a} AS k, count(*) / (SELECT count(*) FROM m)::DOUBLE AS p FROM m GROUP BY 1) JOIN (SELECT {b} AS k, count(*) / (SELECT count(*) FROM m)::DOUBLE AS q FROM m GROUP BY 1) USING (k)))"


@query(f"""WITH {CHANGED}, v AS (SELECT {_kappa('truth', 'guess')} AS kappa, {_kappa('truth', 'before')} AS null_kappa),
h AS (SELECT count(*) FILTER (truth <> before AND guess = truth) / (count(*) FILTER (truth <> before OR guess <> before))::DOUBLE AS merit FROM m)
SELECT round(kappa, 6) AS kappa, round(null_kappa, 6) AS persistence_kappa, round(kappa - null_kappa, 6) AS above_null, round(merit, 6) AS merit FROM v, h""")
def validated_projection(spark, d):
    """Kappa of a projection beside that of the map without change, and the figure of merit."""
    return prediction.validated(_changed(spark, d), "before", "truth", "guess").select(r6("kappa"), r6("persistence_kappa"), r6("above_null"), r6("merit"))


@query(f"WITH {CHANGED} SELECT count(*)::BIGINT AS n_total, count(*) FILTER (before <> 3 AND truth <> 3)::BIGINT AS n_scored, count(*) FILTER (before = 3 OR truth = 3)::BIGINT AS n_excluded, round(count(*) FILTER (before = 3 OR truth = 3) / count(*)::DOUBLE, 6) AS excluded_share FROM m WHERE col < 40")
def scoring_mask(spark, d):
    """Cells left out of the score as immutable in either map."""
    return prediction.mask_report(_changed(spark, d), ["before", "truth"], [3], F.col("col") < 40).select("n_total", "n_scored", "n_excluded", r6("excluded_share"))


PROFILE = "p AS (SELECT before, median(x) AS mx, median(y) AS my FROM m WHERE before < 3 GROUP BY before)"


def _profile(spark, d):
    return _changed(spark, d).where("before < 3").groupBy("before").agg(F.median("x").alias("x"), F.median("y").alias("y"))


@query(f"WITH {CHANGED}, {PROFILE} SELECT row, col, round(mx, 4) AS x, round(my, 4) AS y FROM m LEFT JOIN p ON m.before = p.before")
def painted_predictors(spark, d):
    """Predictors replaced by their class's profile; a class without one has nulls."""
    return prediction.painted(_changed(spark, d), "before", _profile(spark, d), ["x", "y"]).select("row", "col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {CHANGED}, {PROFILE}, t AS (SELECT mx, my FROM p WHERE before = 1) SELECT row, col, round(CASE WHEN before <> 3 AND col < 20 THEN x * 0.7::DOUBLE + mx * 0.3::DOUBLE ELSE x END, 4) AS x, round(CASE WHEN before <> 3 AND col < 20 THEN y * 0.7::DOUBLE + my * 0.3::DOUBLE ELSE y END, 4) AS y FROM m, t")
def shifted_predictors(spark, d):
    """Predictors of eligible cells moved towards a class's profile."""
    out = prediction.shifted(_changed(spark, d), "before", (F.col("before") != 3) & (F.col("col") < 20), _profile(spark, d), 1, 0.3, ["x", "y"])
    return out.select("row", "col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"WITH {CHANGED}, f AS (SELECT *, CASE WHEN col % 11 <> 0 THEN y / 9 END AS f FROM m) SELECT count(*) FILTER (f >= 0.5)::BIGINT AS dominant, count(*) FILTER (guess = 1)::BIGINT AS built, (count(*) FILTER (guess = 1) - count(*) FILTER (f >= 0.5))::BIGINT AS difference, round(avg(((f >= 0.5) = (guess = 1))::INTEGER) FILTER (f IS NOT NULL), 6) AS agreement, round(count(*) FILTER (f >= 0.5) * 0.01::DOUBLE, 6) AS dominant_km2, round(count(*) FILTER (guess = 1) * 0.01::DOUBLE, 6) AS built_km2 FROM f")
def built_cross_check(spark, d):
    """A projected class against an independent built fraction."""
    rows = _changed(spark, d).withColumn("f", F.when(F.col("col") % 11 != 0, F.col("y") / 9))
    return prediction.cross_check(rows, "f", "guess", 1, 0.5, 0.01).select("dominant", "built", "difference", r6("agreement"), r6("dominant_km2"), r6("built_km2"))


@query(f"WITH {CHANGED}, k AS (SELECT row // 4 AS row, col // 4 AS col, CASE WHEN col % 3 <> 0 THEN before END AS code FROM m), n AS (SELECT row, col, code, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT row, col, arg_min(code, struct_pack(m := -n, c := code)) FILTER (code IS NOT NULL) AS code, sum(n) FILTER (code IS NOT NULL) / sum(n)::DOUBLE AS coverage FROM n GROUP BY row, col) SELECT row, col, CASE WHEN coalesce(coverage, 0) >= 0.6 THEN code END AS code, round(coalesce(coverage, 0), 6) AS coverage FROM g")
def modal_grid(spark, d):
    """The most frequent class of coarser cells that are known well enough."""
    rows = _changed(spark, d).withColumn("code", F.when(F.col("col") % 3 != 0, F.col("before")))
    return prediction.modal_grid(rows, "code", 4, 0.6).select("row", "col", "code", r6("coverage"))


@query("""WITH a AS (SELECT n_name AS predictor, n_nationkey % 7 AS importance FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS predictor, n_nationkey * 3 % 11 AS importance FROM nation WHERE n_nationkey > 4),
x AS (SELECT predictor, importance, row_number() OVER (ORDER BY importance DESC, predictor) AS k FROM a), y AS (SELECT predictor, importance, row_number() OVER (ORDER BY importance DESC, predictor) AS k FROM b)
SELECT coalesce(x.predictor, y.predictor) AS predictor, x.importance AS a_importance, x.k::INTEGER AS a_rank, y.importance AS b_importance, y.k::INTEGER AS b_rank, (x.k - y.k)::INTEGER AS difference FROM x FULL JOIN y ON x.predictor = y.predictor""")
def compared_importance(spark, d):
    """Two importance tables side by side."""
    n = table(spark, d, "nation")
    one = lambda rows, value: rows.select(F.col("n_name").alias("predictor"), value.alias("importance"))
    return prediction.compared_importance(one(n.where("n_nationkey < 20"), F.col("n_nationkey") % 7), one(n.where("n_nationkey > 4"), F.col("n_nationkey") * 3 % 11))


@query()
def projected_map(spark, d):
    """A map two intervals on: shares of change, projected areas, allocation by neighbourhood; an iterative method."""
    return prediction.projected(_changed(spark, d), "before", "truth", [0, 1, 2, 3], 2).groupBy("code").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


# --- masks -----------------------------------------------------------------------

SIDES = f"""{CELLS}, t AS (SELECT a.row, a.col, sqrt(min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))) AS dist FROM c a JOIN c b ON b.code = 3 AND b.col % 9 = 0 GROUP BY a.row, a.col),
m AS (SELECT c.row, c.col, c.code = 3 AND c.col % 9 = 0 AS zone, dist, 1 + (c.row * 7 + c.col * 3) % 17 AS lcz, (c.row + c.col) % 13 = 0 AS wet, (c.row * 5 + c.col) % 100 AS height FROM c JOIN t ON c.row = t.row AND c.col = t.col)"""


@query(f"""WITH {SIDES} SELECT row, col, zone AND NOT wet AS ring_urban, dist > 1.5::DOUBLE AND dist <= 5 AND NOT wet AND NOT lcz BETWEEN 1 AND 10 AND height <= 60 AS ring_rural, lcz BETWEEN 1 AND 10 AND NOT wet AS climate_urban, lcz BETWEEN 11 AND 14 AND NOT wet AND height <= 60 AS climate_rural FROM m""")
def contrast_masks(spark, d):
    """Both sides of two definitions of the surroundings, by cell."""
    c = cells(spark, d)
    base = (F.col("code") == 3) & (F.col("col") % 9 == 0)
    far = spatial.nearest_target(c, c.where(base))
    m = c.join(far, ["row", "col"]).select("row", "col", base.alias("zone"), "distance", (1 + (F.col("row") * 7 + F.col("col") * 3) % 17).alias("lcz"), ((F.col("row") + F.col("col")) % 13 == 0).alias("wet"), ((F.col("row") * 5 + F.col("col")) % 100).alias("height"))
    out = {}
    for method in ("ring", "climate"):
        urban, rural = masks.contrast_sides(method, F.col("zone"), F.col("distance"), F.col("lcz"), F.col("wet"), F.col("height"), (1.5, 5.0), range(1, 11), range(11, 15), 60)
        out |= {f"{method}_urban": urban, f"{method}_rural": rural}
    return m.select("row", "col", *[v.alias(k) for k, v in out.items()])


@query("""WITH s AS (SELECT l_partkey AS cell, median(l_extendedprice) AS g, median(l_quantity * 1000) AS i, avg((l_linenumber = 1)::INTEGER) AS f FROM lineitem GROUP BY 1), o AS (SELECT p_partkey AS cell, p_size * 2 AS occurrence FROM part WHERE p_size > 5)
SELECT s.cell, coalesce((g - i) / nullif(g + i, 0) > 0.28::DOUBLE, false) OR coalesce(f > 0.4::DOUBLE, false) OR coalesce(occurrence >= 95, false) AS water FROM s LEFT JOIN o ON s.cell = o.cell""")
def water_cells(spark, d):
    """Water by an index of medians, a share of wet looks, or long-run occurrence."""
    scenes = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), "l_extendedprice", (F.col("l_quantity") * 1000).alias("infrared"), (F.col("l_linenumber") == 1).cast("int").alias("flag"))
    seen = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("cell"), (F.col("p_size") * 2).alias("occurrence"))
    return masks.watered(scenes, ["cell"], "l_extendedprice", "infrared", "flag", seen, (0.28, 0.4, 95))


@query(f"""WITH {CELLS}, h AS (SELECT row, col, col // 10 AS zone FROM c WHERE code = 1), n AS (SELECT h.row, h.col, h.zone, count(t.row) AS trees FROM h LEFT JOIN c t ON t.code = 2 AND (h.row - t.row) * (h.row - t.row) + (h.col - t.col) * (h.col - t.col) <= 4 GROUP BY ALL)
SELECT zone, count(*)::BIGINT AS homes, count(*) FILTER (trees >= 3)::BIGINT AS seen, round(100 * count(*) FILTER (trees >= 3) / count(*)::DOUBLE, 6) AS percent FROM n GROUP BY zone""")
def trees_in_sight(spark, d):
    """Homes with three trees or more within two cells, by zone."""
    rows = cells(spark, d).withColumn("zone", F.floor(F.col("col") / 10))
    return masks.trees_in_sight(rows, F.col("code") == 2, F.col("code") == 1, 2, 3).select("zone", "homes", "seen", r6("percent"))
