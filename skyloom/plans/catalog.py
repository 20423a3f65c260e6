"""The library's queries over the driver's tables, each with its SQL twin.

Zones are nations or customers, years those of order dates, sensors order
priorities, cells parts laid out on a grid of fifty columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import scalar
from skyloom.operators import aggregates, agreement, draws, graph, grids, inference, landscape, ranking, spacetime, trends, windows
from skyloom.plans import models
from skyloom.sources.tables import table
from skyloom.streaming import windows as event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(name: str):
    """A double column rounded to six digits."""
    return F.round(F.col(name), 6).alias(name)


def yearly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their nation and year: zone, year, price, sensor."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return rows.select(F.col("c_nationkey").alias("zone"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("sensor"))


YEARLY = "y AS (SELECT c_nationkey AS zone, year(o_orderdate)::INTEGER AS year, o_totalprice AS price, o_orderpriority AS sensor FROM orders JOIN customer ON o_custkey = c_custkey)"
SERIES = f"WITH {YEARLY}, s AS (SELECT zone, year, avg(price) AS v, count(*) AS n FROM y GROUP BY zone, year)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by nation and year."""
    return yearly_orders(spark, sf_dir).groupBy("zone", "year").agg(F.avg("price").alias("v"), F.count("*").alias("n"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: row, col, code."""
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).alias("row"), (F.col("p_partkey") % 50).alias("col"), (F.col("p_size") % 4).alias("code"))


CELLS = "c AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_size % 4 AS code FROM part)"


# --- masks, scaling, indices -------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey & 3) = 0 AND l_linenumber - 1 = 0 THEN l_extendedprice END AS price FROM lineitem""")
def qa_bitmask_filter(spark, d):
    """Prices where the quality bits are clear and nothing is saturated; other rows stay, with null."""
    keep = scalar.is_clear(F.col("l_orderkey"), 2, F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.masked(F.col("l_extendedprice"), keep).alias("price"))


@query("""SELECT k.code::INTEGER AS code, count(l_orderkey)::BIGINT AS n FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS code) k LEFT JOIN lineitem ON ((l_orderkey >> 2) & 3) = k.code GROUP BY 1""")
def qc_class_histogram(spark, d):
    """Counts of a two-bit quality field, codes that never come included."""
    return aggregates.histogram(table(spark, d, "lineitem"), scalar.bit_field(F.col("l_orderkey"), 2, 2), range(8))


@query("""SELECT ((l_orderkey & 3) <= 1 AND ((l_orderkey >> 2) & 3) <= 2) AS good, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def qc_ceiling(spark, d):
    """Rows whose quality fields keep their ceilings."""
    good = scalar.within_ceiling(F.col("l_orderkey"), [(0, 2, 1), (2, 2, 2)])
    return table(spark, d, "lineitem").groupBy(good.alias("good")).agg(F.count("*").alias("n"))


@query("""SELECT bit_count(o_orderkey & 255)::INTEGER AS clear_days, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def clear_sky_popcount(spark, d):
    """Orders by the number of set bits of their day mask."""
    return table(spark, d, "orders").groupBy(scalar.clear_count(F.col("o_orderkey"), 8).alias("clear_days")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice BETWEEN 1000 AND 60000 AND l_extendedprice * 0.002::DOUBLE + -5::DOUBLE BETWEEN 0 AND 80 THEN l_extendedprice * 0.002::DOUBLE + -5::DOUBLE END, 6) AS celsius FROM lineitem""")
def scale_and_mask(spark, d):
    """Raw prices scaled within inclusive ranges of raw and scaled values."""
    out = scalar.scaled(F.col("l_extendedprice"), 0.002, -5.0, (1000.0, 60000.0), (0.0, 80.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(out, 6).alias("celsius"))


@query("""SELECT l_orderkey, l_linenumber,
round((l_quantity - l_tax) / nullif(l_quantity + l_tax, 0), 6) AS ndvi,
round(2.5::DOUBLE * (l_quantity - l_discount) / nullif(l_quantity + 6::DOUBLE * l_discount - 7.5::DOUBLE * l_tax + 1, 0), 6) AS evi,
round((l_quantity - l_discount) * 1.5::DOUBLE / nullif(l_quantity + l_discount + 0.5::DOUBLE, 0), 6) AS savi,
round(-0.0018::DOUBLE + l_tax * 0.356::DOUBLE + l_discount * 0.13::DOUBLE, 6) AS albedo FROM lineitem""")
def spectral_indices(spark, d):
    """Normalized difference, enhanced and soil-adjusted vegetation, albedo."""
    q, t, i = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scalar.normalized_difference(q, t), 6).alias("ndvi"), F.round(scalar.enhanced_vegetation(q, i, t), 6).alias("evi"),
        F.round(scalar.soil_adjusted(q, i), 6).alias("savi"), F.round(scalar.weighted_sum([(t, 0.356), (i, 0.13)], -0.0018), 6).alias("albedo"))


SEASONS = {"northeast": (12, 1, 2), "first_inter": (3, 4), "southwest": (5, 6, 7, 8, 9), "second_inter": (10, 11)}


@query("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'northeast' WHEN month(o_orderdate) IN (3, 4) THEN 'first_inter' WHEN month(o_orderdate) IN (10, 11) THEN 'second_inter' ELSE 'southwest' END AS season, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def season_tag(spark, d):
    """Orders by season."""
    return table(spark, d, "orders").groupBy(scalar.season(F.month("o_orderdate"), SEASONS).alias("season")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("""SELECT sensor, year, count(*)::BIGINT AS n, round(avg(v), 4) AS mean FROM (
SELECT 'orders' AS sensor, year(o_orderdate)::INTEGER AS year, o_totalprice AS v FROM orders UNION ALL SELECT 'items', year(l_shipdate)::INTEGER, l_extendedprice FROM lineitem) GROUP BY ALL""")
def harmonised_union(spark, d):
    """Two sources under common names, stacked and averaged by year."""
    a = table(spark, d, "orders").select(F.lit("orders").alias("sensor"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "lineitem").select(F.lit("items").alias("sensor"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("v"))
    return a.unionByName(b).groupBy("sensor", "year").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query("""SELECT p_brand, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, count(*)::BIGINT AS n FROM part GROUP BY ALL""")
def export_names(spark, d):
    """File-safe names of part types."""
    return table(spark, d, "part").groupBy("p_brand", scalar.slug(F.col("p_type"), 100).alias("slug")).agg(F.count("*").alias("n"))


# --- composites and zonal statistics ----------------------------------------

@query(f"""WITH {YEARLY}, k AS (SELECT n_nationkey AS zone, g::INTEGER AS year FROM nation, generate_series(1992, 2002) t(g))
SELECT k.zone, k.year, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.9), 4) AS p90, round(avg(price), 6) AS mean, count(price)::BIGINT AS n_obs
FROM k LEFT JOIN y ON y.zone = k.zone AND y.year = k.year GROUP BY ALL""")
def annual_composite(spark, d):
    """Median, 90th percentile, mean and count of prices by nation and year; years without orders stay, with count 0."""
    years = F.explode(F.sequence(F.lit(1992), F.lit(2002)))
    spine = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), years.alias("year"))
    out = aggregates.composite(yearly_orders(spark, d), ["zone", "year"], "price", spine)
    return out.select("zone", "year", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), r6("mean"), "n_obs")


@query(f"""WITH {YEARLY} SELECT year, count(*) FILTER (sensor = '1-URGENT')::BIGINT AS urgent, count(*) FILTER (sensor = '2-HIGH')::BIGINT AS high, count(*)::BIGINT AS total FROM y GROUP BY year""")
def scene_inventory(spark, d):
    """Orders by year and two priorities, with a total over all."""
    return aggregates.crosstab(yearly_orders(spark, d), F.col("year"), "sensor", ["1-URGENT", "2-HIGH"], ["urgent", "high"], "year")


@query(f"""WITH {YEARLY} SELECT zone, round(avg(price), 4) AS mean, round(median(price), 4) AS median, round(stddev_pop(price), 4) AS sd, min(price) AS least, max(price) AS most, round(sum(price), 2) AS total, count(price)::BIGINT AS n_obs FROM y GROUP BY zone""")
def zonal_stats(spark, d):
    """All zonal figures of order prices by nation in one pass."""
    out = aggregates.zonal(yearly_orders(spark, d), ["zone"], "price")
    return out.select("zone", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd")], "least", "most", F.round("total", 2).alias("total"), "n_obs")


@query(f"""WITH {YEARLY} SELECT year, round(avg(price) FILTER (sensor = '1-URGENT'), 4) AS inside_mean, round(avg(price) FILTER (sensor = '5-LOW'), 4) AS outside_mean,
round(avg(price) FILTER (sensor = '1-URGENT') - avg(price) FILTER (sensor = '5-LOW'), 4) AS difference, count(*) FILTER (sensor = '1-URGENT')::BIGINT AS inside_n, count(*) FILTER (sensor = '5-LOW')::BIGINT AS outside_n FROM y GROUP BY year""")
def suhii_long(spark, d):
    """Mean of one group less that of another by year, with both counts."""
    out = aggregates.contrast(yearly_orders(spark, d), ["year"], "price", F.col("sensor") == "1-URGENT", F.col("sensor") == "5-LOW")
    return out.select("year", *[F.round(c, 4).alias(c) for c in ("inside_mean", "outside_mean", "difference")], "inside_n", "outside_n")


@query(f"""WITH {YEARLY}, m AS (SELECT year, avg(price) AS mean FROM y GROUP BY year), u AS (SELECT y.year, (price - mean) / nullif(mean, 0) AS x FROM y JOIN m ON y.year = m.year),
c AS (SELECT year, CASE WHEN x < 0 THEN 0 WHEN x < 0.005 THEN 1 WHEN x < 0.010 THEN 2 WHEN x < 0.015 THEN 3 WHEN x < 0.020 THEN 4 WHEN x >= 0.020 THEN 5 END AS class FROM u),
k AS (SELECT year, g::INTEGER AS class FROM (SELECT DISTINCT year FROM c), generate_series(0, 5) t(g))
SELECT k.year, k.class, count(c.class)::BIGINT AS n, round(100 * count(c.class) / nullif(sum(count(c.class)) OVER (PARTITION BY k.year), 0), 6) AS percent FROM k LEFT JOIN c ON c.year = k.year AND c.class = k.class GROUP BY k.year, k.class""")
def utfvi_shares(spark, d):
    """Per cent of the six severity classes by year, (x - mean) / mean against the year's mean; absent classes have 0."""
    rows = yearly_orders(spark, d)
    rows = rows.join(rows.groupBy("year").agg(F.avg("price").alias("mean")), "year")
    rows = rows.withColumn("class", scalar.bucket(scalar.variance_index(F.col("price"), F.col("mean")), (0.0, 0.005, 0.010, 0.015, 0.020)))
    return aggregates.class_percent(rows, ["year"], "class", range(6)).select("year", "class", "n", r6("percent"))


@query("""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) AS z, coalesce((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0) >= 1, false) AS hot FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def zscore_hot(spark, d):
    """Population z-score of balances within nations, and which are hot."""
    out = table(spark, d, "customer").withColumn("z", windows.z_score(F.col("c_acctbal"), ["c_nationkey"]))
    return out.select("c_custkey", r6("z"), F.coalesce(F.col("z") >= 1, F.lit(False)).alias("hot"))


@query("""SELECT p_brand, p_size, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS sd, count(*)::BIGINT AS n_obs, count(*) < 3 AS below_floor FROM part GROUP BY ALL""")
def stratified_stats(spark, d):
    """Prices by brand and size, thin strata flagged."""
    out = aggregates.stratified(table(spark, d, "part"), ["p_brand", "p_size"], "p_retailprice", 3)
    return out.select("p_brand", "p_size", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n_obs", "below_floor")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM n)
SELECT user_id, event_type AS code, n::BIGINT AS n FROM r WHERE k = 1""")
def modal_class(spark, d):
    """Each user's most frequent event type, ties to the first by name."""
    return aggregates.modal(table(spark, d, "events"), ["user_id"], "event_type").select("user_id", "code", F.col("n").cast("long").alias("n"))


@query(f"""WITH {YEARLY} SELECT zone, round(100 * sum(CASE WHEN sensor = '1-URGENT' THEN price ELSE 0 END) / sum(price), 6) AS percent, round(sum(price), 2) AS weight FROM y GROUP BY zone""")
def served_population(spark, d):
    """Per cent of order value that is urgent, by nation."""
    return aggregates.weighted_share(yearly_orders(spark, d), ["zone"], "price", F.col("sensor") == "1-URGENT").select("zone", r6("percent"), F.round("weight", 2).alias("weight"))


@query("""SELECT source, n_chars, count(*)::BIGINT AS n FROM documents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    """Keys that are not unique."""
    return aggregates.duplicates(table(spark, d, "documents"), ["source", "n_chars"])


@query("""SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY md5(concat(c_custkey, ':42')), c_custkey LIMIT 100""")
def seeded_sample(spark, d):
    """A hundred customers by seeded hash; sampling is the feature."""
    return aggregates.seeded_sample(table(spark, d, "customer"), "c_custkey", 100, 42, ["c_acctbal"]).select("c_custkey", "c_acctbal")


# --- trends -------------------------------------------------------------------

@query(f"""{SERIES}, p AS (SELECT a.zone, (b.v - a.v) / (b.year - a.year) AS m FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year),
m AS (SELECT zone, median(m) AS slope FROM p GROUP BY zone)
SELECT s.zone, round(m.slope, 4) AS slope, round(median(s.v - m.slope * s.year), 2) AS intercept, count(*)::BIGINT AS n_years FROM s JOIN m ON s.zone = m.zone GROUP BY s.zone, m.slope""")
def sens_slope(spark, d):
    """Theil-Sen slope of mean prices by nation."""
    out = trends.sen_slope(series(spark, d), ["zone"], "year", "v")
    return out.select("zone", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "n_years")


MK = f"""{SERIES}, p AS (SELECT a.zone, sum(sign(b.v - a.v))::DOUBLE AS s FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone),
k AS (SELECT zone, count(v)::DOUBLE AS n FROM s GROUP BY zone),
r AS (SELECT k.zone, k.n, CASE WHEN n >= 3 THEN coalesce(p.s, 0) END AS s, CASE WHEN n >= 3 THEN n * (n - 1) * (2 * n + 5) / 18 END AS var_s FROM k LEFT JOIN p ON k.zone = p.zone)
SELECT zone, n, s, round(var_s, 6) AS var_s, round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var_s) END, 6) AS z FROM r"""


@query(MK)
def mann_kendall(spark, d):
    """Mann-Kendall S, variance and Z of mean prices by nation."""
    return trends.mann_kendall(series(spark, d), ["zone"], "year", "v").select("zone", "n", "s", r6("var_s"), r6("z"))


#: A macro's worth of SQL: the two-sided normal p of ``{z}``, by the same expansions.
NORMAL_P = """(CASE WHEN abs({z}) / sqrt(2::DOUBLE) < 2.5 THEN 1 - exp(-{z} * {z} / 2) / sqrt(pi()) * list_sum(list_transform(range(1, 61), lambda n: exp((2 * n - 1) * ln(greatest(abs({z}), 1e-300) / sqrt(2::DOUBLE)) + n * ln(2::DOUBLE) - coalesce(list_sum(list_transform(range(1, n), lambda k: ln(2 * k + 1::DOUBLE))), 0))))
ELSE exp(-{z} * {z} / 2) / sqrt(pi()) / list_reduce([abs({z}) / sqrt(2::DOUBLE)] || list_transform(range(60, 0, -1), lambda k: k::DOUBLE), lambda f, k: abs({z}) / sqrt(2::DOUBLE) + k / 2 / f) END)"""
MK = f"""{SERIES}, p AS (SELECT a.zone, sum(sign(b.v - a.v))::DOUBLE AS s FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone), k AS (SELECT zone, count(v)::DOUBLE AS n FROM s GROUP BY zone),
m AS (SELECT k.zone, n, CASE WHEN n >= 3 THEN coalesce(s, 0) END AS s, CASE WHEN n >= 3 THEN CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END END AS z FROM k LEFT JOIN p ON p.zone = k.zone)"""


@query(f"{MK} SELECT zone, round(z, 6) AS z, round({NORMAL_P.format(z='z')}, 9) AS p FROM m")
def mann_kendall_p(spark, d):
    """The same with the two-sided p."""
    return trends.mann_kendall(series(spark, d), ["zone"], "year", "v").withColumn("p", trends.two_sided_p("z")).select("zone", r6("z"), F.round("p", 9).alias("p"))


def _p_values(spark, d):
    """A p-like value in 0 to 1 per customer, some untested."""
    p = F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") * F.col("c_custkey") % 9973 / 9973.0)
    return table(spark, d, "customer").select("c_custkey", p.cast("double").alias("p"), "c_acctbal")


PS = "t AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * c_custkey % 9973 / 9973::DOUBLE END AS p FROM customer)"
STEP = "r AS (SELECT *, row_number() OVER (ORDER BY p, c_custkey) AS k, count(*) OVER () AS m FROM t WHERE p IS NOT NULL)"
BH = f"WITH {PS}, {STEP}, q AS (SELECT *, least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"


@query(f"""{BH} SELECT t.c_custkey, round(q.q, 6) AS q, CASE WHEN q.q IS NULL THEN 'untested' WHEN q.q <= 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM t LEFT JOIN q ON t.c_custkey = q.c_custkey""")
def fdr_bh(spark, d):
    """Benjamini-Hochberg step-up."""
    return windows.step_up(_p_values(spark, d), "p", "c_custkey", 0.05).select("c_custkey", r6("q"), F.when(F.col("q").isNull(), "untested").when(F.col("reject"), "significant").otherwise("not significant").alias("verdict"))


@query(f"""WITH {PS}, {STEP}, h AS (SELECT sum(1::DOUBLE / k) AS h FROM r), q AS (SELECT c_custkey, least(1, min(p * m * h / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r, h)
SELECT t.c_custkey, round(q.q, 6) AS q, CASE WHEN q.q IS NULL THEN 'untested' WHEN q.q <= 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM t LEFT JOIN q ON t.c_custkey = q.c_custkey""")
def fdr_by(spark, d):
    """Benjamini-Yekutieli step-up."""
    return windows.step_up(_p_values(spark, d), "p", "c_custkey", 0.05, True).select("c_custkey", r6("q"), F.when(F.col("q").isNull(), "untested").when(F.col("reject"), "significant").otherwise("not significant").alias("verdict"))


@query(f"""{BH}, a AS (SELECT t.c_acctbal, q.q FROM t LEFT JOIN q ON t.c_custkey = q.c_custkey), s AS (SELECT count(*)::BIGINT AS cells, count(q)::BIGINT AS tested, count(*) FILTER (q <= 0.2)::BIGINT AS significant,
count(*) FILTER (q <= 0.2 AND c_acctbal > 0)::BIGINT AS rises, count(*) FILTER (q <= 0.2 AND c_acctbal < 0)::BIGINT AS falls FROM a) SELECT *, significant / tested::DOUBLE AS share_of_tested, significant / cells::DOUBLE AS share_of_cells FROM s""")
def fdr_summary(spark, d):
    """Significant rises and falls over tested and over all cells."""
    return windows.fdr_summary(windows.step_up(_p_values(spark, d), "p", "c_custkey", 0.2), "q", 0.2, F.col("c_acctbal"))


@query(f"""{SERIES}, x AS (SELECT zone, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'a' WHEN year BETWEEN 1998 AND 2001 THEN 'b' END AS decade, v FROM s),
g AS (SELECT zone, decade, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM x WHERE decade IS NOT NULL GROUP BY ALL)
SELECT a.zone, round(b.mean - a.mean, 4) AS difference, round(sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n), 4) AS se FROM g a JOIN g b ON a.zone = b.zone AND a.decade = 'a' AND b.decade = 'b'""")
def decadal_difference(spark, d):
    """Difference between two windows of years by nation, years weighing alike."""
    g = trends.decades(series(spark, d), [("a", 1995, 1997), ("b", 1998, 2001)], "year", "v", ["zone"])
    return trends.decadal_difference(g, "a", "b", ["zone"]).select("zone", F.round("difference", 4).alias("difference"), F.round("se", 4).alias("se")).where("difference IS NOT NULL")


@query(f"""WITH {YEARLY}, s AS (SELECT sensor, year, avg(price) AS v FROM y GROUP BY ALL)
SELECT a.sensor AS sensor_a, b.sensor AS sensor_b, count(*)::BIGINT AS shared, CASE WHEN count(*) >= 3 THEN round(avg(b.v - a.v), 4) END AS "offset", CASE WHEN count(*) >= 3 THEN round(stddev_samp(b.v - a.v), 4) END AS sd
FROM s a JOIN s b ON a.year = b.year AND a.sensor < b.sensor GROUP BY ALL""")
def sensor_offsets(spark, d):
    """Offsets of all pairs of order priorities over shared years."""
    rows = yearly_orders(spark, d).groupBy("sensor", "year").agg(F.avg("price").alias("v"))
    out = trends.sensor_offsets(rows, "sensor", "year", "v", 3)
    return out.select("sensor_a", "sensor_b", "shared", F.round("offset", 4).alias("offset"), F.round("sd", 4).alias("sd"))


@query("""WITH t AS (SELECT event_type, datediff('day', DATE '1970-01-01', ts::DATE) AS day, avg(value) AS v, count(*)::DOUBLE AS n FROM events GROUP BY ALL HAVING avg(value) IS NOT NULL),
p AS (SELECT a.event_type, median((b.n - a.n) / (b.day - a.day)) AS slope FROM t a JOIN t b ON a.event_type = b.event_type AND b.day > a.day GROUP BY 1),
r AS (SELECT t.event_type, CASE WHEN count(*) >= 3 AND stddev_pop(v) > 0 AND stddev_pop(n) > 0 THEN corr(v, n) END AS r, count(*)::BIGINT AS days, any_value(slope) AS slope FROM t LEFT JOIN p ON t.event_type = p.event_type GROUP BY t.event_type)
SELECT event_type, round(r, 6) AS r, round(slope, 6) AS obs_slope, days, CASE WHEN days < 3 THEN 'insufficient_data' WHEN r IS NULL THEN 'not_explained_by_sampling' WHEN r <= -0.5 AND slope > 0 THEN 'sampling_artefact_likely' WHEN abs(r) < 0.3 THEN 'not_explained_by_sampling' ELSE 'partial_association' END AS verdict FROM r""")
def obs_count_verdict(spark, d):
    """Whether daily means follow daily counts, by event type: correlation, the counts' slope and the verdict."""
    daily = table(spark, d, "events").groupBy("event_type", F.datediff("ts", F.lit("1970-01-01")).alias("day")).agg(F.avg("value").alias("v"), F.count("*").cast("double").alias("n"))
    out = trends.count_check(daily, ["event_type"], "day", "v", "n")
    return out.select("event_type", r6("r"), r6("obs_slope"), F.col("n_years").alias("days"), "verdict")


# --- spatial statistics -------------------------------------------------------

def _zone_values(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.abs("c_acctbal")), 2).alias("v"))


def _edges(spark, d):
    return graph.contiguity(table(spark, d, "nation"), "n_nationkey", "n_regionkey")


ZONES = """v AS (SELECT c_nationkey AS i, round(sum(abs(c_acctbal)), 2) AS v FROM customer GROUP BY 1), e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey),
z AS (SELECT i, v, v - avg(v) OVER () AS z, var_pop(v) OVER () AS m2, count(*) OVER () AS n, avg(v) OVER () AS mean FROM v),
l AS (SELECT z.*, coalesce(n.lag, 0) AS lag, coalesce(n.k, 0) AS k FROM z LEFT JOIN (SELECT e.i, avg(z.z) AS lag, count(*) AS k FROM e JOIN z ON e.j = z.i GROUP BY e.i) n ON n.i = z.i)"""


@query(f"""WITH {ZONES} SELECT round(count(*) / sum((k > 0)::INTEGER)::DOUBLE * sum(z * lag) / sum(z * z), 6) AS moran_i, round(-1::DOUBLE / (count(*) - 1), 6) AS expected, count(*)::BIGINT AS n FROM l""")
def moran_global(spark, d):
    """Global Moran's I of balances over nations of one region."""
    return graph.moran(_zone_values(spark, d), _edges(spark, d), "c_nationkey", "v").select(r6("moran_i"), r6("expected"), "n")


@query(f"""WITH {ZONES} SELECT i, round(z * lag / m2, 6) AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 AND lag <= 0 THEN 3 ELSE 4 END::INTEGER AS quadrant FROM l""")
def lisa_quadrant(spark, d):
    """Local Moran and quadrants."""
    return graph.local_moran(_zone_values(spark, d), _edges(spark, d), "c_nationkey", "v").select("i", r6("local_i"), "quadrant")


@query(f"""WITH {ZONES}, s AS (SELECT i, j FROM e UNION SELECT i, i FROM v), g AS (SELECT s.i, sum(z.v) AS local, count(*) AS w FROM s JOIN z ON s.j = z.i GROUP BY s.i)
SELECT z.i, round((local - mean * w) / nullif(sqrt(m2) * sqrt((n * w - w * w) / (n - 1)::DOUBLE), 0), 6) AS gi_z, w::BIGINT AS members FROM z JOIN g ON z.i = g.i""")
def gi_star(spark, d):
    """Gi* of balances over nations of one region."""
    return graph.gi_star(_zone_values(spark, d), _edges(spark, d), "c_nationkey", "v").select("i", r6("gi_z"), "members")


@query(f"""WITH {ZONES}, t AS (SELECT i, z / sqrt(m2) AS z FROM z WHERE i IN (SELECT i FROM e)), o AS (SELECT i, row_number() OVER (ORDER BY i) AS r, z FROM t),
d AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY md5('42:' || d || ':' || i), i) AS r, z FROM t, range(1, 1000) x(d)),
w AS (SELECT a.r AS ir, b.r AS jr, a.z AS iz, b.z AS jz, 1 / count(*) OVER (PARTITION BY e.i)::DOUBLE AS w FROM e JOIN o a ON a.i = e.i JOIN o b ON b.i = e.j),
s AS (SELECT sum(w * iz * jz) AS seen, sum(w) AS s0 FROM w), p AS (SELECT a.d, sum(w * a.z * b.z) AS v FROM w JOIN d a ON a.r = ir JOIN d b ON b.d = a.d AND b.r = jr GROUP BY a.d),
m AS (SELECT count(*) FILTER (round(v, 9) >= round(seen, 9)) AS l FROM p, s)
SELECT 'all' AS g, round(seen / s0, 6) AS moran_i, (least(l, 999 - l) + 1) / 1000.0::DOUBLE AS p_sim FROM s, m""")
def moran_permutation(spark, d):
    """Moran's I of customers' balances over nations of one region, and its p by 999 hashed permutations."""
    near = _edges(spark, d).groupBy("i").agg(F.collect_list("j").alias("near"))
    rows = _zone_values(spark, d).select(F.lit("all").alias("g"), F.col("c_nationkey").alias("i"), "v").join(near, "i")
    return draws.moran(rows, ["g"], "i", "v", "near").select("g", r6("moran_i"), "p_sim")


@query("""WITH p AS (SELECT s_suppkey, s_acctbal AS x, (s_suppkey % 100)::DOUBLE AS y FROM supplier),
n AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b ON a.s_suppkey <> b.s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j)::INTEGER AS rank FROM n) SELECT i, j, rank, round(distance, 6) AS distance FROM r WHERE rank <= 2""")
def knn_edges_all(spark, d):
    """Two nearest of all suppliers."""
    p = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return graph.nearest_all(p, "s_suppkey", "s_acctbal", "y", 2).select("i", "j", "rank", r6("distance"))


HOT = """b AS (SELECT event_type, (ts::DATE - DATE '2024-01-01')::INTEGER AS bin, sum(value) AS v FROM events GROUP BY ALL), f AS (SELECT *, v > avg(v) OVER (PARTITION BY event_type) AS hot FROM b)"""


@query(f"""WITH {HOT}, i AS (SELECT *, row_number() OVER w - sum(hot::INTEGER) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) AS island, max(bin) OVER (PARTITION BY event_type) AS last FROM f WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
r AS (SELECT event_type, island, count(*) AS length, max(bin) = any_value(last) AS final FROM i WHERE hot GROUP BY ALL),
s AS (SELECT event_type, sum(length) AS hot_bins, max(length) AS longest, max(CASE WHEN final THEN length ELSE 0 END) AS final_run FROM r GROUP BY ALL),
a AS (SELECT f.event_type, count(*) AS bins, coalesce(any_value(s.hot_bins), 0) AS hot_bins, coalesce(any_value(s.longest), 0) AS longest, coalesce(any_value(s.final_run), 0) AS final_run FROM f LEFT JOIN s ON f.event_type = s.event_type GROUP BY f.event_type)
SELECT event_type, bins::BIGINT AS bins, hot_bins::BIGINT AS hot_bins, longest::BIGINT AS longest, final_run::BIGINT AS final_run FROM a""")
def space_time_runs(spark, d):
    """Daily panel of event values and runs of hot days by type."""
    from pyspark.sql import Window

    b = table(spark, d, "events").groupBy("event_type", F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("bin")).agg(F.sum("value").alias("v"))
    flags = b.withColumn("hot", F.col("v") > F.avg("v").over(Window.partitionBy("event_type")))
    return graph.hot_spot_runs(flags, "event_type", "bin", "hot")


#: Gi* of each nation's year among the nations of its region in this year and the one before; the trend of its z and the step-up across nations.
CUBE = f"""{SERIES}, e AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey),
h AS (SELECT avg(v) AS mean, stddev_pop(v) AS sd, count(*)::DOUBLE AS n FROM s), b AS (SELECT e.i AS zone, s.year, sum(s.v) AS v, count(*)::DOUBLE AS w FROM s JOIN e ON e.j = s.zone GROUP BY ALL),
r AS (SELECT s.zone, s.year, sum(b.v) AS v, sum(b.w) AS w FROM s JOIN b ON b.zone = s.zone AND b.year IN (s.year, s.year - 1) GROUP BY ALL),
g AS (SELECT zone, year, (v - mean * w) / (sd * sqrt((n * w - w * w) / (n - 1))) AS z FROM r, h),
p AS (SELECT a.zone, sum(sign(b.z - a.z))::DOUBLE AS s FROM g a JOIN g b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone), k AS (SELECT zone, count(*)::DOUBLE AS n FROM g GROUP BY zone),
m AS (SELECT k.zone, coalesce(s, 0) AS s, CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) END AS z FROM k LEFT JOIN p ON p.zone = k.zone WHERE n >= 3),
v AS (SELECT zone, s, z, {NORMAL_P.format(z='z')} AS p FROM m), o AS (SELECT *, p * count(*) OVER () / rank() OVER (ORDER BY p DESC) AS x, count(*) OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM v),
t AS (SELECT zone, s, z, least(1::DOUBLE, min(p * m / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, CASE WHEN least(1::DOUBLE, min(p * m / k) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) <= 0.05 THEN sign(s) ELSE 0 END AS t0 FROM o),
"""


@query(CUBE + """c AS (SELECT zone, count(*) AS n, count(*) FILTER (z > 1.96) AS hot, count(*) FILTER (z < -1.96) AS cold, arg_max(z > 1.96, year) AS lh, arg_max(z < -1.96, year) AS lc, max(year) FILTER (NOT z > 1.96) AS eh, max(year) FILTER (NOT z < -1.96) AS ec FROM g GROUP BY zone),
q AS (SELECT *, CASE WHEN lh THEN true WHEN lc THEN false ELSE hot >= cold END AS side FROM c),
u AS (SELECT q.zone, q.n, side, CASE WHEN side THEN hot ELSE cold END AS k, CASE WHEN side THEN cold ELSE hot END AS o, CASE WHEN side THEN lh ELSE lc END AS last, (SELECT count(*) FROM g WHERE g.zone = q.zone AND g.year > coalesce(CASE WHEN side THEN eh ELSE ec END, 0)) AS run, t.t0 FROM q JOIN t ON t.zone = q.zone),
w AS (SELECT *, k / n AS share, CASE WHEN side THEN t0 ELSE -t0 END AS t FROM u),
l AS (SELECT *, CASE WHEN k = 0 AND o = 0 THEN 'no_pattern' WHEN last AND o > 0 THEN 'oscillating' WHEN run > 0 AND run <= 1 AND k = run THEN 'new' WHEN run >= 2 AND k = run AND share < 0.9 THEN 'consecutive' WHEN share >= 0.9 AND NOT last THEN 'historical'
WHEN share >= 0.9 THEN CASE WHEN t > 0 THEN 'intensifying' WHEN t < 0 THEN 'diminishing' ELSE 'persistent' END WHEN share < 0.9 AND o = 0 AND last THEN 'sporadic' WHEN NOT last THEN 'no_pattern' WHEN t > 0 THEN 'intensifying' WHEN t < 0 THEN 'diminishing' ELSE 'sporadic' END AS c FROM w)
SELECT l.zone, l.n::INTEGER AS bins, round(share, 6) AS share, run::INTEGER AS final_run, CASE WHEN c = 'no_pattern' THEN c WHEN side THEN c || '_hot_spot' ELSE c || '_cold_spot' END AS category, (SELECT round(arg_max(z, year), 6) FROM g WHERE g.zone = l.zone) AS last_z, t.s, round(t.z, 6) AS trend_z, round(q, 6) AS p_adjusted FROM l JOIN t ON t.zone = l.zone""")
def emerging_hot_spots(spark, d):
    """Emerging-hot-spot category of every nation from the cube of its yearly mean prices."""
    out = spacetime.emerging_hot_spots(series(spark, d), _edges(spark, d), "zone", "year", "v")
    return out.select("zone", "bins", r6("share"), "final_run", "category", r6("last_z"), "s", r6("trend_z"), r6("p_adjusted"))


@query(f"""WITH {CELLS} SELECT a.row, a.col, round(count(*) FILTER (b.code = 1) / count(*)::DOUBLE, 6) AS share FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row, a.col) <> (b.row, b.col) GROUP BY ALL""")
def focal_share(spark, d):
    """Share of a code among a cell's neighbours within the grid."""
    return grids.focal_share(cells(spark, d), "code", 1, 1).select("row", "col", r6("share"))


@query(f"""WITH {CELLS}, l AS (SELECT a.code, count(*) AS l FROM c a JOIN c b ON a.code = b.code AND ((a.row = b.row AND a.col = b.col + 1) OR (a.col = b.col AND a.row = b.row + 1)) GROUP BY a.code),
n AS (SELECT code, count(*) AS n, floor(sqrt(count(*)::DOUBLE))::BIGINT AS s FROM c GROUP BY code)
SELECT n.code, n.n::BIGINT AS n, coalesce(l, 0)::BIGINT AS "like", round(100::DOUBLE * coalesce(l, 0) / nullif(2 * s * (s - 1) + CASE WHEN n - s * s = 0 THEN 0 WHEN n - s * s <= s THEN 2 * (n - s * s) - 1 ELSE 2 * (n - s * s) - 2 END, 0), 6) AS index FROM n LEFT JOIN l ON n.code = l.code""")
def aggregation_index(spark, d):
    """Like adjacencies against the most possible, by code."""
    return grids.aggregation_index(cells(spark, d), "code").select("code", "n", "like", r6("index"))


@query(f"""WITH RECURSIVE {CELLS}, x AS (SELECT row * 1000000 + col AS i, row, col FROM c WHERE code = 1), e AS (SELECT a.i, b.i AS j FROM x a JOIN x b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
w AS (SELECT i, i AS r FROM x UNION SELECT e.j, w.r FROM w JOIN e ON w.i = e.i) SELECT i, min(r)::BIGINT AS component FROM w GROUP BY i""")
def patch_components(spark, d):
    """Patches of 8-connected cells of one code."""
    return graph.connected(grids.adjacency(cells(spark, d), "code", 1))


@query(f"""WITH {CELLS} SELECT row // 4 AS row, col // 4 AS col, count(*)::BIGINT AS n, round(avg(code), 6) AS mean FROM c GROUP BY ALL""")
def regrid(spark, d):
    """Cells averaged over blocks of four by four."""
    return grids.regrid(cells(spark, d), 4, [F.count("*").alias("n"), F.round(F.avg("code"), 6).alias("mean")])


# --- splits, agreement, change ---------------------------------------------

BLOCKS = "k AS (SELECT c_custkey, c_acctbal, floor(c_acctbal / 500)::BIGINT AS gx, floor(c_custkey / 50)::BIGINT AS gy FROM customer), g AS (SELECT *, (dense_rank() OVER (ORDER BY gx, gy) - 1)::BIGINT AS block FROM k)"



def _block_rows(spark, d):
    c = table(spark, d, "customer").withColumn("y", F.col("c_custkey") * 10.0)
    return agreement.dense_blocks(c, "c_acctbal", "y", 500.0).select("c_custkey", "c_acctbal", F.col("block").cast("long").alias("block"))


@query(f"WITH {BLOCKS} SELECT c_custkey, block FROM g")
def spatial_blocks(spark, d):
    """Dense ids of square blocks."""
    return _block_rows(spark, d).select("c_custkey", "block")


@query(f"""WITH {BLOCKS}, t AS (SELECT block, ntile(5) OVER (ORDER BY md5(concat(block, ':42')), block)::INTEGER AS fold FROM (SELECT DISTINCT block FROM g)) SELECT fold, count(*)::BIGINT AS n, count(DISTINCT g.block)::BIGINT AS blocks FROM g JOIN t ON g.block = t.block GROUP BY fold""")
def blocked_kfold(spark, d):
    """Rows and blocks of five blocked folds."""
    return agreement.blocked_folds(_block_rows(spark, d), "block", 5, 42).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("block").alias("blocks"))


@query(f"""WITH {BLOCKS}, s AS (SELECT block, count(*) AS n FROM g GROUP BY block), t AS (SELECT block, coalesce(sum(n) OVER (ORDER BY md5(concat(block, ':42')), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.25 * sum(n) OVER () AS held_out FROM s)
SELECT c_custkey, held_out FROM g JOIN t ON g.block = t.block""")
def blocked_split(spark, d):
    """A quarter of the rows held out in whole blocks."""
    return agreement.blocked_split(_block_rows(spark, d), "block", 0.25, 42).select("c_custkey", "held_out")


def _judged(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    return labels.join(docs, "doc_id").select(F.col("quality").alias("truth"), (F.col("n_chars") > 600).cast("int").alias("guess"), F.col("toxic").alias("before"))


JUDGED = "j AS (SELECT quality AS truth, (n_chars > 600)::INTEGER AS guess, toxic AS before FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {JUDGED}, c AS (SELECT truth, guess, count(*) AS n FROM j GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS s FROM c),
r AS (SELECT truth AS k, sum(n) AS a FROM c GROUP BY 1), q AS (SELECT guess AS k, sum(n) AS b FROM c GROUP BY 1),
m AS (SELECT sum(coalesce(a, 0) * coalesce(b, 0)) AS ab, sum(abs(coalesce(a, 0) - coalesce(b, 0))) AS apart FROM r FULL JOIN q ON r.k = q.k)
SELECT round(s / t, 6) AS overall, round(CASE WHEN ab / (t * t) < 1 THEN (s / t - ab / (t * t)) / (1 - ab / (t * t)) END, 6) AS kappa, round(apart / 2::DOUBLE / t, 6) AS quantity, round(1 - s / t - apart / 2::DOUBLE / t, 6) AS allocation FROM t, m""")
def kappa_pontius(spark, d):
    """Agreement of a length rule with quality labels."""
    return agreement.agreement(agreement.confusion(_judged(spark, d), "truth", "guess")).select(r6("overall"), r6("kappa"), r6("quantity"), r6("allocation"))


@query(f"""WITH {JUDGED}, c AS (SELECT count(*) FILTER (truth <> before AND guess = truth) AS hits, count(*) FILTER (truth <> before AND guess <> before AND guess <> truth) AS wrong_hits, count(*) FILTER (truth <> before AND guess = before) AS misses, count(*) FILTER (truth = before AND guess <> before) AS false_alarms FROM j)
SELECT hits::BIGINT AS hits, wrong_hits::BIGINT AS wrong_hits, misses::BIGINT AS misses, false_alarms::BIGINT AS false_alarms, round(hits / nullif(hits + wrong_hits + misses + false_alarms, 0)::DOUBLE, 6) AS merit FROM c""")
def figure_of_merit(spark, d):
    """Figure of merit of predicted change."""
    return agreement.figure_of_merit(_judged(spark, d), "before", "truth", "guess").select("hits", "wrong_hits", "misses", "false_alarms", r6("merit"))


STATES = ["click", "error", "purchase", "signup", "view"]
MOVES = """s AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS k), n AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY ALL), f AS (SELECT x.k AS a, y.k AS b, coalesce(c.n, 0) AS n FROM s x CROSS JOIN s y LEFT JOIN c ON c.a = x.k AND c.b = y.k),
p AS (SELECT a, b, CASE WHEN sum(n) OVER (PARTITION BY a) > 0 THEN n / sum(n) OVER (PARTITION BY a) ELSE (a = b)::INTEGER END::DOUBLE AS p FROM f)"""


@query(f"WITH {MOVES} SELECT a, b, round(p, 6) AS p FROM p")
def transition_matrix(spark, d):
    """Shares of next event types by user."""
    return agreement.transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", STATES).select("a", "b", r6("p"))


@query(f"WITH {MOVES} SELECT x.a, y.b, round(sum(x.p * y.p), 6) AS p FROM p x JOIN p y ON x.b = y.a GROUP BY ALL")
def markov_two_steps(spark, d):
    """Two-step transitions."""
    p = agreement.transitions(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", STATES)
    return agreement.markov_step(p, p).select("a", "b", r6("p"))


@query(f"""WITH {MOVES}, a AS (SELECT event_type AS code, count(*) AS cells FROM events GROUP BY 1), r AS (SELECT p.b AS code, sum(a.cells * p.p) AS raw FROM a JOIN p ON a.code = p.a GROUP BY 1),
l AS (SELECT *, floor(round(raw, 9))::BIGINT AS low, row_number() OVER (ORDER BY round(raw, 9) DESC, code) AS k FROM r)
SELECT code, (low + CASE WHEN k = 1 THEN round(sum(raw) OVER ())::BIGINT - sum(low) OVER () ELSE 0 END)::BIGINT AS cells FROM l""")
def projected_areas(spark, d):
    """Whole projected counts by event type."""
    e = table(spark, d, "events")
    p = agreement.transitions(e, ["user_id"], ["ts", "event_id"], "event_type", STATES)
    return agreement.projected_areas(e.groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("cells")), p).select("code", F.col("cells").cast("long").alias("cells"))


@query("""SELECT round(sqrt(avg((l_extendedprice - l_quantity * 1500) ** 2)), 4) AS rmse, round(1 - sum((l_extendedprice - l_quantity * 1500) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, count(*)::BIGINT AS n FROM lineitem""")
def rmse_r2(spark, d):
    """Fit of a linear guess of prices."""
    rows = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("g"))
    return agreement.fit_measures(rows, "t", "g").select(F.round("rmse", 4).alias("rmse"), r6("r2"), "n")


@query("""WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_discount) AS c, max(l_discount) AS e FROM lineitem WHERE l_quantity < 45) SELECT l_returnflag, l_quantity < a OR l_quantity > b OR l_discount < c OR l_discount > e AS outside, count(*)::BIGINT AS n FROM lineitem, r GROUP BY ALL""")
def extrapolation_flags(spark, d):
    """Rows outside the ranges of a training part."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return agreement.extrapolated(rows, rows.where("l_quantity < 45"), ["l_quantity", "l_discount"]).groupBy("l_returnflag", "outside").agg(F.count("*").alias("n"))


@query("""SELECT p_brand, count(*)::BIGINT AS n, round(median(p_size), 6) AS p_size, round(median(p_retailprice), 6) AS p_retailprice, count(*) < 50 AS thin FROM part GROUP BY p_brand""")
def class_profiles(spark, d):
    """Median predictors by brand."""
    return agreement.class_profiles(table(spark, d, "part"), "p_brand", ["p_size", "p_retailprice"], 50).select("p_brand", "n", r6("p_size"), r6("p_retailprice"), "thin")


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem GROUP BY 1""")
def ols_one(spark, d):
    """One-predictor regression by return flag."""
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.round(F.corr(x, "l_discount"), 6).alias("r"))


@query("""WITH r AS (SELECT corr(l_quantity, l_discount) AS qd, corr(l_quantity, l_tax) AS qt, corr(l_discount, l_tax) AS dt FROM lineitem)
SELECT 'l_quantity' AS feature, round(1 / (1 - (qd * qd + qt * qt - 2 * qd * qt * dt) / (1 - dt * dt)), 6) AS vif FROM r UNION ALL SELECT 'l_discount', round(1 / (1 - (qd * qd + dt * dt - 2 * qd * dt * qt) / (1 - qt * qt)), 6) FROM r UNION ALL SELECT 'l_tax', round(1 / (1 - (qt * qt + dt * dt - 2 * qt * dt * qd) / (1 - qd * qd)), 6) FROM r""")
def vif_table(spark, d):
    """Variance inflation of line-item predictors."""
    return spark.createDataFrame(models.vif(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]), "feature string, vif double").select("feature", r6("vif"))


#: Predictors of the forests and their trees; more trees are a parameter away.
FEATURES, TREES = ["l_quantity", "l_discount", "l_tax"], 40


@query()
def rf_blocked_cv(spark, d):
    """Random forest of prices under blocked folds; scores depend on the implementation."""
    rows = table(spark, d, "lineitem").withColumn("block", F.floor(F.col("l_partkey") / 100).cast("long"))
    return models.forest_cv(rows, FEATURES, "l_extendedprice", "block", 5, TREES, 42)


@query()
def split_strategies(spark, d):
    """Scores of the forest under repeated splits by blocks and by rows."""
    rows = table(spark, d, "lineitem").withColumn("block", F.floor(F.col("l_partkey") / 100).cast("long"))
    return models.split_strategies(rows, FEATURES, "l_extendedprice", "block", ["l_orderkey", "l_linenumber"], 0.3, 2, TREES, 42)


@query()
def permutation_importance(spark, d):
    """Loss of fit when one feature is dealt anew among the rows."""
    rows = table(spark, d, "lineitem")
    return models.permutation_importance(rows, FEATURES, "l_extendedprice", ["l_orderkey", "l_linenumber"], TREES, 3, 42)


# --- ranking ------------------------------------------------------------------

@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_nationkey, c_acctbal) AS t, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi FROM customer)
SELECT c_custkey, round((k + (t - 1) / 2::DOUBLE) / n, 6) AS pr, round(CASE WHEN hi = lo THEN 0.5 ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS mm FROM r""")
def percentile_rank(spark, d):
    """Average-tie percent rank and min-max score of balances within nations."""
    v, k = F.col("c_acctbal"), ["c_nationkey"]
    return table(spark, d, "customer").select("c_custkey", F.round(windows.percent_rank(v, k), 6).alias("pr"), F.round(windows.min_max(v, k), 6).alias("mm"))


def _criteria(spark, d):
    """Three criteria by nation; the third is missing where a nation has no supplier."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("zone")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"), F.count("*").cast("double").alias("b"))
    return a.join(s.groupBy(F.col("s_nationkey").alias("zone")).agg(F.round(F.avg("s_acctbal"), 4).alias("c")), "zone", "left")


CRITERIA = """x AS (SELECT a.zone, a.a, a.b, s.c FROM (SELECT c_nationkey AS zone, round(avg(c_acctbal), 4) AS a, count(*)::DOUBLE AS b FROM customer GROUP BY 1) a
LEFT JOIN (SELECT s_nationkey AS zone, round(avg(s_acctbal), 4) AS c FROM supplier GROUP BY 1) s ON a.zone = s.zone)"""
SCORED = CRITERIA + """, m AS (SELECT zone, CASE WHEN max(a) OVER () = min(a) OVER () THEN 0.5 ELSE (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) END AS a, CASE WHEN max(b) OVER () = min(b) OVER () THEN 0.5 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END AS b,
CASE WHEN c IS NULL THEN NULL WHEN max(c) OVER () = min(c) OVER () THEN 0.5 ELSE (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END AS c FROM x),
o AS (SELECT zone, round(CASE WHEN c IS NULL THEN (a * 0.3 + b * 0.3)::DOUBLE / 0.6 ELSE a * 0.3 + b * 0.3 + c * 0.4 END, 9) AS score FROM m)"""


def _scores(spark, d):
    x = _criteria(spark, d)
    mm = x.select("zone", *[windows.min_max(F.col(n), []).alias(n) for n in "abc"])
    return mm.select("zone", F.round(ranking.overlay([(F.col("a"), 0.3), (F.col("b"), 0.3), (F.col("c"), 0.4)]), 9).alias("score"))


@query(f"""WITH {SCORED} SELECT zone, round(score, 6) AS score, row_number() OVER w::INTEGER AS rank, row_number() OVER w <= 10 AND score IS NOT NULL AS in_top FROM o WINDOW w AS (ORDER BY score DESC NULLS LAST, zone)""")
def mcda_rank(spark, d):
    """Weighted overlay of nations with redistribution of missing weight, ranked."""
    return ranking.ranked(_scores(spark, d), "score", "zone", 10).select("zone", r6("score"), "rank", "in_top")


@query(f"""WITH {CRITERIA}, s AS (SELECT zone, a - least(min(a) OVER (), 0) AS a, -b - least(min(-b) OVER (), 0) AS b, c - least(min(c) OVER (), 0) AS c FROM x),
w AS (SELECT zone, 0.5 * a / nullif(sqrt(sum(a * a) OVER ()), 0) AS a, 0.2 * b / nullif(sqrt(sum(b * b) OVER ()), 0) AS b, 0.3 * c / nullif(sqrt(sum(c * c) OVER ()), 0) AS c FROM s),
e AS (SELECT zone, sqrt(coalesce((a - max(a) OVER ()) ** 2, 0) + coalesce((b - max(b) OVER ()) ** 2, 0) + coalesce((c - max(c) OVER ()) ** 2, 0)) AS near, sqrt(coalesce((a - min(a) OVER ()) ** 2, 0) + coalesce((b - min(b) OVER ()) ** 2, 0) + coalesce((c - min(c) OVER ()) ** 2, 0)) AS far FROM w)
SELECT zone, round(CASE WHEN near + far = 0 THEN 0.5 ELSE far / (near + far) END, 6) AS closeness FROM e""")
def topsis(spark, d):
    """Closeness to the ideal nation."""
    return ranking.topsis(_criteria(spark, d), "zone", [("a", 0.5, True), ("b", 0.2, False), ("c", 0.3, True)]).select("zone", r6("closeness"))


@query(f"""WITH {SCORED}, a AS (SELECT zone, row_number() OVER (ORDER BY score DESC NULLS LAST, zone) AS ra FROM o), b AS (SELECT zone, row_number() OVER (ORDER BY b DESC NULLS LAST, zone) AS rb FROM x)
SELECT round(corr(ra, rb), 6) AS spearman, count(*) FILTER (ra <= 10 AND rb <= 10)::BIGINT AS common_top, count(*)::BIGINT AS n, max(abs(ra - rb))::INTEGER AS largest_move FROM a JOIN b USING (zone)""")
def compare_rankings(spark, d):
    """Overlay ranking against a ranking by one criterion."""
    a = ranking.ranked(_scores(spark, d), "score", "zone", 10)
    b = ranking.ranked(_criteria(spark, d), "b", "zone", 10)
    ranking.same_keys(a, b, "zone")
    return ranking.compared(a, b, "zone", "rank", 10).select(r6("spearman"), "common_top", "n", "largest_move")


@query(f"""WITH {CRITERIA}, a AS (SELECT zone FROM x ORDER BY a DESC NULLS LAST, zone LIMIT 8), b AS (SELECT zone FROM x ORDER BY b DESC NULLS LAST, zone LIMIT 8) SELECT zone FROM a WHERE zone IN (SELECT zone FROM b)""")
def top_k_overlap(spark, d):
    """Nations among the first eight by both criteria."""
    x = _criteria(spark, d)
    top = lambda c: x.orderBy(F.col(c).desc_nulls_last(), "zone").limit(8).select("zone")
    return top("a").join(top("b"), "zone", "left_semi")


@query()
def ahp_weights(spark, d):
    """Principal-eigenvector weights of a pairwise matrix and its consistency ratio."""
    w, ratio = ranking.pairwise_weights([[1, 3, 5], [1 / 3, 1, 2], [1 / 5, 1 / 2, 1]])
    return spark.createDataFrame([(i, x, ratio) for i, x in enumerate(w)], "criterion int, weight double, consistency_ratio double")


@query("""WITH c AS (SELECT c_nationkey AS zone, avg(c_acctbal) > 4500 AS need FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS zone, avg(s_acctbal) > 4500 AS supply FROM supplier GROUP BY 1)
SELECT n_nationkey AS zone, CASE WHEN need IS NULL AND supply IS NULL THEN 'no_data' WHEN need IS NULL OR supply IS NULL THEN 'not_assessable' WHEN need AND supply THEN 'both' WHEN need THEN 'first_only' WHEN supply THEN 'second_only' ELSE 'neither' END AS verdict
FROM nation LEFT JOIN c ON n_nationkey = c.zone LEFT JOIN s ON n_nationkey = s.zone""")
def compliance_verdict(spark, d):
    """Verdict by nation from two sides that may be unknown."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg((F.avg("c_acctbal") > 4500).alias("need"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.avg("s_acctbal") > 4500).alias("supply"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"))
    return n.join(c, "zone", "left").join(s, "zone", "left").select("zone", ranking.verdict(F.col("need"), F.col("supply")).alias("verdict"))


@query("""SELECT n_nationkey AS zone, coalesce(count(s_suppkey), 0)::BIGINT AS cells, coalesce(round(sum(s_acctbal), 2), 0) AS area, count(s_suppkey) > 0 AS present FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1""")
def wetland_cross(spark, d):
    """Nations with the area of their rich suppliers, 0 where there are none."""
    s = table(spark, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count("*").alias("cells"), F.round(F.sum("s_acctbal"), 2).alias("area"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"))
    return aggregates.with_spine(s, n, ["zone"], ["cells", "area"]).withColumn("present", F.col("cells") > 0)


@query("""SELECT b.item_id, count(d.doc_id)::BIGINT AS documents, min(d.doc_id) AS first_doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1""")
def provenance_contains(spark, d):
    """Documents that hold an item's whole text anywhere."""
    b, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    return aggregates.mentions(b, docs, "item_id", "doc_id", "text")


@query(f"""WITH {CRITERIA}, r AS (SELECT *, rank() OVER (ORDER BY c NULLS LAST) AS kc, count(*) OVER (PARTITION BY c) AS tc, rank() OVER (ORDER BY b) AS kb, count(*) OVER (PARTITION BY b) AS tb, count(*) OVER () AS n FROM x)
SELECT zone, round(0.6 * (kc + (tc - 1) / 2::DOUBLE) / n + 0.4 * (kb + (tb - 1) / 2::DOUBLE) / n, 6) AS urgency FROM r""")
def interim_priority(spark, d):
    """Interim urgency of nations; a missing criterion ranks last, as the most urgent."""
    x = _criteria(spark, d)
    return x.select("zone", F.round(ranking.urgency(x, [("c", 0.6), ("b", 0.4)]), 6).alias("urgency"))


@query(f"""WITH {CRITERIA}, k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2::DOUBLE AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2::DOUBLE AS b, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2::DOUBLE AS c FROM x WHERE c IS NOT NULL)
SELECT 'a' AS a, 'b' AS b, round(corr(a, b), 6) AS rho FROM k UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM k UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM k""")
def criterion_correlation(spark, d):
    """Spearman's correlation of the criteria."""
    return ranking.rank_correlations(_criteria(spark, d), ["a", "b", "c"]).select("a", "b", r6("rho"))


@query(f"""WITH {SCORED}, f AS (SELECT zone, row_number() OVER (ORDER BY score DESC NULLS LAST, zone) AS rf FROM o),
l AS (SELECT 'a' AS left_out, zone, CASE WHEN c IS NOT NULL THEN round(b * (0.3::DOUBLE / 0.7::DOUBLE) + c * (0.4::DOUBLE / 0.7::DOUBLE), 9) END AS s FROM m UNION ALL SELECT 'b', zone, CASE WHEN c IS NOT NULL THEN round(a * (0.3::DOUBLE / 0.7::DOUBLE) + c * (0.4::DOUBLE / 0.7::DOUBLE), 9) END FROM m UNION ALL SELECT 'c', zone, round(a * 0.5::DOUBLE + b * 0.5::DOUBLE, 9) FROM m),
r AS (SELECT left_out, zone, row_number() OVER (PARTITION BY left_out ORDER BY s DESC NULLS LAST, zone) AS k FROM l)
SELECT left_out, round(corr(rf, k), 6) AS spearman, count(*) FILTER (rf <= 10 AND k <= 10)::BIGINT AS common_top, count(*)::BIGINT AS n, max(abs(rf - k))::INTEGER AS largest_move FROM r JOIN f ON r.zone = f.zone GROUP BY left_out""")
def criterion_ablation(spark, d):
    """Largest rank change of each nation's overlay when a criterion is left out."""
    x = _criteria(spark, d)
    mm = x.select("zone", *[windows.min_max(F.col(n), []).alias(n) for n in "abc"])
    terms = [("a", 0.3), ("b", 0.3), ("c", 0.4)]
    score = lambda t: F.round(ranking.overlay([(F.col(n), w) for n, w in t]), 9)
    full = ranking.ranked(mm.withColumn("score", score(terms)), "score", "zone", 10)
    out = None
    for left_out, rest in ranking.ablated(terms):
        one = ranking.compared(full, ranking.ranked(mm.withColumn("score", score(rest)), "score", "zone", 10), "zone", "rank", 10).withColumns({"left_out": F.lit(left_out), "spearman": F.round("spearman", 6)})
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT n_nationkey AS zone, round(least(1.0::DOUBLE, s.a / nullif(c.a, 0)), 6) AS coverage FROM nation LEFT JOIN (SELECT s_nationkey AS k, sum(abs(s_acctbal)) AS a FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, sum(abs(c_acctbal)) / 10 AS a FROM customer GROUP BY 1) c ON c.k = n_nationkey""")
def land_coverage(spark, d):
    """Observed over land area by nation, at most 1."""
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum(F.abs("s_acctbal")).alias("seen"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg((F.sum(F.abs("c_acctbal")) / 10).alias("land"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"))
    return n.join(s, "zone", "left").join(c, "zone", "left").select("zone", F.round(ranking.coverage(F.col("seen"), F.col("land")), 6).alias("coverage"))


# --- patches and allocation ---------------------------------------------------

@query(f"""WITH RECURSIVE {CELLS}, x AS (SELECT row * 1000000 + col AS i, row, col FROM c WHERE code = 1), e AS (SELECT a.i, b.i AS j FROM x a JOIN x b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
w AS (SELECT i, i AS r FROM x UNION SELECT e.j, w.r FROM w JOIN e ON w.i = e.i), p AS (SELECT i, min(r) AS p FROM w GROUP BY i), s AS (SELECT p, count(*) AS n FROM p GROUP BY p),
g AS (SELECT count(*) FILTER ((a.code = 1) <> (b.code = 1)) AS edges FROM c a JOIN c b ON (a.row = b.row AND a.col = b.col + 1) OR (a.col = b.col AND a.row = b.row + 1))
SELECT round(sum(n) * 0.01::DOUBLE, 6) AS area_ha, count(*)::BIGINT AS patches, round(sum(n) / count(*)::DOUBLE * 0.01, 6) AS mean_patch_ha, round(100::DOUBLE * max(n) / (SELECT count(*) FROM c), 6) AS largest_patch_index, (SELECT edges FROM g)::BIGINT AS edges FROM s""")
def landscape_metrics(spark, d):
    """Area, patches, largest patch and edges of one code."""
    c = cells(spark, d)
    out = landscape.landscape(c, landscape.patches(c, "code", 1), "code", 1, 0.01)
    return out.select(r6("area_ha"), "patches", r6("mean_patch_ha"), r6("largest_patch_index"), "edges")


@query(f"""WITH RECURSIVE {CELLS}, x AS (SELECT row * 1000000 + col AS i, row, col FROM c WHERE code = 1), e AS (SELECT a.i, b.i AS j FROM x a JOIN x b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
w AS (SELECT i, i AS r FROM x UNION SELECT e.j, w.r FROM w JOIN e ON w.i = e.i), p AS (SELECT i, min(r) AS p FROM w GROUP BY i), q AS (SELECT x.row, x.col FROM p JOIN x ON p.i = x.i WHERE p.p IN (SELECT p FROM p GROUP BY p HAVING count(*) >= 5)),
n AS (SELECT c.row, c.col, min((c.row - q.row) ** 2 + (c.col - q.col) ** 2) AS s FROM c JOIN q ON abs(c.row - q.row) <= 3 AND abs(c.col - q.col) <= 3 GROUP BY ALL)
SELECT row, col, round(sqrt(s), 6) AS distance FROM n WHERE s <= 9""")
def service_area(spark, d):
    """Cells within three cells of a patch of half a hectare, and how far it is."""
    c = cells(spark, d)
    targets = landscape.qualifying(landscape.patches(c, "code", 1), 0.1)
    return landscape.near_cells(c, targets, 3.0).select("row", "col", r6("distance"))


@query(f"""WITH {CELLS}, n AS (SELECT c.row, c.col, min((c.row - q.row) ** 2 + (c.col - q.col) ** 2) AS s FROM c JOIN c q ON q.code = 3 AND abs(c.row - q.row) <= 2 AND abs(c.col - q.col) <= 2 GROUP BY ALL) SELECT row, col FROM n WHERE s <= 4""")
def shoreline_mask(spark, d):
    """Cells within two cells of water: a circular dilation of the mask."""
    c = cells(spark, d)
    return landscape.near_cells(c, c.where("code = 3"), 2.0).select("row", "col")


@query(f"""WITH {CELLS}, m AS (SELECT *, row_number() OVER (PARTITION BY code = 2 ORDER BY row + col, row, col) AS k, floor(count(*) OVER (PARTITION BY code = 2) * 0.2) AS n FROM c) SELECT row, col, CASE WHEN code = 2 AND k <= n THEN 1 ELSE code END AS code, code = 2 AND k <= n AS changed FROM m""")
def greening_scenario(spark, d):
    """A fifth of the cells of one code turned to another."""
    return landscape.scenario(cells(spark, d), F.col("code") == 2, F.col("row") + F.col("col"), 0.2, 1, "code").select("row", "col", "code", "changed")


@query()
def ca_allocation(spark, d):
    """Cells of each code before and after an allocation to a demand; sequential by design, so without a twin."""
    c = cells(spark, d)
    n = {r["code"]: r["n"] for r in c.groupBy("code").agg(F.count("*").alias("n")).collect()}
    move = n.get(0, 0) // 4
    return landscape.allocate(c, "code", {**n, 0: n.get(0, 0) - move, 1: n.get(1, 0) + move}).groupBy("code").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


# --- further trends and models -------------------------------------------------

@query(f"""WITH {YEARLY}, e AS (SELECT DISTINCT year - year % 5 AS epoch FROM y) SELECT y.zone, (y.year - y.year % 5)::INTEGER AS epoch, round(median(price), 4) AS median, count(price)::BIGINT AS n FROM y GROUP BY ALL""")
def epoch_composite(spark, d):
    """Medians pooled over five-year epochs by nation."""
    rows = yearly_orders(spark, d).withColumn("epoch", (F.col("year") - F.col("year") % 5).cast("int"))
    return rows.groupBy("zone", "epoch").agg(F.round(F.median("price"), 4).alias("median"), F.count("price").alias("n"))


@query(f"""{SERIES}, m AS (SELECT max(n) AS best FROM s) SELECT year, sum(n)::BIGINT AS n, sum(n) >= 0.9 * max(sum(n)) OVER () AS usable FROM s GROUP BY year""")
def usable_years(spark, d):
    """Years with at least nine tenths of the best year's orders."""
    by = series(spark, d).groupBy("year").agg(F.sum("n").alias("n"))
    best = by.agg(F.max("n").alias("best")).withColumn("k", F.lit(1))
    return by.withColumn("k", F.lit(1)).join(F.broadcast(best), "k").select("year", "n", (F.col("n") >= 0.9 * F.col("best")).alias("usable"))


@query(f"""{SERIES}, p AS (SELECT a.zone, sum(sign(b.v - a.v)) AS s, count(*)::DOUBLE * count(*) FILTER (b.v <> a.v) AS pairs FROM s a JOIN s b ON a.zone = b.zone AND b.year > a.year GROUP BY a.zone) SELECT zone, round(s / nullif(sqrt(pairs), 0), 6) AS tau FROM p""")
def kendall_tau(spark, d):
    """Kendall's tau-b of mean prices by nation."""
    return trends.kendall_tau(series(spark, d), ["zone"], "year", "v").select("zone", r6("tau"))


@query()
def modified_trend_tests(spark, d):
    """Original and modified Mann-Kendall tests by nation; the modified ones are numeric work without a twin."""
    return inference.trend_tests(series(spark, d), ["zone"], "year", "v", ["original", "hamed_rao", "yue_wang", "prewhitening", "trend_free"])


@query()
def spatial_model_ladder(spark, d):
    """OLS, LM tests, spatial lag, spatial error and local regression over nations."""
    x = _criteria(spark, d)
    near = _edges(spark, d).groupBy("i").agg(F.sort_array(F.collect_list(F.col("j").cast("long"))).alias("near"))
    rows = x.join(near, x.zone == near.i).select(F.lit("all").alias("g"), F.col("zone").cast("long").alias("zone"), "a", "b", (F.col("zone") % 5).cast("double").alias("x"), F.floor(F.col("zone") / 5).cast("double").alias("y"), "near")
    return inference.model_ladder(rows, "g", "zone", "a", ["b"], ["x", "y"], "near")


# --- event time ----------------------------------------------------------------

@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def stream_tumbling(spark, d):
    """Daily windows of events by type; the plan is the same on a stream."""
    out = event_windows.tumbling(table(spark, d, "events"), "ts", "1 day", ["event_type"], "value")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"), r6("mean"))


@query("""WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of users that end after half an hour."""
    return event_windows.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
