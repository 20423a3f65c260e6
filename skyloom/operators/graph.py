"""Spatial statistics on edge tables (i, j): Moran, local Moran, Gi*, nearest neighbours, components."""

from __future__ import annotations

import re
import uuid
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators import windows


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one under /tmp only where a local session leaves it unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "/tmp/skyloom-checkpoints").rstrip("/")


_steps: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`written` has written in this process; call it once results are stored.  Returns their number."""
    n = len(_steps)
    while _steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(_steps.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a table in the shared folder, which stays until :func:`release`."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    _steps.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part that :func:`dealt` makes.
PART_ROWS = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over parts of about ``PART_ROWS`` of its ``rows``, which are not merged again.

    Rows of few bytes shrink so well that many of them would end up in one task.
    """
    return df.repartition(max(1, -(-rows // PART_ROWS)), *keys)


def contiguity(zones: DataFrame, key: str, group: str) -> DataFrame:
    """Edges (i, j), both ways, between zones of one group."""
    a = zones.select(F.col(key).alias("i"), F.col(group).alias("g"))
    b = zones.select(F.col(key).alias("j"), F.col(group).alias("g"))
    return a.join(b, "g").where("i <> j").select("i", "j")


def nearest_all(points: DataFrame, key: str, x: str, y: str, k: int, of: DataFrame | None = None) -> DataFrame:
    """Edges (i, j, rank, distance) to the k nearest of all points, ties to the smaller key; with ``of`` (i), from its points only.

    A point is held against the points of its grid cell and the eight around it,
    which hold all that are nearer than a cell's width.  Points whose k-th distance
    does not prove itself so go on to cells of twice the width, until one covers
    the map; tables are written between rounds.  Points without coordinates have
    no edges and are nobody's neighbour.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = written(points.where(known(x) & known(y)).select(F.col(key).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    n, x0, x1, y0, y1 = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        return rows.select("i", F.col("i").alias("j"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance"))
    wide, high = x1 - x0, y1 - y0
    side = 2 * max((wide * high * k / n) ** 0.5, max(wide, high) * k / n) or 1.0
    order = Window.partitionBy("i").orderBy("distance", "j")
    d = F.sqrt((F.col("x") - F.col("xj")) * (F.col("x") - F.col("xj")) + (F.col("y") - F.col("yj")) * (F.col("y") - F.col("yj")))
    left, out = rows if of is None else written(rows.join(of.select("i").distinct(), "i", "left_semi")), None
    while True:
        last = side > 2 * max(wide, high)
        cell = lambda c, low: F.floor((F.col(c) - low) / side)  # noqa: B023, E731
        near = F.explode(F.array(*[F.struct((cell("x", x0) + a).alias("cx"), (cell("y", y0) + b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        a = left.select("i", "x", "y", near.alias("c")).select("i", "x", "y", "c.cx", "c.cy")
        b = rows.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x", x0).alias("cx"), cell("y", y0).alias("cy"))
        a, b = (dealt(t, m, "cx", "cy") for t, m in ((a, 9 * n), (b, 9 * n)))
        found = a.join(b, ["cx", "cy"]).where("i <> j").withColumn("distance", d).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = written(found.select("i", "j", "rank", "distance"))
        proven = found if last else found.join(found.where((F.col("rank") == k) & (F.col("distance") < side * (1 - 1e-9))).select("i"), "i", "left_semi")
        out = proven if out is None else out.unionByName(proven)
        if last:
            return out
        left = written(left.join(proven.select("i").distinct(), "i", "left_anti"))
        if left.isEmpty():
            return out
        side *= 2


def island_repair(edges: DataFrame, nearest_edges: DataFrame) -> DataFrame:
    """``edges`` plus, for keys without any, a symmetric edge to their nearest neighbour."""
    lone = nearest_edges.where("rank = 1").join(edges.select("i").distinct(), "i", "left_anti").select("i", "j")
    return edges.select("i", "j").union(lone).union(lone.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def _centred(values: DataFrame, key: str, value: str) -> DataFrame:
    v = values.where(F.col(value).isNotNull()).select(F.col(key).alias("i"), F.col(value).cast("double").alias("v"))
    return windows.with_totals(v, {"mean": F.avg("v"), "m2": F.var_pop("v"), "n": F.count("*").cast("double")}).withColumn("z", F.col("v") - F.col("mean"))


def _lagged(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Row-standardised lag of z per key; keys without neighbours have lag 0."""
    near = edges.join(values.select(F.col("i").alias("j"), F.col("z").alias("zj")), "j").groupBy("i").agg(F.avg("zj").alias("lag"), F.count("*").alias("neighbours"))
    return values.join(near, "i", "left").na.fill(0.0, ["lag"]).na.fill(0, ["neighbours"])


def moran(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Global Moran's I under row-standardised weights, with its expectation -1/(n-1)."""
    rows = _lagged(_centred(values, key, value), edges)
    s0 = F.sum((F.col("neighbours") > 0).cast("double"))
    return rows.agg((F.count("*") / F.nullif(s0, F.lit(0.0)) * F.sum(F.col("z") * F.col("lag")) / F.nullif(F.sum(F.col("z") * F.col("z")), F.lit(0.0))).alias("moran_i"), (F.lit(-1.0) / (F.count("*") - 1)).alias("expected"), F.count("*").alias("n"))


def local_moran(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Local I = z * lag / m2 with m2 over n, and the quadrant: 1 HH, 2 LH, 3 LL, 4 HL."""
    rows = _lagged(_centred(values, key, value), edges)
    quadrant = F.when((F.col("z") > 0) & (F.col("lag") > 0), 1).when((F.col("z") <= 0) & (F.col("lag") > 0), 2).when((F.col("z") <= 0) & (F.col("lag") <= 0), 3).otherwise(4)
    return rows.select("i", (F.col("z") * F.col("lag") / F.nullif(F.col("m2"), F.lit(0.0))).alias("local_i"), quadrant.alias("quadrant"))


def gi_star(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Gi* z-score under binary weights with the zone itself; values are not negative."""
    rows = _centred(values, key, value)
    with_self = edges.select("i", "j").union(rows.select("i", F.col("i").alias("j"))).distinct()
    near = with_self.join(rows.select(F.col("i").alias("j"), F.col("v").alias("vj")), "j").groupBy("i").agg(F.sum("vj").alias("local"), F.count("*").cast("double").alias("w"))
    joined = rows.join(near, "i")
    spread = F.sqrt("m2") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1))
    return joined.select("i", ((F.col("local") - F.col("mean") * F.col("w")) / F.nullif(spread, F.lit(0.0))).alias("gi_z"), F.col("w").cast("long").alias("members"))


def connected(edges: DataFrame) -> DataFrame:
    """(i, component) with the smallest key reachable: labels spread and jump until none changes; tables written between rounds.

    The tables are small as files but not in memory, so none is broadcast: the driver has nothing of them.
    """
    both = written(edges.select("i", "j").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = written(both.groupBy("i").agg(F.least(F.min("j"), F.col("i")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("i", "j").hint("merge"), "j").groupBy("i").agg(F.min("component").alias("c"))
        spread = labels.join(near.hint("merge"), "i").select("i", F.least("component", "c").alias("component"), F.col("component").alias("old"))
        jump = spread.select(F.col("i").alias("component"), F.col("component").alias("far"))
        moved = written(spread.join(jump.hint("merge"), "component", "left").select("i", F.least("component", F.coalesce("far", "component")).alias("component"), "old"))
        labels = moved.select("i", "component")
        if moved.where("component <> old").isEmpty():
            return labels


def hot_spot_runs(flags: DataFrame, zone: str, bin_: str, flag: str) -> DataFrame:
    """Per zone: bins, hot bins, longest run and final run of hot bins, by gaps and islands."""
    order = Window.partitionBy(zone).orderBy(bin_)
    hot = F.col(flag).cast("int")
    marked = flags.withColumn("_island", F.row_number().over(order) - F.sum(hot).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = flags.groupBy(zone).agg(F.max(bin_).alias("_last"))
    runs = marked.where(F.col(flag)).groupBy(zone, "_island").agg(F.count("*").alias("length"), F.max(bin_).alias("_end"))
    runs = runs.join(last, zone).groupBy(zone).agg(F.sum("length").alias("hot_bins"), F.max("length").alias("longest"), F.max(F.when(F.col("_end") == F.col("_last"), F.col("length")).otherwise(0)).alias("final_run"))
    return flags.groupBy(zone).agg(F.count("*").alias("bins")).join(runs, zone, "left").na.fill(0, ["hot_bins", "longest", "final_run"])


#: Fixed values of emerging hot spots: significance, final run that is new, least consecutive run, persistent share, sporadic share, recent bins.
HOT_Z, NEW_BINS, CONSECUTIVE_BINS, PERSISTENT, SPORADIC, RECENT_BINS = 1.96, 1, 2, 0.9, 0.9, 1


def emerging(panel: DataFrame, zone: str, bin_: str, z: str, trend: str, final_required: bool = True) -> DataFrame:
    """(zone, bins, share, final_run, category): the emerging-hot-spot category of each zone's z series.

    ``trend`` is 1 for a significant rise, -1 for a fall, 0 for none.  The final bin
    decides the side, the majority only if it is not significant.  Rules apply in a
    fixed order: oscillating, new, consecutive, the persistent family, sporadic,
    then what the trend says.
    """
    rows = panel.groupBy(zone).agg(F.transform(F.array_sort(F.collect_list(F.struct(bin_, z))), lambda x: x[z]).alias("s"), F.max(trend).alias("t"))
    some = lambda a: F.exists(a, lambda x: x)
    rows = rows.withColumns({"hot": F.transform("s", lambda x: x > HOT_Z), "cold": F.transform("s", lambda x: x < -HOT_Z), "n": F.size("s")})
    ones = lambda a: F.size(F.filter(a, lambda x: x))
    rows = rows.withColumn("is_hot", F.when(F.element_at("hot", -1), True).when(F.element_at("cold", -1), False).otherwise(ones("hot") >= ones("cold")))
    rows = rows.withColumns({"f": F.when(F.col("is_hot"), F.col("hot")).otherwise(F.col("cold")), "o": F.when(F.col("is_hot"), F.col("cold")).otherwise(F.col("hot")), "t": F.when(F.col("is_hot"), F.col("t")).otherwise(-F.col("t"))})
    rows = rows.withColumns({"k": ones("f"), "run": F.col("n") - F.array_max(F.transform("f", lambda x, i: F.when(x, 0).otherwise(i + 1)))})
    rows = rows.withColumns({"share": F.col("k") / F.col("n"), "last": F.element_at("f", -1), "recent": some(F.slice("f", -RECENT_BINS, RECENT_BINS)), "opposite": some("o")})
    moving = F.when(F.col("t") > 0, "intensifying").when(F.col("t") < 0, "diminishing")
    label = (
        F.when((F.col("k") == 0) & ~F.col("opposite"), "no_pattern")
        .when(F.col("last") & F.col("opposite"), "oscillating")
        .when((F.col("run") > 0) & (F.col("run") <= NEW_BINS) & (F.col("k") == F.col("run")), "new")
        .when((F.col("run") >= CONSECUTIVE_BINS) & (F.col("k") == F.col("run")) & (F.col("share") < PERSISTENT), "consecutive")
        .when((F.col("share") >= PERSISTENT) & ~F.col("recent"), "historical")
        .when(F.col("share") >= PERSISTENT, F.coalesce(moving, F.lit("persistent")))
        .when((F.col("share") < SPORADIC) & ~F.col("opposite") & (F.col("last") | F.lit(not final_required)), "sporadic")
        .when(~F.col("last") & F.lit(final_required), "no_pattern")
        .otherwise(F.coalesce(moving, F.lit("sporadic")))
    )
    rows = rows.withColumn("label", label)
    side = F.when(F.col("is_hot"), "_hot_spot").otherwise("_cold_spot")
    return rows.select(zone, F.col("n").alias("bins"), "share", F.col("run").alias("final_run"), F.when(F.col("label") == "no_pattern", F.col("label")).otherwise(F.concat("label", side)).alias("category"))
