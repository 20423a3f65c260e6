"""Landscape metrics of patches within zones: one pass over neighbouring cells, one labelling, sums by patch, class and zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import graph, grids

#: Fixed value: share of a zone that must be observed.
COVERAGE_FLOOR = 0.5


def _beside(cells: DataFrame) -> DataFrame:
    """(row, col, zone, class, down, right, near): each cell of a class with every observed cell around it in its zone; near is that one's class.

    ``cells`` is (row, col, zone, class, seen); a cell that is seen without being of a
    class of interest has a null class.
    """
    around = F.array(*[F.struct(F.lit(a).alias("down"), F.lit(b).alias("right")) for a, b in grids.offsets(1)])
    own = cells.where("class IS NOT NULL").select("row", "col", "zone", "class", F.inline(around))
    own = own.withColumns({"_row": F.col("row") + F.col("down"), "_col": F.col("col") + F.col("right")})
    other = cells.where("seen").select(F.col("row").alias("_row"), F.col("col").alias("_col"), "zone", F.col("class").alias("near"))
    return own.join(other, ["_row", "_col", "zone"]).select("row", "col", "zone", "class", "down", "right", "near")


def _labelled(cells: DataFrame, beside: DataFrame, corners: bool) -> DataFrame:
    """(row, col, zone, class, patch): cells of one class and zone that are joined by sides (or, with ``corners``, by these), named by their first cell."""
    key = lambda r, c: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"))
    near = beside.where("near = class AND (down > 0 OR (down = 0 AND right > 0))")
    near = near if corners else near.where("down * right = 0")
    links = near.select(key(F.col("row"), F.col("col")).alias("i"), key(F.col("row") + F.col("down"), F.col("col") + F.col("right")).alias("j"))
    found = graph.connected(links).select("i.row", "i.col", F.col("component").alias("patch"))
    own = cells.where("class IS NOT NULL").select("row", "col", "zone", "class")
    return own.join(found, ["row", "col"], "left").withColumn("patch", F.coalesce("patch", key(F.col("row"), F.col("col"))))


def most_adjacencies(n: Column) -> Column:
    """Sides that n cells share at most, in the most compact patch."""
    side = F.floor(F.sqrt(n.cast("double")))
    rest = n - side * side
    return 2 * side * (side - 1) + F.when(rest == 0, 0).when(rest <= side, 2 * rest - 1).otherwise(2 * rest - 2)


def by_zone(cells: DataFrame, zone: str, class_: str, classes: list[int], cell_m: float, corners: bool = True, least_cells: int = 1, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """One row per zone and class of ``classes``: its landscape metrics, patches cut at the zones' borders.

    ``cells`` is (row, col, zone, class); each place comes once.  A null zone lies outside
    and takes no part; a null class is not observed: no part of the landscape's area, and
    no edge is counted against it, nor against other zones or the map's rim.  Patches
    of fewer than ``least_cells`` cells are taken as background.  Columns: area and share
    of the class, patches and their density, edge in metres and by area, mean and largest
    patch, mean shape (quarter perimeter over the root of the area, in cells; 1 is a
    square), core area (cells with all eight around them in the patch), aggregation index,
    the observed share of the zone and whether it is below ``floor``.  Where a class is
    absent its area, patches, edge and core are 0 and the rest is null.
    """
    rows = cells.where(F.col(zone).isNotNull()).select("row", "col", F.col(zone).alias("zone"), F.when(F.col(class_).isin(classes), F.col(class_)).alias("class"), F.col(class_).isNotNull().alias("seen"))
    beside = graph.written(_beside(rows))
    cells_of = _labelled(rows, beside, corners)
    if least_cells > 1:
        big = cells_of.groupBy("patch").count().where(F.col("count") >= least_cells).select("patch")
        left = cells_of.join(big, "patch", "left_semi").select("row", "col", F.lit(True).alias("_left"))
        rows = graph.written(rows.join(left, ["row", "col"], "left").withColumn("class", F.when(F.col("_left"), F.col("class"))).drop("_left"))
        beside = graph.written(_beside(rows))
        cells_of = _labelled(rows, beside, corners)
    side = F.col("down") * F.col("right") == 0
    like = F.coalesce(F.col("near") == F.col("class"), F.lit(False))
    sides = beside.groupBy("row", "col").agg(F.count_if(side & like).alias("like"), F.count_if(side & ~like).alias("edge"), F.count_if(like).alias("same"))
    each = cells_of.join(sides, ["row", "col"], "left").na.fill(0, ["like", "edge", "same"])
    patch = each.groupBy("zone", "class", "patch").agg(F.count("*").alias("n"), (4 * F.count("*") - F.sum("like")).alias("perimeter"), F.sum("like").alias("like"), F.sum("edge").alias("edge"), F.count_if(F.col("same") == 8).alias("core"))
    shape = 0.25 * F.col("perimeter") / F.sqrt(F.col("n").cast("double"))
    class_sums = patch.groupBy("zone", "class").agg(F.sum("n").alias("n"), F.count("*").alias("patches"), F.max("n").alias("most"), F.avg(shape).alias("mean_shape"), F.sum("core").alias("core"), F.sum("edge").alias("edge"), (F.sum("like") / 2).alias("like"))
    zones = rows.groupBy("zone").agg(F.count("*").alias("all"), F.count_if("seen").alias("seen"))
    out = zones.withColumn("class", F.explode(F.array(*map(F.lit, classes)))).join(class_sums, ["zone", "class"], "left").na.fill(0, ["n", "patches", "core", "edge"])
    hectares, over = cell_m * cell_m / 10_000, lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    area = F.col("seen") * hectares
    index = F.when(F.col("n") == 1, 0.0).otherwise(100.0 * over(F.col("like"), most_adjacencies(F.col("n"))))
    return out.select(
        "zone", "class", area.alias("landscape_ha"), (F.col("n") * hectares).alias("class_ha"), over(F.col("n"), F.col("seen")).alias("class_share"), "patches", over(100.0 * F.col("patches"), area).alias("patches_per_100ha"),
        (F.col("edge") * cell_m).alias("edge_m"), over(F.col("edge") * cell_m, area).alias("edge_m_per_ha"), (over(F.col("n"), F.col("patches")) * hectares).alias("mean_patch_ha"), over(100.0 * F.coalesce("most", F.when(F.col("seen") > 0, 0)), F.col("seen")).alias("largest_patch_index"),
        "mean_shape", (F.col("core") * hectares).alias("core_ha"), F.when(F.col("n") > 0, index).alias("aggregation_index"), over(F.col("seen"), F.col("all")).alias("observed_share"), (F.col("seen") < floor * F.col("all")).alias("below_floor"))
