"""Spatial joins and weights: points in polygons, touching boxes, island policy, rings and nearest targets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import graph, landscape


def _buckets(low: Column, high: Column, side: float) -> Column:
    """Numbers of the bands of width ``side`` that an interval meets."""
    return F.sequence(F.floor(low / side), F.floor(high / side))


def is_inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array<struct<x, y>>, closed or not), by crossings of the ray to the right; a null side is null."""

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % F.size(ring))
        apart = (p["y"] > y) != (q["y"] > y)
        return F.when(apart, (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(apart, q["y"] - p["y"]) + p["x"]).cast("int")).otherwise(0)

    return F.when(x.isNotNull() & y.isNotNull() & ring.isNotNull(), F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1)


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, side: float) -> DataFrame:
    """Rows of ``points`` with the columns of the polygons that hold them; points in none go.

    A polygon is sent to the square buckets of width ``side`` that its bounds meet and
    a point to its own, so that only a bucket's points meet a polygon.
    """
    px, py = F.transform(F.col(ring), lambda p: p["x"]), F.transform(F.col(ring), lambda p: p["y"])
    sent = polygons.withColumn("_bx", F.explode(_buckets(F.array_min(px), F.array_max(px), side))).withColumn("_by", F.explode(_buckets(F.array_min(py), F.array_max(py), side)))
    own = points.withColumns({"_bx": F.floor(F.col(x) / side), "_by": F.floor(F.col(y) / side)})
    return own.join(sent, ["_bx", "_by"]).where(is_inside(F.col(x), F.col(y), F.col(ring))).drop("_bx", "_by")


def touching(boxes: DataFrame, key: str, side: float, rook: bool = False, slack: float = 1e-9) -> DataFrame:
    """Edges (i, j), both ways, between boxes (x0, y0, x1, y1) that meet; with ``rook`` along more than a point.

    Boxes meet only in buckets that both are sent to.
    """
    low, high = lambda c: F.floor((F.col(c) - slack) / side), lambda c: F.floor((F.col(c) + slack) / side)
    sent = boxes.withColumn("_bx", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("_by", F.explode(F.sequence(low("y0"), high("y1"))))
    sent = graph.dealt(sent, boxes.count(), "_bx", "_by")
    a, b = sent.alias("a"), sent.alias("b")
    wide = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    tall = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0")
    meet = (wide >= -slack) & (tall >= -slack)
    meet = meet & (F.greatest(wide, tall) > slack) if rook else meet
    same = (F.col("a._bx") == F.col("b._bx")) & (F.col("a._by") == F.col("b._by")) & (F.col(f"a.{key}") != F.col(f"b.{key}"))
    return a.join(b, same).where(meet).select(F.col(f"a.{key}").alias("i"), F.col(f"b.{key}").alias("j")).distinct()


def islands(keys: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Keys without any neighbour."""
    return keys.select(F.col(key).alias("i")).distinct().join(edges.select("i").distinct(), "i", "left_anti")


def weights(keys: DataFrame, key: str, edges: DataFrame, nearest: DataFrame | None = None, policy: str = "nearest", transform: str = "r") -> DataFrame:
    """(i, j, w) of an edge table: islands repaired by their nearest neighbour, refused or kept; rows sum to 1 with transform r, are 1 with b."""
    if policy not in ("nearest", "error", "keep") or transform not in ("r", "b"):
        raise ValueError(f"no island policy {policy!r} or transform {transform!r}")
    lone = islands(keys, key, edges)
    if policy == "error" and (names := [r["i"] for r in lone.orderBy("i").limit(5).collect()]):
        raise ValueError(f"zones without a neighbour, as {names}")
    edges = edges.select("i", "j").distinct()
    if policy == "nearest":
        if nearest is None:
            raise ValueError("the repair of islands needs nearest neighbours")
        edges = graph.island_repair(edges, nearest.join(lone, "i", "left_semi"))
    one = F.lit(1.0)
    return edges.select("i", "j", (one / F.count("*").over(Window.partitionBy("i")) if transform == "r" else one).alias("w"))


def weights_report(keys: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """One row: n, islands, least, mean and most neighbours, per cent of pairs that are edges, and whether all edges go both ways."""
    near = keys.select(F.col(key).alias("i")).distinct().join(edges.groupBy("i").agg(F.countDistinct("j").alias("k")), "i", "left").na.fill(0, ["k"])
    both = edges.select("i", "j").distinct()
    one_way = both.join(both.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"], "left_anti").agg((F.count("*") == 0).alias("symmetric"), F.lit(1).alias("_k"))
    out = near.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("islands"), F.min("k").alias("least"), F.avg("k").alias("mean"), F.max("k").alias("most"), F.sum("k").alias("edges"), F.lit(1).alias("_k"))
    n = F.col("n").cast("double")
    return out.join(one_way, "_k").select("n", "islands", "least", "mean", "most", (100 * F.col("edges") / F.nullif(n * n, F.lit(0.0))).alias("percent_nonzero"), "symmetric")


def nearest_target(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, col, distance) from each cell to the nearest target, however far, in cells; no rows without targets.

    Targets are sought in the nine buckets around a cell, whose width doubles until each
    cell's distance is proven; tables are written between rounds.
    """
    t = graph.written(targets.select(F.col("row").alias("tr"), F.col("col").alias("tc")).distinct())
    left = graph.written(cells.select("row", "col").distinct())
    ends = left.select("row", "col").union(t.select("tr", "tc")).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if t.isEmpty() or ends[0] is None:
        return left.limit(0).withColumn("distance", F.lit(0.0))
    reach, side, out = max(ends[1] - ends[0], ends[3] - ends[2]) + 1, 4, None
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    squared = (F.col("row") - F.col("tr")) * (F.col("row") - F.col("tr")) + (F.col("col") - F.col("tc")) * (F.col("col") - F.col("tc"))
    while True:
        bucket = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        sent = t.withColumn("s", F.explode(steps)).select("tr", "tc", (bucket("tr") + F.col("s.a")).alias("br"), (bucket("tc") + F.col("s.b")).alias("bc"))
        best = left.withColumns({"br": bucket("row"), "bc": bucket("col")}).join(sent, ["br", "bc"]).groupBy("row", "col").agg(F.min(squared).alias("d"))
        last = side > reach
        found = graph.written(best if last else best.where(F.col("d") <= side * side))
        out = found if out is None else out.union(found)
        left = graph.written(left.join(found, ["row", "col"], "left_anti"))
        if last or left.isEmpty():
            return out.select("row", "col", F.sqrt(F.col("d").cast("double")).alias("distance"))
        side *= 2


def ring(cells: DataFrame, base: DataFrame, inner: float, outer: float) -> DataFrame:
    """Cells farther than ``inner`` and no farther than ``outer`` from the base cells."""
    return landscape.near_cells(cells, base, outer).where(F.col("distance") > inner)


def ocean_distance(cells: DataFrame, value: str, water: int, least: int, cell_km: float) -> DataFrame:
    """(row, col, km) to the nearest cell of a water patch of at least ``least`` cells; smaller waters are ponds."""
    wet = landscape.patches(cells, value, water)
    large = wet.groupBy("patch").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return nearest_target(cells, wet.join(large, "patch", "left_semi")).select("row", "col", (F.col("distance") * cell_km).alias("km"))


def burnt(cells: DataFrame, boxes: DataFrame, code: str, side: float) -> DataFrame:
    """Cells with the least ``code`` of the boxes (x0, y0, x1, y1) that hold their centres, 0 outside of all."""
    x, y = F.col("col") + 0.5, F.col("row") + 0.5
    sent = boxes.withColumn("_bx", F.explode(_buckets(F.col("x0"), F.col("x1"), side))).withColumn("_by", F.explode(_buckets(F.col("y0"), F.col("y1"), side)))
    own = cells.withColumns({"_x": x, "_y": y}).withColumns({"_bx": F.floor(F.col("_x") / side), "_by": F.floor(F.col("_y") / side)})
    held = own.join(sent, ["_bx", "_by"]).where("_x >= x0 AND _x < x1 AND _y >= y0 AND _y < y1").groupBy("row", "col").agg(F.min(code).alias("zone"))
    return cells.join(held, ["row", "col"], "left").na.fill(0, ["zone"])


def nested(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Fine cells with the columns of the coarse cell that holds them; cells that do not nest in the other grid go."""
    names = [c for c in coarse.columns if c not in ("row", "col")]
    return fine.withColumns({"_r": F.floor(F.col("row") / factor), "_c": F.floor(F.col("col") / factor)}).join(coarse.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *names), ["_r", "_c"]).drop("_r", "_c")


def window(cells: DataFrame, rows: Sequence[int], cols: Sequence[int]) -> DataFrame:
    """Cells of a half-open window of rows and columns."""
    return cells.where((F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1]))


def adjacent_zones(zones: DataFrame, key: str, within: Column, distances: DataFrame, edges: DataFrame, reaches: Sequence[float]) -> DataFrame:
    """Per zone: ``within``, whether a zone that is within lies inside each reach (by ``distances`` i, j, distance), and whether one borders it.

    A zone that is within itself is adjacent to none.
    """
    marked = zones.select(F.col(key).alias("i"), F.coalesce(within, F.lit(False)).alias("within"))
    wet = marked.where("within").select(F.col("i").alias("j"))
    near = distances.join(wet, "j").groupBy("i").agg(F.min("distance").alias("d"))
    border = edges.join(wet, "j").select("i").distinct().withColumn("borders", F.lit(True))
    out = marked.join(near, "i", "left").join(border, "i", "left")
    dry = ~F.col("within")
    return out.select("i", "within", *[(dry & F.coalesce(F.col("d") <= r, F.lit(False))).alias(f"within_{r:g}") for r in reaches], (dry & F.coalesce("borders", F.lit(False))).alias("borders"))


def planar_area(ring_: Column) -> Column:
    """Area of a ring (array<struct<x, y>>) by the shoelace rule, whichever way it runs."""
    step = lambda p, i: p["x"] * F.get(ring_, (i + 1) % F.size(ring_))["y"] - F.get(ring_, (i + 1) % F.size(ring_))["x"] * p["y"]
    return F.abs(F.aggregate(F.transform(ring_, step), F.lit(0.0), lambda a, b: a + b)) / 2


def envelope(cells: DataFrame, inside: Column) -> DataFrame:
    """The bounds of the cells under a condition, as one row: row0, row1, col0, col1 (the ends exclusive)."""
    r, c = F.when(inside, F.col("row")), F.when(inside, F.col("col"))
    return cells.agg(F.min(r).alias("row0"), (F.max(r) + 1).alias("row1"), F.min(c).alias("col0"), (F.max(c) + 1).alias("col1"))


def steps_within(reach: float) -> list[tuple[int, int]]:
    """Offsets of the cells whose centres lie within ``reach`` cells, the centre left out."""
    n = math.floor(reach)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if (a, b) != (0, 0) and a * a + b * b <= reach * reach]
