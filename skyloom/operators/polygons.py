"""Polygons of several rings: points inside by even and odd crossings, shared borders by segments of one line.

A polygon is a key and its rings, array<array<struct<x, y>>>: outer rings of all its
parts and holes alike, closed or not, in either direction.  A point is inside if a ray
from it crosses the rings an odd number of times, which leaves holes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import buckets, graph


def is_within(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point is within the rings; on a border one side counts and the other does not; null coordinates are null."""

    def crossings(ring: Column) -> Column:
        def crosses(p: Column, i: Column) -> Column:
            q = F.get(ring, (i + 1) % F.size(ring))
            apart = (p["y"] > y) != (q["y"] > y)
            return F.when(apart & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(apart, q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b)

    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, b: a + b) % 2 == 1)


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of the rings."""
    of = lambda c: F.transform(F.flatten(rings), lambda p: p[c])
    return F.array_min(of("x")), F.array_min(of("y")), F.array_max(of("x")), F.array_max(of("y"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, rings: str, side: float, most: int = 100_000) -> DataFrame:
    """Rows of ``points`` with the columns of the polygons that hold them; points in none, or without coordinates, go.

    Points and polygons meet in buckets of width ``side`` that split where they hold more
    than ``most`` points, so a crowded place is many small tasks and an empty one few.
    """
    tree = buckets.Buckets(points, x, y, side, most)
    sent = tree.sent(polygons.where(F.size(F.flatten(rings)) > 0), *bounds(F.col(rings)))
    inside = tree.placed(points, x, y).join(sent, buckets.KEYS).where(is_within(F.col(x), F.col(y), F.col(rings)))
    return inside.drop(*buckets.KEYS)


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs that are not both 0; 91 steps do for any."""
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).alias("b")))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(91)), F.struct(F.abs(a).alias("a"), F.abs(b).alias("b")), step)["a"]
    return F.when(a == 0, F.abs(b)).when(b == 0, F.abs(a)).otherwise(steps)


def segments(polygons: DataFrame, key: str, rings: str, snap: float) -> DataFrame:
    """(key, ax, ay, bx, by): the rings' segments in whole multiples of ``snap``, lower end first; those without length go."""
    at = lambda p, c: F.round(p[c] / snap).cast("long")
    ring = polygons.select(F.col(key).alias("key"), F.explode(rings).alias("r"))
    pairs = F.transform("r", lambda p, i: F.struct(F.struct(at(p, "x").alias("x"), at(p, "y").alias("y")).alias("p"), F.struct(at(F.get("r", (i + 1) % F.size("r")), "x").alias("x"), at(F.get("r", (i + 1) % F.size("r")), "y").alias("y")).alias("q")))
    ends = ring.select("key", F.explode(pairs).alias("s")).select("key", F.least("s.p", "s.q").alias("a"), F.greatest("s.p", "s.q").alias("b")).where("a <> b")
    return ends.select("key", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def shared_borders(polygons: DataFrame, key: str, rings: str, snap: float = 1e-6, stretch: int | None = None) -> DataFrame:
    """(i, j, length), both ways: pairs of polygons whose borders run together, and how far (rook contiguity).

    Corners are snapped to multiples of ``snap``; coordinates are below 2^31 of them.  A
    segment lies on a line, which whole numbers name exactly, and takes an interval on it;
    only segments of one line whose intervals overlap count, so borders with corners at
    different places are found as well.  Lines are cut into stretches of so many multiples,
    by default four mean segments, so a long line is not one task and a segment meets only those
    near it, while the cuts add a quarter to the segments and at most one more to each.  Overlapping polygons share what
    their borders share; a border that runs to and fro counts each time.
    """
    s = segments(polygons, key, rings, snap).withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")})
    n, mean = s.agg(F.count("*"), F.avg(F.when(F.col("dx") != 0, F.col("dx")).otherwise(F.col("dy")))).first()
    stretch = stretch or max(1, round(4 * (mean or 0)))
    s = s.withColumn("g", F.greatest(_gcd(F.col("dx"), F.col("dy")), F.lit(1).cast("long"))).withColumns({"dx": F.expr("dx div g"), "dy": F.expr("dy div g")})
    # The line is the direction (lower end first, so it has one sign) and its distance from the origin; along it, x counts, or y where x stands.
    s = s.withColumns({"c": F.col("dx") * F.col("ay") - F.col("dy") * F.col("ax"), "lo": F.when(F.col("dx") != 0, F.col("ax")).otherwise(F.col("ay")), "hi": F.when(F.col("dx") != 0, F.col("bx")).otherwise(F.col("by"))})
    s = s.withColumn("at", F.explode(F.sequence(F.floor(F.col("lo") / stretch), F.floor((F.col("hi") - 1) / stretch))))
    s = s.select("dx", "dy", "c", "at", "key", F.greatest("lo", F.col("at") * stretch).alias("lo"), F.least("hi", (F.col("at") + 1) * stretch).alias("hi"))
    line = ["dx", "dy", "c", "at"]
    s = graph.dealt(s, 2 * n, *line)
    a, b = s.select(*line, F.col("key").alias("i"), "lo", "hi"), s.select(*line, F.col("key").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    run = F.least("hi", "hi2") - F.greatest("lo", "lo2")
    unit = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")) / F.when(F.col("dx") != 0, F.col("dx")).otherwise(F.col("dy")) * snap
    both = a.join(b, line).where((F.col("i") != F.col("j")) & (run > 0))
    return graph.dealt(both.select("i", "j", (run * unit).alias("length")), 2 * n, "i", "j").groupBy("i", "j").agg(F.sum("length").alias("length"))


def touching(polygons: DataFrame, key: str, rings: str, snap: float = 1e-6, side: float = 1.0, most: int = 100_000) -> DataFrame:
    """(i, j), both ways: pairs of polygons whose borders meet, in a point at least (queen contiguity).

    Borders that do not cross meet where a corner of one lies on a segment of the other;
    corners and segments are snapped and meet in buckets of width ``side`` that split where
    there are more than ``most`` corners.
    """
    s = segments(polygons, key, rings, snap)
    corners = graph.written(s.select(F.col("key").alias("i"), F.col("ax").alias("x"), F.col("ay").alias("y")).union(s.select("key", "bx", "by")).distinct())
    n = corners.count()
    tree = buckets.Buckets(corners, "x", "y", max(side / snap, 1.0), most)
    sent = tree.sent(s.withColumnRenamed("key", "j"), F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    on = ((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) == (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))) & F.col("x").between(F.least("ax", "bx"), F.greatest("ax", "bx")) & F.col("y").between(F.least("ay", "by"), F.greatest("ay", "by"))
    # The tree's own columns _bx and _by are numbers of buckets, ax to by are segments.
    placed, sent = (graph.dealt(t, n, *buckets.KEYS) for t in (tree.placed(corners, "x", "y"), sent))
    met = placed.join(sent, buckets.KEYS).where((F.col("i") != F.col("j")) & on)
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")
    return graph.dealt(met.select("i", "j").distinct().select(both).select("e.*"), 2 * n, "i", "j").distinct()
