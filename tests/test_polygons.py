"""Rings, holes and shared borders against plain geometry; buckets that split."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skyloom.operators import buckets, graph, polygons, spatial

RINGS = "rings array<array<struct<x: double, y: double>>>"


def star(rng, x, y, r, n):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turn]


def within(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_points_in_parts_and_holes(spark):
    """Random polygons of one to three parts, some with holes, crowded and scattered points; small and large buckets."""
    rng = random.Random(1)
    shapes = {}
    for k in range(25):
        parts = [star(rng, rng.uniform(0, 20), rng.uniform(0, 20), 4, rng.randrange(3, 9)) for _ in range(rng.randrange(1, 4))]
        shapes[k] = parts + [[((x - sum(p[0] for p in r) / len(r)) * 0.4 + sum(p[0] for p in r) / len(r), (y - sum(p[1] for p in r) / len(r)) * 0.4 + sum(p[1] for p in r) / len(r)) for x, y in r] for r in parts if rng.random() < 0.5]
    points = [(i, rng.uniform(-2, 22), rng.uniform(-2, 22)) for i in range(200)] + [(200 + i, 7 + rng.random() / 50, 9 + rng.random() / 50) for i in range(300)] + [(500 + i, 7.5, 9.5) for i in range(40)]
    want = sorted((i, k) for i, x, y in points for k, r in shapes.items() if within(x, y, r))
    p = spark.createDataFrame([*points, (900, None, 1.0)], "i long, px double, py double")
    z = spark.createDataFrame([*shapes.items(), (99, [])], f"k long, {RINGS}")
    for side, most in ((5.0, 100_000), (6.0, 10), (0.7, 3)):
        assert sorted(map(tuple, polygons.points_in_polygons(p, z, "px", "py", "rings", side, most).select("i", "k").collect())) == want


def test_a_crowded_bucket_is_split(spark):
    """Nine tenths of the points in one bucket: no bucket's share is above ``most``, and rows are those of one fixed width."""
    rng = random.Random(2)
    points = spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) if i % 10 == 0 else (i, 50 + rng.random() ** 4, 50 + rng.random() ** 4) for i in range(6000)] + [(6000 + i, 51.5, 51.5) for i in range(500)], "i long, x double, y double")
    zones = spark.createDataFrame([(k, [(k * 9.0, k * 9.0), (k * 9.0 + 15, k * 9.0), (k * 9.0 + 15, k * 9.0 + 15), (k * 9.0, k * 9.0 + 15)]) for k in range(10)] + [(10, [(50.0, 50.0), (50.2, 50.0), (50.0, 50.2)])], "k long, ring array<struct<x: double, y: double>>")
    tree = buckets.Buckets(points, "x", "y", 10.0, 100)
    assert len(tree.full) > 3 and points.groupBy(F.floor(F.col("x") / 10), F.floor(F.col("y") / 10)).count().agg(F.max("count")).first()[0] > 5000
    placed = tree.placed(points, "x", "y")
    sizes = placed.groupBy(*buckets.KEYS).count()
    assert placed.count() == 6500 and sizes.where("_part = 0").agg(F.max("count")).first()[0] <= 130 and sizes.agg(F.max("count")).first()[0] <= 130
    got = polygons.points_in_polygons(points, zones.withColumn("rings", F.array("ring")), "x", "y", "rings", 10.0, 100).select("i", "k").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, spatial.points_in_polygons(points, zones, "x", "y", "ring", 10.0).select("i", "k").collect()))


def tiling(rng, side):
    """Cells of a jittered lattice on whole numbers, some pairs merged, so that borders have corners of one side only."""
    at = {(r, c): (c * 100 + rng.randrange(-30, 31), r * 100 + rng.randrange(-30, 31)) for r in range(side + 1) for c in range(side + 1)}
    ring = lambda r, c: [at[r, c], at[r, c + 1], at[r + 1, c + 1], at[r + 1, c]]
    return {r * side + c: [ring(r, c)] for r in range(side) for c in range(side)}


def on(p, a, b):
    return (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def plain_borders(shapes):
    length, queen = defaultdict(float), set()
    edges = {k: [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a != b] for k, rings in shapes.items()}
    for i in shapes:
        for j in shapes:
            if i == j:
                continue
            for a, b in edges[i]:
                for p, q in edges[j]:
                    if any(on(v, p, q) for v in (a, b)) or any(on(v, a, b) for v in (p, q)):
                        queen.add((i, j))
                    d = (b[0] - a[0], b[1] - a[1])
                    if all(d[0] * (v[1] - a[1]) == d[1] * (v[0] - a[0]) for v in (p, q)):
                        t = sorted(Fraction((v[0] - a[0]) * d[0] + (v[1] - a[1]) * d[1], d[0] ** 2 + d[1] ** 2) for v in (p, q))
                        run = min(t[1], 1) - max(t[0], 0)
                        if run > 0:
                            length[i, j] += float(run) * math.hypot(*d)
    return dict(length), queen


@pytest.mark.parametrize("stretch", [1 << 20, 37])
def test_borders(spark, stretch):
    rng = random.Random(3)
    shapes = tiling(rng, 4)
    shapes |= {100: [[(1000, 0), (1300, 0), (1300, 300), (1000, 300)], [(1100, 100), (1100, 200), (1200, 200), (1200, 100)]], 101: [[(1100, 100), (1200, 100), (1200, 200), (1100, 200)]], 102: [[(1300, 50), (1400, 50), (1400, 120), (1300, 250)]], 103: [[(1300, 300), (1400, 300), (1400, 400)]], 104: [[(1150, 300), (1100, 400), (1200, 400)]], 105: [[(1600, 0), (1700, 0), (1700, 10)], [(1800, 0), (1900, 0), (1900, 10)]], 106: [[(1700, 0), (1800, 0), (1750, 60)]], 107: [[(5000, 5000), (5001, 5000), (5001, 5000), (5001, 5001)]]}
    df = spark.createDataFrame([(k, [[(x / 100, y / 100) for x, y in r] for r in rings]) for k, rings in shapes.items()], f"k long, {RINGS}")
    length, queen = plain_borders(shapes)
    got = {(r["i"], r["j"]): r["length"] for r in polygons.shared_borders(df, "k", "rings", 0.01, stretch).collect()}
    assert got == pytest.approx({k: v / 100 for k, v in length.items()})
    for most in (100_000, 4):
        assert {tuple(r) for r in polygons.touching(df, "k", "rings", 0.01, 3.0, most).collect()} == queen
    assert (100, 104) in queen and (100, 104) not in length and (100, 101) in length and (100, 103) in queen - set(length)


def test_steps_are_released(spark):
    from pathlib import Path

    graph.written(spark.range(3))
    folder = Path(graph.shared_folder(spark))
    assert list(folder.glob("step-*")) and graph.release(spark) > 0 and not list(folder.glob("step-*"))


def test_long_lines_are_many_small_meetings(spark):
    """Segments of one long line meet only those near them, whatever the snap is, and are not one task's."""
    df = spark.range(3000).select(F.col("id").alias("k"), F.expr("array(array(struct(0.0D AS x, id * 1.0D AS y), struct(1.0D AS x, id * 1.0D AS y), struct(1.0D AS x, id + 1.0D AS y), struct(0.0D AS x, id + 1.0D AS y)))").alias("rings"))
    out = polygons.shared_borders(df, "k", "rings", 0.01)
    assert sorted(map(tuple, out.where("i < j").collect())) == [(k, k + 1, pytest.approx(1.0)) for k in range(2999)]
    before = graph.PART_ROWS
    try:
        graph.PART_ROWS = 1000
        plan = polygons.shared_borders(df, "k", "rings", 0.01)
        counts = plan.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        graph.PART_ROWS = before
    assert len(counts) > 4 and max(r["count"] for r in counts) < 1000
