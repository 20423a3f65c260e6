"""Connected components of an edge table, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import durable


def _step(edges: DataFrame) -> tuple[DataFrame, bool]:
    """A step's edges (a, b) as a written table, and whether any of them was moved."""
    seen = Observation()
    out = durable(edges.observe(seen, F.count_if("moved").alias("n")).select("a", "b"), "cc")
    return out, seen.get["n"] > 0


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (u, v); the component's id is its smallest id.

    Alternating large-star and small-star steps: each hangs neighbours below the
    smallest one, by a minimum that is pre-aggregated and a join, so a hub does not
    gather its neighbours in one group.  A step makes one edge of each and drops none,
    so equal edges stay until the end, which saves a shuffle a step.  Once a step of
    each kind has moved no edge, one after the other, the edges are stars.
    Each step's edges are written to the shared folder.  No links: no rows.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    moved, large = (True, True), True
    while any(moved):
        if large:
            both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
            low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
            step = edges.withColumnRenamed("b", "x").join(low, "x").select("a", F.col("m").alias("b"), F.expr("m <> x").alias("moved"))
        else:
            low = edges.groupBy("a").agg(F.min("b").alias("m"))
            step = edges.join(low, "a").select(F.expr("if(b = m, a, b)").alias("a"), F.col("m").alias("b"), F.expr("b <> m").alias("moved"))
        edges, now = _step(step)
        moved, large = (moved[1], now), not large
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("component_id")), F.struct(F.col("b").alias("id"), F.col("b").alias("component_id"))))).distinct()
