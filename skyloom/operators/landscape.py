"""Patches, service areas, distances and land-change allocation on cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators import graph, grids

_KEY = 1_000_000


def patches(cells: DataFrame, value: str, code: int) -> DataFrame:
    """(row, col, patch): 8-connected patches of a code, named by their least cell key."""
    found = graph.connected(grids.adjacency(cells, value, code))
    return found.select(F.floor(F.col("i") / _KEY).alias("row"), (F.col("i") % _KEY).alias("col"), F.col("component").alias("patch"))


def qualifying(patched: DataFrame, cell_ha: float, least_ha: float = 0.5) -> DataFrame:
    """Cells of patches of at least ``least_ha``, with a slack of 1e-9."""
    big = patched.groupBy("patch").agg(F.count("*").alias("cells")).where(F.col("cells") * cell_ha >= least_ha - 1e-9)
    return patched.join(big, "patch").select("row", "col", "patch")


def landscape(cells: DataFrame, patched: DataFrame, value: str, code: int, cell_ha: float) -> DataFrame:
    """One row: area, patches, mean and largest patch, largest-patch index, and edges against other codes."""
    sizes = patched.groupBy("patch").agg(F.count("*").alias("n"))
    total = cells.agg(F.count("*").alias("valid")).withColumn("k", F.lit(1))
    near = grids.neighbours(cells, [(0, 1), (1, 0)], value)
    edges = near.agg(F.count_if((F.col(value) == code) != (F.col("near") == code)).alias("edges")).withColumn("k", F.lit(1))
    out = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count("*").alias("patches"), F.max("n").alias("most")).withColumn("k", F.lit(1)).join(total, "k").join(edges, "k")
    return out.select((F.col("cells") * cell_ha).alias("area_ha"), "patches", (F.col("cells") / F.nullif(F.col("patches"), F.lit(0)) * cell_ha).alias("mean_patch_ha"), (100.0 * F.coalesce("most", F.lit(0)) / F.nullif(F.col("valid"), F.lit(0))).alias("largest_patch_index"), "edges")


def near_cells(cells: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """(row, col, distance) of cells within ``reach`` cells of a target, to the nearest one.

    A range join by buckets: targets are sent to the nine buckets around them, so a
    cell meets only targets of its own bucket.
    """
    side = max(1, math.ceil(reach))
    bucket = lambda c: F.floor(F.col(c) / side)
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    t = targets.select(F.col("row").alias("tr"), F.col("col").alias("tc")).withColumn("s", F.explode(steps))
    t = t.select("tr", "tc", (bucket("tr") + F.col("s.a")).alias("br"), (bucket("tc") + F.col("s.b")).alias("bc"))
    c = cells.select("row", "col", bucket("row").alias("br"), bucket("col").alias("bc"))
    squared = (F.col("row") - F.col("tr")) * (F.col("row") - F.col("tr")) + (F.col("col") - F.col("tc")) * (F.col("col") - F.col("tc"))
    best = c.join(t, ["br", "bc"]).groupBy("row", "col").agg(F.min(squared).alias("d"))
    return best.where(F.col("d") <= reach * reach).select("row", "col", F.sqrt(F.col("d").cast("double")).alias("distance"))


def scenario(cells: DataFrame, eligible: Column, order: Column, share: float, new_code: int, value: str) -> DataFrame:
    """``cells`` with the first ``share`` of the eligible ones, by ``order``, turned to ``new_code``."""
    marked = cells.withColumn("_e", eligible)
    turn = F.row_number().over(Window.partitionBy("_e").orderBy(order, "row", "col"))
    take = F.floor(F.count("*").over(Window.partitionBy("_e")) * share)
    return marked.withColumn("changed", F.col("_e") & (turn <= take)).withColumn(value, F.when(F.col("changed"), new_code).otherwise(F.col(value))).drop("_e")


def allocate(cells: DataFrame, value: str, demand: dict[int, int], reach: int = 1, seed: int = 42) -> DataFrame:
    """Cells changed to meet ``demand`` (code to wanted cells): largest deficit first, one conversion per cell.

    A code takes the cells of greatest neighbourhood share among donors with a
    surplus, each donor giving no more than its surplus; ties by seeded hash.  The
    loop runs once per code; its few counts are the driver's, the cells stay.
    """
    work = graph.written(cells.select("row", "col", F.col(value).alias("code"), F.lit(False).alias("moved")))
    have = {r["code"]: r["n"] for r in work.groupBy("code").agg(F.count("*").alias("n")).collect()}
    gap = {c: demand.get(c, have.get(c, 0)) - have.get(c, 0) for c in {*demand, *have}}
    for code in sorted((c for c in gap if gap[c] > 0), key=lambda c: (-gap[c], c)):
        donors = [c for c in gap if gap[c] < 0]
        if not donors:
            break
        potential = grids.focal_share(work, "code", code, reach)
        jitter = F.md5(F.concat_ws(":", "row", "col", F.lit(str(seed))))
        pool = work.where(F.col("code").isin(donors) & ~F.col("moved")).join(potential, ["row", "col"], "left").na.fill(0.0, ["share"])
        first = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("share"), jitter))
        spare = F.element_at(F.create_map(*[F.lit(x) for c in donors for x in (c, -gap[c])]), F.col("code"))
        chosen = pool.withColumn("k", first).where(F.col("k") <= spare).orderBy(F.desc("share"), jitter).limit(gap[code]).select("row", "col", F.col("code").alias("old"))
        chosen = graph.written(chosen)
        for r in chosen.groupBy("old").agg(F.count("*").alias("n")).collect():
            gap[r["old"]] += r["n"]
            gap[code] -= r["n"]
        work = graph.written(work.join(chosen, ["row", "col"], "left").select("row", "col", F.when(F.col("old").isNotNull(), code).otherwise(F.col("code")).alias("code"), (F.col("moved") | F.col("old").isNotNull()).alias("moved")))
    return work.select("row", "col", "code", "moved")
