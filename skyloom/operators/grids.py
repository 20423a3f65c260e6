"""Operators on cell tables (row, col, value): neighbours, focal shares, adjacency, regridding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offsets(reach: int, corners: bool = True) -> list[tuple[int, int]]:
    """Offsets of the square (or, without corners, the cross) window of a reach, the centre left out."""
    span = range(-reach, reach + 1)
    return [(a, b) for a in span for b in span if (a, b) != (0, 0) and (corners or a == 0 or b == 0)]


def neighbours(cells: DataFrame, window: Sequence[tuple[int, int]], value: str) -> DataFrame:
    """(row, col, near): each cell with the value of each neighbour in the grid, by an equi-join on shifted keys."""
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in window])
    sent = cells.select(F.col("row"), F.col("col"), F.col(value).alias("near"), F.explode(shifts).alias("s"))
    sent = sent.select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "near")
    return cells.select("row", "col", value).join(sent, ["row", "col"])


def focal_share(cells: DataFrame, value: str, code: int, reach: int) -> DataFrame:
    """Share of in-grid neighbours that have ``code``, the centre left out.

    A cell sends its mark to the places around it; these are summed where they arise and
    again by place, so no table of all pairs of neighbours is sorted.
    """
    shifts = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(True).alias("own")), *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(False).alias("own")) for a, b in offsets(reach)])
    sent = cells.where("row IS NOT NULL AND col IS NOT NULL").select("row", "col", (F.col(value) == code).alias("hit"), F.explode(shifts).alias("s"))
    sent = sent.select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"), "s.own", "hit")
    near = ~F.col("own")
    sums = sent.groupBy("row", "col").agg(F.max("own").alias("own"), F.count_if(near).alias("n"), F.count_if(near & F.col("hit")).alias("hits"))
    return sums.where("own AND n > 0").select("row", "col", (F.col("hits") / F.col("n")).alias("share"))


def aggregation_index(cells: DataFrame, value: str) -> DataFrame:
    """Like adjacencies of each code, of 4 neighbours and each pair once, as per cent of the most that its cells allow."""
    near = neighbours(cells, [(0, 1), (1, 0)], value)
    like = near.where(F.col(value) == F.col("near")).groupBy(value).agg(F.count("*").alias("like"))
    n = cells.groupBy(value).agg(F.count("*").alias("n"))
    side = F.floor(F.sqrt(F.col("n").cast("double")))
    rest = F.col("n") - side * side
    most = 2 * side * (side - 1) + F.when(rest == 0, 0).when(rest <= side, 2 * rest - 1).otherwise(2 * rest - 2)
    return n.join(like, value, "left").na.fill(0, ["like"]).select(value, "n", "like", (100.0 * F.col("like") / F.nullif(most, F.lit(0))).alias("index"))


def adjacency(cells: DataFrame, value: str, code: int) -> DataFrame:
    """Edges (i, j) between 8-neighbouring cells of one code; a cell's key is its struct of row and col as text."""
    chosen = cells.where(F.col(value) == code)
    key = lambda r, c: F.col(r) * F.lit(1_000_000) + F.col(c)
    sent = chosen.select((F.col("row")).alias("r0"), F.col("col").alias("c0"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]])).alias("s"))
    sent = sent.select("r0", "c0", (F.col("r0") + F.col("s.a")).alias("row"), (F.col("c0") + F.col("s.b")).alias("col"))
    return sent.join(chosen.select("row", "col"), ["row", "col"]).select(key("r0", "c0").alias("i"), key("row", "col").alias("j"))


def regrid(cells: DataFrame, factor: int, figures: Sequence[Column]) -> DataFrame:
    """Coarser cells of ``factor`` by ``factor``, with the given aggregates."""
    return cells.groupBy(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(*figures)


def block_id(x: Column, y: Column, size: float) -> Column:
    """The square block of a point, as a struct that orders as its lower corner does."""
    return F.struct(F.floor(x / size).alias("bx"), F.floor(y / size).alias("by"))
