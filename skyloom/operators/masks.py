"""Masks of cells: water by several signs, urban and rural sides of a contrast, trees within sight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import spatial


def months_between(month: Column, first: int, last: int) -> Column:
    """Whether a month lies in a season, which may run over the turn of the year."""
    if not 1 <= first <= 12 or not 1 <= last <= 12:
        raise ValueError("months run from 1 to 12")
    return month.between(first, last) if first <= last else (month >= first) | (month <= last)


def water(index: Column, frequency: Column, occurrence: Column, limits: tuple[float, float, float]) -> Column:
    """Water by any of three signs: an index above its limit, a share of wet looks above its own, a long-run occurrence at its own at least.

    A sign that is missing says nothing.
    """
    a, b, c = limits
    if not -1 <= a <= 1 or not 0 <= b <= 1 or not 0 <= c <= 100:
        raise ValueError("limits of an index lie in -1..1, of a frequency in 0..1, of an occurrence in 0..100")
    sign = lambda x: F.coalesce(x, F.lit(False))
    return sign(index > a) | sign(frequency > b) | sign(occurrence >= c)


def watered(scenes: DataFrame, keys: Sequence[str], green: str, infrared: str, flag: str, occurrence: DataFrame, limits: tuple[float, float, float]) -> DataFrame:
    """(keys, water) of cells: the index of the medians, the mean of the flag, and the occurrence table joined by the keys."""
    by = scenes.groupBy(*keys).agg(F.median(green).alias("_g"), F.median(infrared).alias("_i"), F.avg(F.col(flag).cast("double")).alias("_f"))
    index = (F.col("_g") - F.col("_i")) / F.nullif(F.col("_g") + F.col("_i"), F.lit(0.0))
    joined = by.join(occurrence, list(keys), "left")
    return joined.select(*keys, water(index, F.col("_f"), F.col("occurrence"), limits).alias("water"))


#: Built and natural classes of the local climate scheme.
BUILT, NATURAL = range(1, 11), range(11, 18)


def checked_classes(urban: Sequence[int], rural: Sequence[int]) -> tuple[list[int], list[int]]:
    """Class lists of both sides; refused if empty, out of their range, or overlapping."""
    if not urban or not rural or any(c not in BUILT for c in urban) or any(c not in NATURAL for c in rural):
        raise ValueError("urban classes are built ones, rural classes natural ones, and neither list is empty")
    return list(urban), list(rural)


def checked_ring(inner: float, outer: float) -> tuple[float, float]:
    """The edges of a ring, if they are positive and in order."""
    if not 0 < inner < outer:
        raise ValueError("a ring's edges are positive, the inner one below the outer one")
    return inner, outer


def contrast_sides(method: str, zone: Column, distance: Column, climate: Column, is_water: Column, height: Column, ring: tuple[float, float], urban: Sequence[int], rural: Sequence[int], cap: float | None = None, leave_out: Sequence[str] = ("water", "built")) -> tuple[Column, Column]:
    """(urban, rural) sides of a definition.

    ring: the zone itself against cells at a distance between the ring's edges, without
    what is left out; climate: cells of urban against cells of rural classes.  Water is
    on neither urban nor climate-defined rural side, and rural cells lie no higher than ``cap``.
    """
    inner, outer = checked_ring(*ring)
    urban, rural = checked_classes(urban, rural)
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = F.lit(True) if cap is None else yes(height <= cap)
    if method == "ring":
        side = yes((distance > inner) & (distance <= outer))
        side = side & no(is_water) if "water" in leave_out else side
        side = side & no(climate.isin(*urban)) if "built" in leave_out else side
        return yes(zone) & no(is_water), side & low
    if method == "climate":
        return yes(climate.isin(*urban)) & no(is_water), yes(climate.isin(*rural)) & no(is_water) & low
    raise ValueError(f"no definition {method!r}; there are ring and climate")


def trees_in_sight(cells: DataFrame, tree: Column, home: Column, reach: float, least: int) -> DataFrame:
    """(zone, homes, seen, percent): homes with at least ``least`` tree cells within ``reach`` cells, by an equi-join on shifted cells."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 0), *spatial.steps_within(reach)]])
    sent = cells.where(tree).select("row", "col", F.explode(steps).alias("s")).select((F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))
    near = sent.groupBy("row", "col").agg(F.count("*").alias("_trees"))
    homes = cells.where(home).select("row", "col", "zone").join(near, ["row", "col"], "left")
    out = homes.groupBy("zone").agg(F.count("*").alias("homes"), F.count_if(F.coalesce(F.col("_trees") >= least, F.lit(False))).alias("seen"))
    return out.withColumn("percent", 100.0 * F.col("seen") / F.col("homes"))
