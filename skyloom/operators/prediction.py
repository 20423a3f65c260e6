"""Land-change projection and its tests: no-change baselines, scoring masks, class profiles, cross-checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import agreement, landscape


def scored(cells: DataFrame, maps: Sequence[str], immutable: Sequence[int], within: Column | None = None) -> DataFrame:
    """Cells that no map has in an immutable class, within the condition."""
    keep = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    for m in maps:
        keep = keep & ~F.coalesce(F.col(m).isin(*immutable), F.lit(False)) if immutable else keep
    return cells.where(keep)


def mask_report(cells: DataFrame, maps: Sequence[str], immutable: Sequence[int], within: Column | None = None) -> DataFrame:
    """One row: cells within, scored cells, left-out cells and their share."""
    inside = cells if within is None else cells.where(within)
    total = inside.agg(F.count("*").alias("n_total"), F.lit(1).alias("_k"))
    left = scored(inside, maps, immutable).agg(F.count("*").alias("n_scored"), F.lit(1).alias("_k"))
    out = F.col("n_total") - F.col("n_scored")
    return total.join(left, "_k").select("n_total", "n_scored", out.alias("n_excluded"), F.coalesce(out / F.nullif(F.col("n_total"), F.lit(0)), F.lit(0.0)).alias("excluded_share"))


def validated(cells: DataFrame, before: str, truth: str, guess: str) -> DataFrame:
    """One row: kappa of the projection, of the map that says nothing changes, their difference, disagreements and figure of merit."""
    k = F.lit(1).alias("_k")
    fit = agreement.agreement(agreement.confusion(cells, truth, guess)).select("kappa", "quantity", "allocation", k)
    null = agreement.agreement(agreement.confusion(cells, truth, before)).select(F.col("kappa").alias("persistence_kappa"), k)
    merit = agreement.figure_of_merit(cells, before, truth, guess).select("merit", k)
    return fit.join(null, "_k").join(merit, "_k").select("kappa", "persistence_kappa", (F.col("kappa") - F.col("persistence_kappa")).alias("above_null"), "quantity", "allocation", "merit")


def painted(cells: DataFrame, code: str, profile: DataFrame, predictors: Sequence[str]) -> DataFrame:
    """Cells with their class's profile in place of their own predictors; a class without profile has nulls.  The profile is a row per class and is broadcast."""
    rest = [c for c in cells.columns if c not in predictors]
    return cells.select(*rest).join(F.broadcast(profile.select(code, *predictors)), code, "left").select(*cells.columns)


def shifted(cells: DataFrame, code: str, eligible: Column, profile: DataFrame, target: int, share: float, predictors: Sequence[str]) -> DataFrame:
    """Cells whose predictors are moved by ``share`` of the way to the target class's profile where eligible."""
    if not 0 <= share <= 1:
        raise ValueError("the share is not between 0 and 1")
    centre = profile.where(F.col(code) == target).select(*[F.col(c).alias(f"_t_{c}") for c in predictors], F.lit(1).alias("_k"))
    out = cells.withColumns({"_k": F.lit(1), "_e": F.coalesce(eligible, F.lit(False))}).join(F.broadcast(centre), "_k")
    return out.withColumns({c: F.when(F.col("_e"), F.col(c) * (1 - share) + F.col(f"_t_{c}") * share).otherwise(F.col(c)) for c in predictors}).select(*cells.columns)


def projected(cells: DataFrame, early: str, late: str, codes: Sequence[int], steps: int, seed: int = 42) -> DataFrame:
    """The map after ``steps`` more intervals: transition shares of two maps, projected areas, and their allocation by neighbourhood.

    Only the classes' counts and shares, a number per pair of classes, are the driver's.
    """
    known = cells.where(F.col(early).isin(*codes) & F.col(late).isin(*codes))
    pairs = {(r[0], r[1]): r[2] for r in known.groupBy(early, late).agg(F.count("*")).collect()}
    current = {c: sum(n for (_, b), n in pairs.items() if b == c) for c in codes}
    left = {a: sum(n for (x, _), n in pairs.items() if x == a) for a in codes}
    share = {(a, b): pairs.get((a, b), 0) / left[a] if left[a] else float(a == b) for a in codes for b in codes}
    raw = {c: float(n) for c, n in current.items()}
    for _ in range(steps):
        raw = {b: sum(raw[a] * share[a, b] for a in codes) for b in codes}
    whole = {c: math.floor(round(x, 9)) for c, x in raw.items()}
    whole[max(codes, key=lambda c: (raw[c], -c))] += sum(current.values()) - sum(whole.values())
    return landscape.allocate(known, late, whole, seed=seed)


def projection_steps(first: int, last: int, wanted: Sequence[int], most_offset: int) -> list[tuple[int, int, int]]:
    """(year, steps, effective year) of each wanted year: whole intervals from the last base year, rounded half to even, one at least."""
    span = last - first
    if span <= 0:
        raise ValueError("the base years do not increase")
    out = []
    for year in wanted:
        if year <= last:
            raise ValueError(f"{year} is not after {last}")
        steps = max(round((year - last) / span), 1)
        effective = last + steps * span
        if abs(effective - year) > most_offset:
            raise ValueError(f"{year} lies {abs(effective - year)} years from the nearest step")
        out.append((year, steps, effective))
    return out


def cross_check(cells: DataFrame, fraction: str, code: str, built: int, threshold: float, cell_km2: float) -> DataFrame:
    """One row: cells that a built fraction dominates, cells projected as built, their difference, agreement over known cells, and both areas."""
    known = F.col(fraction).isNotNull() & ~F.isnan(F.col(fraction))
    dense = F.coalesce(known & (F.col(fraction) >= threshold), F.lit(False))
    own = F.coalesce(F.col(code) == built, F.lit(False))
    one = cells.agg(F.count_if(dense).alias("dominant"), F.count_if(own).alias("built"), (F.count_if(known & (dense == own)) / F.nullif(F.count_if(known), F.lit(0))).alias("agreement"))
    return one.select("dominant", "built", (F.col("built") - F.col("dominant")).alias("difference"), "agreement", (F.col("dominant") * cell_km2).alias("dominant_km2"), (F.col("built") * cell_km2).alias("built_km2"))


def compared_importance(a: DataFrame, b: DataFrame, name: str = "predictor", value: str = "importance") -> DataFrame:
    """Two importance tables side by side, features of either one kept: both values, both ranks (ties by name) and their difference."""
    from pyspark.sql import Window

    rank = lambda df, side: df.select(name, F.col(value).alias(f"{side}_importance"), F.row_number().over(Window.orderBy(F.desc(value), name)).alias(f"{side}_rank"))
    return rank(a, "a").join(rank(b, "b"), name, "outer").withColumn("difference", F.col("a_rank") - F.col("b_rank"))


def modal_grid(cells: DataFrame, value: str, factor: int, least: float = 0.5) -> DataFrame:
    """Coarser cells with the most frequent code (ties to the smallest) where at least ``least`` of their fine cells are known, else null."""
    at = cells.select(F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col"), F.col(value).alias("code"))
    counted = at.groupBy("row", "col", "code").agg(F.count("*").alias("n"))
    best = counted.groupBy("row", "col").agg(F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("n")).alias("m"), "code"))).alias("x"), (F.sum(F.when(F.col("code").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    return best.select("row", "col", F.when(F.col("coverage") >= least, F.col("x.code")).alias("code"), "coverage")
