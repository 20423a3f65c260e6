"""Refusals: products are not made when their evidence is missing or failing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error that names keys that come twice."""
    twice = df.groupBy(*keys).count().where("count > 1").select(*keys).limit(5).collect()
    if twice:
        raise ValueError(f"{', '.join(keys)} is not unique, as in {[tuple(r) for r in twice]}")
    return df


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``, or an error that names columns with nulls; one pass over the table."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict()
    if bad := {c: n for c, n in nulls.items() if n}:
        raise ValueError(f"nulls in {bad}")
    return df


def product(report: dict, most_outside: float = 0.05) -> dict:
    """The validation report, if it supports a product.

    Metrics must be there and finite, held out, above the no-change kappa, and the
    share of the target outside the training range at most ``most_outside``.
    """
    for name in ("kappa", "no_change_kappa", "outside_share", "held_out"):
        if report.get(name) is None:
            raise ValueError(f"the report has no {name}")
    if not all(math.isfinite(report[x]) for x in ("kappa", "no_change_kappa", "outside_share")):
        raise ValueError("a metric is not finite")
    if not report["held_out"]:
        raise ValueError("the metrics are not held out")
    if report["kappa"] <= report["no_change_kappa"]:
        raise ValueError("the model is no better than no change")
    if report["outside_share"] > most_outside:
        raise ValueError("too much of the target is outside the training range")
    return report


def enough_blocks(df: DataFrame, block: str, least: int) -> dict:
    """Rows, blocks and median rows of a block, or an error if there are too few blocks to hold any out."""
    one = df.groupBy(block).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.count("*").alias("blocks"), F.median("n").alias("median")).first()
    if one["blocks"] < least:
        raise ValueError(f"{one['blocks']} blocks in {one['rows'] or 0} rows are fewer than {least}")
    return {"rows": one["rows"], "blocks": one["blocks"], "median": one["median"]}


def consistent(ratio: float, most: float = 0.1) -> float:
    """The consistency ratio of judgements, if it is a number and not above ``most``."""
    if not math.isfinite(ratio) or ratio > most:
        raise ValueError(f"the judgements' consistency ratio is {ratio}, at most {most} is allowed")
    return ratio


def scored_share(df: DataFrame, status: str, insufficient: str, least: float) -> float:
    """The share of zones that could be scored, if there are zones and it is not below ``least``."""
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col(status) != insufficient).alias("k")).first()
    share = one["k"] / one["n"] if one["n"] else 0.0
    if not one["n"] or share < least:
        raise ValueError(f"{one['k']} of {one['n']} zones are scored, fewer than {least:.0%}")
    return share


def expected_area(cells: int, side_m: float, expected_km2: float, tolerance: float = 0.2) -> float:
    """The departure of a grid's area from what is expected, if it is within the tolerance."""
    departure = cells * side_m * side_m / 1e6 / expected_km2 - 1
    if abs(departure) > tolerance:
        raise ValueError(f"the grid's area departs by {departure:+.0%} from the expected one")
    return departure


def refinement(fine: Sequence[int], coarse: Sequence[int], factor: int) -> int:
    """The factor of two nested grids, if the fine one has exactly so many cells for each coarse one."""
    if factor < 1 or list(fine) != [n * factor for n in coarse]:
        raise ValueError(f"a grid of {list(fine)} does not refine one of {list(coarse)} {factor} times")
    return factor


def within_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> dict:
    """Least and greatest value of each column, or an error that names those outside their range or all null; one pass over the table."""
    one = df.agg(*[f(c).alias(f"{n}:{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]).first().asDict()
    seen = {c: (one[f"min:{c}"], one[f"max:{c}"]) for c in ranges}
    if bad := {c: v for c, v in seen.items() if v[0] is None or v[0] < ranges[c][0] or v[1] > ranges[c][1]}:
        raise ValueError(f"out of range: {bad}")
    return seen


def annual_series(df: DataFrame, keys: Sequence[str], year: str, first: int, last: int) -> DataFrame:
    """``df``, if every series has each year from first to last once and no other; a trend needs two years at least."""
    if last <= first:
        raise ValueError("a trend needs two years at least")
    odd = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(year).alias("d"), F.min(year).alias("a"), F.max(year).alias("b")).where(F.expr(f"n <> d OR d <> {last - first + 1} OR a <> {first} OR b <> {last}"))
    if names := [tuple(r) for r in odd.select(*keys).limit(5).collect()]:
        raise ValueError(f"series are not annual from {first} to {last}, as {names}")
    return df
