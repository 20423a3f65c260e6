"""Small rules with their checks: bit masks, names, dates, detection limits, direction of criteria."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_mask(bits: Sequence[int]) -> int:
    """The integer whose bits are set."""
    if any(b < 0 for b in bits):
        raise ValueError("a bit is negative")
    return sum(1 << b for b in set(bits))


def bit_range(bits: Sequence[int]) -> tuple[int, int]:
    """(shift, mask) of adjacent bits in rising order."""
    if not bits or list(bits) != list(range(bits[0], bits[0] + len(bits))):
        raise ValueError("the bits of a field are not adjacent")
    return bits[0], (1 << len(bits)) - 1


def label_map(labels: dict[int, str], width: int) -> Column:
    """A map column from every code of a bit field to its label; a code without label is refused."""
    if missing := [c for c in range(1 << width) if c not in labels]:
        raise ValueError(f"no labels for {missing}")
    return F.create_map(*[F.lit(x) for c in range(1 << width) for x in (c, labels[c])])


def clamped(start: Column, first: str) -> Column:
    """The later of a wanted start and a source's first date."""
    return F.greatest(start, F.lit(first).cast("date"))


def turned(value: Column, benefit: bool) -> Column:
    """A criterion turned so that more is better."""
    return value if benefit else -value


def detour(distance: float, ratio: float = 1.3) -> float:
    """The straight distance of a walk of ``distance``."""
    return distance / ratio


def product_name(product: str, area: str, start: int, end: int, resolution: int, suffix: str = "", most: int = 100) -> str:
    """product_area_start_end_resolution[_suffix] of safe parts; a name over the limit is refused, not cut."""
    safe = lambda x: re.sub(r"[^a-z0-9]+", "_", str(x).lower()).strip("_")
    name = "_".join(filter(None, [safe(product), safe(area), f"{start:04d}", f"{end:04d}", f"{resolution}m", safe(suffix)]))
    if len(name) > most:
        raise ValueError(f"{name!r} is longer than {most}")
    return name


def band_names(band: str, reducer: str, percentile: int | None = None) -> tuple[str, ...]:
    """Columns of a composite: its figure, and the count beside it."""
    figure = f"p{percentile}" if reducer == "percentile" else reducer
    if reducer == "percentile" and (percentile is None or not 0 < percentile < 100):
        raise ValueError("a percentile lies between 0 and 100")
    return f"{band}_{figure}", f"{band}_count"


def _pairs(n: int) -> tuple[float, float]:
    """The most that S can be, and its variance, in a series of n years without ties."""
    if n < 3:
        raise ValueError("a trend needs three years")
    return n * (n - 1) / 2, n * (n - 1) * (2 * n + 5) / 18


def s_from_tau(tau: Column, n: Column) -> Column:
    """S of a Mann-Kendall test from tau, rounded half to even; null below three years."""
    return F.when(n >= 3, F.rint(tau * n * (n - 1) / 2))


def z_from_tau(tau: Column, n: Column) -> Column:
    """Continuity-corrected Z from tau; null below three years."""
    s = s_from_tau(tau, n)
    return F.when(s == 0, 0.0).otherwise((s - F.signum(s)) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18))


def detection_threshold(n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The least |S| and |tau| that a two-sided test calls significant."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    most, variance = _pairs(n)
    s = NormalDist().inv_cdf(1 - alpha / 2) * math.sqrt(variance) + 1
    return s, s / most


def power_floor(n: int, tests: int, alpha: float = 0.05) -> tuple[float, float, bool]:
    """(least p that a series can reach, the strictest step-up threshold, whether one test alone can pass)."""
    if tests < 1 or not 0 < alpha < 1:
        raise ValueError("there is a test at least, and alpha lies between 0 and 1")
    most, variance = _pairs(n)
    p = math.erfc((most - 1) / math.sqrt(variance) / math.sqrt(2))
    return p, alpha / tests, p <= alpha / tests


def normal_cdf(z: float) -> float:
    """The normal distribution function."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain(value: float) -> str:
    """A number without exponent or trailing zeros."""
    return f"{value:.10f}".rstrip("0").rstrip(".") if math.isfinite(value) else str(value)


def signed(value: float) -> str:
    """An offset as '+ x' or '- x'."""
    return f"{'-' if value < 0 else '+'} {plain(abs(value))}"


def value_paths(node: object, wanted: object, prefix: str = "") -> list[str]:
    """Dotted paths of a nested configuration that hold a value."""
    if isinstance(node, dict):
        return [p for k, v in node.items() for p in value_paths(v, wanted, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(node, list | tuple):
        return [p for i, v in enumerate(node) for p in value_paths(v, wanted, f"{prefix}[{i}]")]
    return [prefix] if node == wanted else []


def coverage_text(start: str, end: str | None) -> str:
    """A date range; an open end is ongoing."""
    return f"{start} to {end or 'ongoing'}"
