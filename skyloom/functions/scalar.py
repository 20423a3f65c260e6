"""Row-wise expressions: bit fields, scaling, spectral indices, seasons, buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_field(packed: Column, shift: int, width: int) -> Column:
    """The ``width`` bits of ``packed`` from bit ``shift`` on."""
    return F.shiftright(packed, shift).bitwiseAND((1 << width) - 1)


def is_clear(packed: Column, flag_bits: int, saturation: Column) -> Column:
    """True if the lowest ``flag_bits`` bits are all 0 and nothing is saturated."""
    return (bit_field(packed, 0, flag_bits) == 0) & (saturation == 0)


def within_ceiling(packed: Column, fields: Sequence[tuple[int, int, int]]) -> Column:
    """True if each (shift, width, ceiling) field is at most its ceiling."""
    out = F.lit(True)
    for shift, width, ceiling in fields:
        out = out & (bit_field(packed, shift, width) <= ceiling)
    return out


def clear_count(packed: Column, width: int) -> Column:
    """Number of set bits among the lowest ``width``."""
    return F.bit_count(bit_field(packed, 0, width))


def masked(value: Column, keep: Column) -> Column:
    """``value`` where ``keep`` is true, else null; the row stays."""
    return F.when(keep, value)


def scaled(raw: Column, factor: float, offset: float, valid: tuple[float, float], plausible: tuple[float, float]) -> Column:
    """raw * factor + offset; null if the raw or the scaled value is outside its inclusive range."""
    out = raw * F.lit(factor) + F.lit(offset)
    return F.when(raw.between(*valid) & out.between(*plausible), out)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null if b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def enhanced_vegetation(nir: Column, red: Column, blue: Column) -> Column:
    return ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def soil_adjusted(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return ratio((nir - red) * (1 + soil), nir + red + soil)


def weighted_sum(terms: Sequence[tuple[Column, float]], constant: float = 0.0) -> Column:
    """Sum of column times weight, as of albedo; null if a term is null."""
    out = F.lit(constant)
    for column, weight in terms:
        out = out + column * F.lit(weight)
    return out


def season(month: Column, seasons: dict[str, Sequence[int]]) -> Column:
    """The season of a month; seasons partition the months."""
    flat = [x for name, months in seasons.items() for m in months for x in (F.lit(m), F.lit(name))]
    return F.element_at(F.create_map(*flat), month)


def bucket(value: Column, breaks: Sequence[float]) -> Column:
    """Left-closed bucket number: a value equal to a break goes up, null is -1."""
    above = sum((value >= F.lit(b)).cast("int") for b in breaks)
    return F.coalesce(above, F.lit(-1))


def recode(value: Column, codes: dict, other: object = None) -> Column:
    """The mapped value, or ``other``."""
    flat = [F.lit(x) for pair in codes.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), value), F.lit(other))


def slug(name: Column, most: int) -> Column:
    """Lower-case name of letters, digits and underscores; null if longer than ``most``."""
    out = F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(F.length(out) <= most, out)


def variance_index(value: Column, mean: Column) -> Column:
    """(value - mean) / mean, a thermal field's variance index; null where the mean is 0."""
    return (value - mean) / F.nullif(mean, F.lit(0.0))


#: Terms of both expansions below; they agree with the error function to 1e-13 of its value.
_TERMS = 60


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p of z, 1 minus the error function of |z| over the root of 2: a series below 3.5, a continued fraction from there on."""
    x = F.abs(z.cast("double")) / F.lit(2.0**0.5)
    bell = F.exp(-x * x)
    step = lambda a, k: F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * 2 * x * x / (2 * k + 1)).alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(F.lit(0.0).alias("sum"), (2 * x).alias("term")), step)["sum"]
    near = 1 - bell * series / F.lit(math.pi**0.5)
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), x, lambda a, k: x + k / F.lit(2.0) / a)
    return F.when(z.isNull() | F.isnan(z.cast("double")), None).when(x < 2.5, near).otherwise(bell / fraction / F.lit(math.pi**0.5))
