"""Colour figures of palettes: linear light, lightness, CIE differences and simulated colour vision.

Palettes are a few colours, so these are plain functions; a table of colours uses
them through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

Triple = tuple[float, float, float]

#: Linear sRGB to XYZ under D65, the D65 white, and matrices of full protanopia, deuteranopia and tritanopia in linear sRGB.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
VISION = {
    "protan": ((0.152286, 1.052583, -0.204868), (0.114503, 0.786281, 0.099216), (-0.003882, -0.048116, 1.051998)),
    "deutan": ((0.367322, 0.860646, -0.227968), (0.280085, 0.672501, 0.047413), (-0.011820, 0.042940, 0.968881)),
    "tritan": ((1.255528, -0.076749, -0.178779), (-0.078411, 0.930809, 0.147602), (0.004733, 0.691367, 0.303900)),
}


def applied(matrix: Sequence[Sequence[float]], v: Sequence[float]) -> Triple:
    """The product of a 3 x 3 matrix and a vector."""
    a, b, c = (sum(m * x for m, x in zip(row, v, strict=True)) for row in matrix)
    return a, b, c


def channels(colour: str) -> Triple:
    """The channels of #rgb or #rrggbb, 0 to 1."""
    text = colour.strip().removeprefix("#")
    text = "".join(2 * c for c in text) if len(text) == 3 else text
    if len(text) != 6:
        raise ValueError(f"{colour!r} is no colour")
    r, g, b = (int(text[i : i + 2], 16) / 255 for i in (0, 2, 4))
    return r, g, b


def linear(c: float) -> float:
    """Linear light of an sRGB channel."""
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def encoded(c: float) -> float:
    """The sRGB channel of linear light, clipped to 0 to 1."""
    c = min(max(c, 0.0), 1.0)
    return 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055


def lab(colour: str) -> Triple:
    """CIE L*, a*, b* of a colour."""

    def f(t: float) -> float:
        return t ** (1 / 3) if t > (6 / 29) ** 3 else t / (3 * (6 / 29) ** 2) + 4 / 29

    xyz = applied(TO_XYZ, [linear(c) for c in channels(colour)])
    x, y, z = (f(v / w) for v, w in zip(xyz, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def lightness(colour: str) -> float:
    """CIE L* of a colour."""
    return lab(colour)[0]


def difference(a: str, b: str) -> float:
    """The distance of two colours in L*, a*, b*."""
    return math.dist(lab(a), lab(b))


def seen_as(colour: str, vision: str) -> str:
    """The colour as a kind of colour vision sees it."""
    light = applied(VISION[vision], [linear(c) for c in channels(colour)])
    return "#" + "".join(f"{round(255 * encoded(c)):02x}" for c in light)


def is_monotonic(values: Sequence[float]) -> bool:
    """Whether values only rise or only fall."""
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    return all(s > 0 for s in steps) or all(s < 0 for s in steps)


def is_diverging(values: Sequence[float]) -> bool:
    """Whether values rise to their middle and fall from it, or the other way round; an even number has two middle ones."""
    up = lambda v: all(b > a for a, b in zip(v, v[1:], strict=False))
    down = lambda v: all(b < a for a, b in zip(v, v[1:], strict=False))
    middle = {(len(values) - 1) // 2, len(values) // 2}
    return len(values) > 2 and any(f(values[: m + 1]) and g(values[m:]) for m in middle for f, g in ((up, down), (down, up)))


def closest(colours: Sequence[str], vision: str | None = None) -> float:
    """The least difference of any two of the colours, as they are or as a kind of vision sees them."""
    shown = [seen_as(c, vision) if vision else c for c in colours]
    return min((difference(a, b) for i, a in enumerate(shown) for b in shown[i + 1 :]), default=math.inf)


def failures(colours: Sequence[str], least: float) -> list[str]:
    """The kinds of vision under which two of the colours come closer than ``least``."""
    return [v for v in VISION if closest(colours, v) < least]
