"""Colours: palettes, interpolation, contrast; and label predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The categorical palette (a published colour-blind safe set), missing values, markers.
CURATED = ["#0072B2", "#E69F00", "#009E73", "#CC79A7", "#56B4E9", "#D55E00", "#F0E442", "#999999"]
MISSING = "#cccccc"
MARKERS = ["o", "s", "^", "D", "v", "P", "X", "*", "<", ">"]
RAMP = ("#f7fbff", "#08306b")


def _linear(c: float) -> float:
    return c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4


def _gamma(c: float) -> float:
    return 12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055


def rgb(color: str) -> tuple[float, float, float]:
    return tuple(int(color[i : i + 2], 16) / 255 for i in (1, 3, 5))


def to_hex(c) -> str:
    return "#" + "".join(f"{round(255 * min(1, max(0, v))):02x}" for v in c)


def lerp_color(a: str, b: str, t: float) -> str:
    """Between two colours in linear light."""
    return to_hex(_gamma(_linear(x) + (_linear(y) - _linear(x)) * t) for x, y in zip(rgb(a), rgb(b)))


def hue_palette(n: int, c: float = 100.0, lum: float = 65.0, h_start: float = 15.0, h_end: float = 375.0) -> list[str]:
    """Equally spaced hues of one lightness and chroma."""
    out = []
    for i in range(n):
        h = math.radians(h_start + (h_end - h_start) * i / n)
        u, v = c * math.cos(h), c * math.sin(h)
        y = ((lum + 16) / 116) ** 3
        us, vs = u / (13 * lum) + 0.19783, v / (13 * lum) + 0.46832
        x, z = y * 9 * us / (4 * vs), y * (12 - 3 * us - 20 * vs) / (4 * vs)
        out.append(to_hex(_gamma(max(0.0, w)) for w in (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.204 * y + 1.057 * z)))
    return out


def categorical_palette(n: int, name: str = "curated") -> list[str]:
    if name == "hue":
        return hue_palette(n)
    if name != "curated":
        raise ValueError("a palette is curated or hue")
    return [CURATED[i] if i < len(CURATED) else lerp_color(CURATED[i % len(CURATED)], "#808080", 0.35 + 0.1 * (i // len(CURATED) % 4)) for i in range(n)]


def readable_on(fill: str, alpha: float = 1.0) -> str:
    """Black or white, whichever stands out from a fill blended on white."""
    lum = sum(k * _linear(v * alpha + 1 - alpha) for k, v in zip((0.2126, 0.7152, 0.0722), rgb(fill)))
    return "black" if (lum + 0.05) ** 2 > 0.05 * 1.05 else "white"


def continuous(value: Column, lo: Column, hi: Column, ramp: tuple[str, str] = RAMP) -> Column:
    """A column's colour on a ramp between two bounds, in linear light; null is grey."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.5))))
    part = []
    for a, b in zip(rgb(ramp[0]), rgb(ramp[1])):
        c = F.lit(_linear(a)) + (_linear(b) - _linear(a)) * t
        s = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
        part.append(F.lower(F.lpad(F.hex(F.round(255 * s).cast("long")), 2, "0")))
    return F.when(value.isNull(), MISSING).otherwise(F.concat(F.lit("#"), *part))


def gradient(n: int = 32, ramp: tuple[str, str] = RAMP) -> list[str]:
    return [lerp_color(*ramp, i / max(1, n - 1)) for i in range(n)]


# Labels, whatever their case, that stand for no organism.
NOT_TAXA = ["other", "others", "unclassified", "unassigned", "unknown", "none", "na", "n/a", "outgroup", "reference", "environmental sample", "sp.", "uncultured", "misc", "mixed", "root"]


def looks_like_a_taxon(name: Column) -> Column:
    """Whether a label begins with a capital and is none of NOT_TAXA."""
    label = F.trim(name)
    return label.rlike(r"^\p{Lu}") & ~F.lower(label).isin(NOT_TAXA)


def nice_step(span: Column, want: int = 10) -> Column:
    """The span's want-th part, rounded down to 1, 2 or 5 times a power of ten."""
    raw = span / want
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    m = raw / power
    return F.when(m >= 5, 5 * power).when(m >= 2, 2 * power).otherwise(power)
