"""Numeric Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero after scaling; unlike round(), the same in every engine."""
    k = float(10**digits)
    up = F.floor(F.abs(x) * k + 0.5) / F.lit(k)
    return F.when(x < 0, -up).otherwise(up) + F.lit(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def u8(x: Column) -> Column:
    """Nearest number of 0..255."""
    return F.floor(clamp(x, 0.0, 255.0) + 0.5).cast("int")


def u8_cut(x: Column) -> Column:
    """Number of 0..255 without its fraction."""
    return F.floor(clamp(x, 0.0, 255.0)).cast("int")


def piecewise(x: Column, knots: Sequence[float], values: Sequence[float]) -> Column:
    """Straight lines between the knots, constant beyond the ends: a sum of ramps, which names x once a stretch."""
    out = F.lit(float(values[0]))
    for k0, k1, v0, v1 in zip(knots, knots[1:], values, values[1:], strict=False):
        out = out + clamp(x - float(k0), 0.0, float(k1 - k0)) / float(k1 - k0) * float(v1 - v0)
    return out


def fit_inside(width: Column, height: Column, most_width: float, most_height: float) -> Column:
    """Scale that fits a box into another without enlarging it."""
    return F.least(F.lit(most_width) / width, F.lit(most_height) / height, F.lit(1.0))


def missing(z: Column, below: float = -1000.0) -> Column:
    """NaN and sentinels become NULL, the engine's only missing value."""
    return F.when(~F.isnan(z) & (z >= below), z)
