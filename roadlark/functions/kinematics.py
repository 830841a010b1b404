"""Speed, heading and smoothness as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def speed_kmh(metres: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, metres / seconds * 3.6)


def pixel_speed_kmh(pixels: Column, gsd_m: Column, fps: Column) -> Column:
    return pixels * gsd_m * fps * 3.6


def heading_deg(dx: Column, dy: Column) -> Column:
    """Compass heading of a step: 0 north, 90 east."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def ang_diff(a: Column, b: Column) -> Column:
    """Smallest difference of two headings, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def signed_turn(a: Column, b: Column) -> Column:
    """Turn from heading a to b, over -180 and up to 180."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
