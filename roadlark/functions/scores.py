"""Areas, severities, confidences, tags, colours and texts as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlark.config import ALTITUDE_LIMIT_M, ALTITUDE_WARN_M, CLASS_WEIGHTS, SEVERITY_CUTS


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def area_sq_m(pixels: Column, gsd_m: Column) -> Column:
    return pixels * gsd_m * gsd_m


def pothole_severity(area: Column, depth: Column, full_area: float = 1.0) -> Column:
    return clamp(0.6 * clamp(area / full_area) + 0.4 * clamp(depth))


def crack_severity(length_m: Column, area: Column, alligator: Column) -> Column:
    """Length a square metre; alligator patterns weigh more than linear ones."""
    return clamp(F.when(area > 0, length_m / area).otherwise(0.0) * F.when(alligator, 1.0).otherwise(0.6))


def waterlogging_severity(area: Column, segment_area: Column, recurrences: Column) -> Column:
    return clamp(F.when(segment_area > 0, area / segment_area).otherwise(0.0) * 0.7 + 0.1 * F.least(F.lit(3), recurrences))


def debris_severity(footprint_m: Column, lane_m: Column, sessions: Column) -> Column:
    return clamp(0.8 * clamp(footprint_m / lane_m) + 0.1 * F.least(F.lit(2), sessions))


def weighted_severity(anomaly_type: Column, raw: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in CLASS_WEIGHTS.items() for x in pair])
    return clamp(F.coalesce(F.try_element_at(weights, anomaly_type), F.lit(1.0)) * raw)


def band(score: Column) -> Column:
    low, high = SEVERITY_CUTS
    return F.when(score < low, "low").when(score < high, "medium").when(score.isNotNull(), "high")


def confidence(factors: Column, weights: Column) -> Column:
    """Weighted mean of two arrays; null where the weights sum to zero."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.when(total > 0, F.aggregate(F.zip_with(factors, weights, lambda f, w: f * w), F.lit(0.0), lambda s, x: s + x) / total)


def describe(*parts: Column) -> Column:
    return F.concat_ws(", ", *parts)


def marker_status(elapsed_s: Column, limit_s: Column) -> Column:
    return F.when(elapsed_s > limit_s, "red").when(elapsed_s > 0, "yellow").otherwise("green")


def colour(kind: Column, table: dict[str, str], other: str = "grey") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), kind), F.lit(other))


def altitude_status(alt: Column) -> Column:
    return F.when(alt > ALTITUDE_LIMIT_M, "violation").when(alt >= ALTITUDE_WARN_M, "warning").otherwise("ok")


def quality_tags(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) / before * 100)


def snapshot_path(kind: str, ts: Column, event_id: Column) -> Column:
    return F.concat_ws("/", F.lit(kind), F.date_format(ts, "yyyy"), F.date_format(ts, "MM"), F.date_format(ts, "dd"), F.concat(event_id.cast("string"), F.lit(".jpg")))


def shadow_ok(sun_elevation: Column, contrast: Column, least_elevation: float = 15.0, least_contrast: float = 0.2) -> Column:
    return (sun_elevation >= least_elevation) & (contrast >= least_contrast)
