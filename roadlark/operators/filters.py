"""Filters and visibility rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.config import DENSITY, EMERGENCY, HELMET_CONFIDENCE, PASSENGERS, PERMISSIONS, PROMOTE_SESSIONS, RECOMMEND_MIN, RETENTION_DAYS
from roadlark.functions.geo import box_of, crosses, point_in_polygon
from roadlark.functions.scores import quality_tags


def apply_filter(df: DataFrame, *, kind: str | None = None, kind_column: str = "vtype", zone: object = None, status: str | None = None, severity: str | None = None, session: object = None, start: float | None = None, end: float | None = None, t: str = "t", min_confidence: float | None = None) -> DataFrame:
    """Conjunction of the arguments given; every one reaches the scan as a pushed filter."""
    tests: list[Column] = []
    for column, value in ((kind_column, kind), ("zone_id", zone), ("status", status), ("severity_band", severity), ("session_id", session)):
        if value is not None:
            tests.append(F.col(column) == value)
    if start is not None:
        tests.append(F.col(t) >= start)
    if end is not None:
        tests.append(F.col(t) < end)
    if min_confidence is not None:
        tests.append(F.col("confidence") >= min_confidence)
    for test in tests:
        df = df.where(test)
    return df


def get_by_id(df: DataFrame, key: object, column: str = "event_id") -> DataFrame:
    return df.where(F.col(column) == key)


def active_zones(zones: DataFrame) -> DataFrame:
    return zones.where("is_active")


def deactivate(zones: DataFrame, zone_id: object) -> DataFrame:
    """Deleting a zone only takes it out of use."""
    return zones.withColumn("is_active", F.when(F.col("zone_id") == zone_id, False).otherwise(F.col("is_active")))


def drop_emergency(points: DataFrame) -> DataFrame:
    return points.where(~F.coalesce(F.col("vehicle_class"), F.lit("")).isin(*EMERGENCY))


def full_bbox(points: DataFrame, width: float, height: float, box: str = "box") -> DataFrame:
    b = F.col(box)
    return points.where((b["x1"] > 0) & (b["y1"] > 0) & (b["x2"] < width) & (b["y2"] < height))


def drop_false_debris(masks: DataFrame, excluded: DataFrame, on: list[str], vehicle_classes: tuple[str, ...] = ("vehicle",)) -> DataFrame:
    """Debris that is a vehicle, a marking, a repair patch or announced works goes; other anomalies stay."""
    debris = F.col("anomaly_type") == "debris"
    false = masks.where(debris).join(excluded.select(*on).distinct(), on, "left_anti").where(~F.coalesce(F.col("mask_class"), F.lit("")).isin(*vehicle_classes))
    return masks.where(~debris).unionByName(false)


def helmet_overload(dets: DataFrame) -> DataFrame:
    return dets.where((F.col("no_helmet_confidence") > HELMET_CONFIDENCE) | (F.col("passengers") >= PASSENGERS))


def zone_scoped(df: DataFrame, user_zones: DataFrame, user_id: object) -> DataFrame:
    """Rows of the zones that a user may see."""
    return df.join(user_zones.where(F.col("user_id") == user_id).select("zone_id").distinct(), "zone_id", "left_semi")


def permissions(spark) -> DataFrame:
    """The role table: one row per allowed (action, role)."""
    return spark.createDataFrame([(a, r) for a, roles in PERMISSIONS.items() for r in roles], "action string, role string")


def has_permission(requests: DataFrame) -> DataFrame:
    """``requests`` (role, action) with ``allowed``."""
    table = permissions(requests.sparkSession).withColumn("allowed", F.lit(True))
    return requests.join(F.broadcast(table), ["action", "role"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def retain(df: DataFrame, as_of: float, *, t: str = "t", days: int = RETENTION_DAYS, anonymise: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the retention period, without identifying columns."""
    return df.where(F.col(t) >= as_of - days * 86400).drop(*anonymise)


def promote(anomalies: DataFrame, n: int = PROMOTE_SESSIONS) -> DataFrame:
    return anomalies.withColumn("visibility", F.when(F.col("n_sessions") >= n, "promoted").otherwise("low_confidence"))


def density_threshold(df: DataFrame, frames: DataFrame, n: int = DENSITY, base: float = 0.5, raised: float = 0.05) -> DataFrame:
    """Confidence threshold of each row; higher in frames of more than ``n`` vehicles."""
    counts = frames.select("session_id", "frame_no", "vehicles")
    return df.join(counts, ["session_id", "frame_no"], "left").withColumn("threshold", F.when(F.col("vehicles") > n, base + raised).otherwise(base))


def drop_noise(clustered: DataFrame) -> DataFrame:
    return clustered.where("cluster_id is not null")


def min_events(clusters: DataFrame, n: int = RECOMMEND_MIN, column: str = "n_events") -> DataFrame:
    return clusters.where(F.col(column) >= n)


def hour_between(df: DataFrame, first: int, last: int, ts: str = "ts") -> DataFrame:
    return df.where(F.hour(ts).between(first, last))


def tag_quality(df: DataFrame, **conditions: Column) -> DataFrame:
    """Labels degraded rows in ``tags``; no row is left out."""
    return df.withColumn("tags", quality_tags(**conditions))


def valid_patrol(patrols: DataFrame, no_fly: DataFrame) -> DataFrame:
    """Patrols (patrol_id, polygon) that neither overlap a no-fly polygon nor lie in one."""
    a, b = F.col("polygon"), F.col("_other")
    inside = lambda ring, area: F.exists(ring, lambda q: point_in_polygon(q["lat"], q["lng"], area))
    at = lambda ring, i: F.get(ring, i % F.size(ring))

    def cross(i: Column, j: Column) -> Column:
        p, q, u, v = at(a, i), at(a, i + 1), at(b, j), at(b, j + 1)
        return crosses(p["lng"], p["lat"], q["lng"], q["lat"], u["lng"], u["lat"], v["lng"], v["lat"])

    touch = F.exists(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.exists(F.sequence(F.lit(0), F.size(b) - 1), lambda j: cross(i, j)))
    boxes = {**box_of(F.col("polygon"))}
    left = patrols.withColumns({f"_p_{k}": v for k, v in boxes.items()})
    right = no_fly.select(F.col("polygon").alias("_other")).withColumns({f"_n_{k}": v for k, v in box_of(F.col("_other")).items()})
    near = (F.col("_p_min_lat") <= F.col("_n_max_lat")) & (F.col("_n_min_lat") <= F.col("_p_max_lat")) & (F.col("_p_min_lng") <= F.col("_n_max_lng")) & (F.col("_n_min_lng") <= F.col("_p_max_lng"))
    bad = left.join(right, near & (inside(a, b) | inside(b, a) | touch), "left_semi").select("patrol_id")
    return patrols.join(bad, "patrol_id", "left_anti")
