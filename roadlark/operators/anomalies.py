"""Road anomalies: severity, inventory, upsert, lifecycle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlark.config import DEDUP_M
from roadlark.functions import scores
from roadlark.operators.clustering import connected
from roadlark.operators.joins import within_distance_join


def with_severity(masks: DataFrame, raw: str = "raw") -> DataFrame:
    score = scores.weighted_severity(F.col("anomaly_type"), F.col(raw))
    return masks.withColumn("severity", score).withColumn("severity_band", scores.band(F.col("severity")))


def dedup(dets: DataFrame, metres: float = DEDUP_M, key: str = "det_id", most_lat: float = 89.0) -> DataFrame:
    """Detections with ``anomaly_id``: the smallest id of the same type that a chain of neighbours reaches."""
    near = within_distance_join(dets.select(key, "anomaly_type", "lat", "lng"), dets.select(key, "anomaly_type", "lat", "lng"), metres, ["anomaly_type"], most_lat, F.col(key) < F.col(key + "_b"))
    labels = connected(near.select(F.col(key).alias("a"), F.col(key + "_b").alias("b")))
    return dets.join(labels.select(F.col("node").alias(key), F.col("component").alias("anomaly_id")), key, "left").withColumn("anomaly_id", F.coalesce("anomaly_id", key))


def inventory(deduped: DataFrame, t: str = "t") -> DataFrame:
    """One row per anomaly: type, place, worst severity, sessions, first and last seen."""
    return deduped.groupBy("anomaly_id", "anomaly_type").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.max("severity").alias("severity"), F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_dets"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("anomaly_id",)) -> DataFrame:
    """Merge by full join: counts add up, the worst severity and the outer times stay."""
    s, f = (df.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in ("severity", "n_dets", "first_seen", "last_seen")]) for df, n in ((stored, "s"), (fresh, "f")))
    j = s.join(f, list(keys), "full")
    return j.select(
        *keys,
        F.greatest("severity_s", "severity_f").alias("severity"),
        (F.coalesce("n_dets_s", F.lit(0)) + F.coalesce("n_dets_f", F.lit(0))).alias("n_dets"),
        F.least("first_seen_s", "first_seen_f").alias("first_seen"),
        F.greatest("last_seen_s", "last_seen_f").alias("last_seen"),
        F.when(F.col("n_dets_s").isNull(), "insert").when(F.col("n_dets_f").isNull(), "keep").otherwise("update").alias("action"),
    )


def set_status(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` (key, status) applied; rows without a change stay."""
    new = changes.select(key, F.col("status").alias("_new"))
    return table.join(new, key, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
