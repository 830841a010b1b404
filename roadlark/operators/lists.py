"""Ordered lists and set operations: feeds, inventories, work orders, latest states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlark.config import CATCH_UP_S


def condition_inventory(anomalies: DataFrame, key: str = "anomaly_id") -> DataFrame:
    return anomalies.orderBy(F.desc("severity"), F.desc("n_sessions"), key)


def work_orders(anomalies: DataFrame, status: str = "work_order_issued", key: str = "anomaly_id") -> DataFrame:
    return anomalies.where(F.col("status") == status).orderBy(F.desc("severity"), key)


def live_feed(events: DataFrame, n: int, t: str = "t", key: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc(t), F.desc(key)).limit(n)


def recent_ids(events: DataFrame, n: int, t: str = "t", key: str = "event_id") -> DataFrame:
    return live_feed(events, n, t, key).select(key, t)


def ordered_flush(batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """A buffered batch in the order of its events, each partition sorted after a range exchange."""
    return batch.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)


def combined_feed(violations: DataFrame, anomalies: DataFrame) -> DataFrame:
    return violations.unionByName(anomalies, allowMissingColumns=True)


def noise(events: DataFrame, clustered: DataFrame, key: str = "event_id") -> DataFrame:
    return events.join(clustered.select(key), key, "left_anti")


def hot_in_both(violations: DataFrame, anomalies: DataFrame, least: int, key: str = "zone_id") -> DataFrame:
    hot = lambda df: df.groupBy(key).count().where(F.col("count") >= least).select(key)
    return hot(violations).intersect(hot(anomalies))


def distinct_defects(dets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return dets.select(*keys).distinct()


def latest_state(points: DataFrame, key: str, ttl_s: float, now: float, t: str = "t") -> DataFrame:
    """The last row of each key, while it is younger than its time to live."""
    last = points.groupBy(key).agg(F.max_by(F.struct(*[c for c in points.columns if c != key]), F.struct(t, "k") if "k" in points.columns else F.col(t)).alias("_last"))
    return last.select(key, "_last.*").where(F.col(t) > now - ttl_s)


def catch_up(events: DataFrame, now: float, seconds: float = CATCH_UP_S, t: str = "t") -> DataFrame:
    return events.where((F.col(t) > now - seconds) & (F.col(t) <= now))
