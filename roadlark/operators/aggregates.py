"""Roll-ups, histograms, heat maps, rates and counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import DENSITY, DISMISSAL_RATE, LOW_LIGHT, PROMOTE_SESSIONS
from roadlark.functions import geo
from roadlark.session import checkpointed


def stats(events: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass over grouping sets."""
    cols = [F.col(d) for d in dims]
    return events.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"))


def zone_counts(events: DataFrame, session: object) -> DataFrame:
    """Events of one session in each zone; the session reaches the scan as a pushed filter."""
    return events.where(F.col("session_id") == session).groupBy("zone_id").agg(F.count("*").alias("n"))


def rollup_stats(events: DataFrame, dims: Sequence[str]) -> DataFrame:
    return events.rollup(*dims).agg(F.count("*").alias("n"))


def cube_stats(events: DataFrame, dims: Sequence[str]) -> DataFrame:
    return events.cube(*dims).agg(F.count("*").alias("n"))


def trend(events: DataFrame, unit: str, ts: str = "ts", dims: Sequence[str] = ("vtype",)) -> DataFrame:
    return events.groupBy(F.date_trunc(unit, ts).alias("bucket"), *dims).agg(F.count("*").alias("n"))


def severity_breakdown(anomalies: DataFrame, key: str = "anomaly_type") -> DataFrame:
    return anomalies.groupBy(key).pivot("severity_band", ["low", "medium", "high"]).agg(F.count(F.lit(1))).na.fill(0)


def histogram(df: DataFrame, value: str, step: float, dims: Sequence[str] = ()) -> DataFrame:
    """Counts by bucket number; the value is scaled before the floor, so decimal steps stay exact."""
    return df.groupBy(*dims, F.floor(F.round(F.col(value) / step, 9)).alias("bucket")).agg(F.count("*").alias("n"))


def composition(clustered: DataFrame, key: str = "cluster_id", kind: str = "vtype") -> DataFrame:
    """Share of each type in each group."""

    counts = clustered.groupBy(key, kind).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def recurrence(dets: DataFrame, keys: Sequence[str], t: str = "t", severity: str = "severity") -> DataFrame:
    return dets.groupBy(*keys).agg(F.count_distinct("session_id").alias("n_sessions"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen"), F.count("*").alias("n_dets"), F.max(severity).alias("worst"), F.regr_slope(severity, F.col(t).cast("double")).alias("slope"))


def dismissal_rate(events: DataFrame, most: float = DISMISSAL_RATE, key: str = "vtype") -> DataFrame:
    rate = F.avg(F.when(F.col("status") == "dismissed", 1.0).otherwise(0.0))
    return events.groupBy(key).agg(rate.alias("rate"), F.count("*").alias("n")).withColumn("retrain", F.col("rate") > most)


def session_counters(points: DataFrame) -> DataFrame:
    return points.groupBy("session_id").agg(F.count_distinct("track_id").alias("vehicles"), F.count("*").alias("n"))


def low_light(events: DataFrame, least: float = LOW_LIGHT, key: str = "session_id") -> DataFrame:
    return events.groupBy(key).agg(F.avg("confidence").alias("mean_confidence")).withColumn("low_light", F.col("mean_confidence") < least)


def frame_density(points: DataFrame, n: int = DENSITY, keys: Sequence[str] = ("session_id", "frame_no")) -> DataFrame:
    return points.groupBy(*keys).agg(F.count_distinct("track_id").alias("vehicles")).withColumn("dense", F.col("vehicles") > n)


def heatmap(events: DataFrame, cell_deg: float, dims: Sequence[str] = ()) -> DataFrame:
    """Events in each grid cell; callers filter types and dates before, so the filters reach the scan."""
    return events.groupBy(*dims, F.floor(F.col("lat") / cell_deg).alias("cell_lat"), F.floor(F.col("lng") / cell_deg).alias("cell_lng")).agg(F.count("*").alias("n"))


def cluster_summary(clustered: DataFrame, severity: str = "confidence", t: str = "t") -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("n_events"), F.avg(severity).alias("mean_severity"), F.min(t).alias("first_detected"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


def condition_score(anomalies: DataFrame, segment: str, now: float, half_life_s: float = 30 * 86400, t: str = "t", severity: str = "severity") -> DataFrame:
    """Mean severity of a segment, older findings counting less: half after each half-life."""
    weight = F.pow(F.lit(2.0), -(F.lit(now) - F.col(t)) / half_life_s)
    return anomalies.groupBy(segment).agg((F.sum(F.col(severity) * weight) / F.sum(weight)).alias("condition_score"), F.count("*").alias("n"))


def chronic(dets: DataFrame, keys: Sequence[str], n: int = PROMOTE_SESSIONS) -> DataFrame:
    return dets.groupBy(*keys).agg(F.count_distinct("session_id").alias("n_sessions")).withColumn("chronic", F.col("n_sessions") >= n)


def monthly_rate(events: DataFrame, days: float, keys: Sequence[str] = ("vtype",)) -> DataFrame:
    return events.groupBy(*keys).agg((F.count("*") / F.lit(days / 30.0)).alias("per_month"))


def by_hour(events: DataFrame, ts: str = "ts", dims: Sequence[str] = ()) -> DataFrame:
    return events.groupBy(*dims, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def coverage(points: DataFrame, cell_m: float, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Area of the grid cells that a session visited."""
    step = cell_m / geo.METRES_PER_DEGREE
    cells = points.select(*keys, F.floor(F.col("lat") / step).alias("a"), F.floor(F.col("lng") / step).alias("b")).distinct()
    return cells.groupBy(*keys).agg((F.count("*") * F.lit(cell_m * cell_m)).alias("covered_sq_m"))


def trace_ids(events: DataFrame, keys: Sequence[str], key: str = "event_id") -> DataFrame:
    """Counts with the ids behind them."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("event_ids"))


def altitude_profile(telemetry: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    return telemetry.groupBy(*keys).agg(F.min("alt").alias("min_alt"), F.max("alt").alias("max_alt"), F.avg("alt").alias("mean_alt"))


#: A group of more distinct values is narrowed before its values are ordered, to this many parts at a time.
ORDERED_VALUES, SPLITS = 4096, 256


def percentile(df: DataFrame, value: str, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentile of each group, between neighbours in proportion; null for a group without values. Values are finite.

    Values become counts of equal ones. All groups' ranges are then split in ``SPLITS`` parts at a time, counts tell in
    which parts the wanted ranks lie, and the range shrinks to those, until no group has more than
    ``ORDERED_VALUES`` distinct ones left to put in order. No task holds a group.
    """
    name = f"p{round(q * 100)}"
    if not keys:
        return percentile(df.withColumn("_every", F.lit(1)), value, q, ["_every"]).select(name) if not df.isEmpty() else df.agg(F.lit(None).cast("double").alias(name))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
    counts = checkpointed(df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    sound = counts.where("_v is not null")
    place = (F.col("_all") - 1) * F.lit(float(q))
    state = sound.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.lit(0).cast("long").alias("_before"), F.count("*").alias("_d"))
    # each wanted rank narrows its own range
    state = checkpointed(state.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))))
    inside = lambda: sound.alias("c").join(state.alias("s"), same("c", "s") & F.col("_v").between(F.col("_low"), F.col("_high"))).select("c.*", "_rank", "_all", "_low", "_high", "_before")
    own = [*keys, "_rank"]
    while (state.agg(F.max("_d")).first()[0] or 0) > ORDERED_VALUES:
        part = F.least(F.lit(SPLITS - 1), F.floor((F.col("_v") / 2 - F.col("_low") / 2) / F.nullif(F.col("_high") / 2 - F.col("_low") / 2, F.lit(0.0)) * SPLITS))
        parts = inside().groupBy(*own, "_all", "_before", F.coalesce(part, F.lit(0)).alias("_part")).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*own).orderBy("_part"))  # SPLITS rows at most
        held = parts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_n") <= F.col("_rank")))
        state = checkpointed(held.select(*own, "_all", "_low", "_high", (F.col("_upto") - F.col("_n")).alias("_before"), "_d"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*own).orderBy("_v"))
    ordered = inside().withColumn("_upto", upto).where(F.col("_upto") > F.col("_rank"))
    found = ordered.groupBy(*own, "_all").agg(F.min("_v").alias("_v")).groupBy(*keys, "_all").agg(F.min_by("_v", "_rank").alias("_a"), F.max_by("_v", "_rank").alias("_b"))
    between = (F.ceil(place) - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b")
    out = found.select(*keys, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(name))
    groups = counts.select(*keys).distinct()
    return groups.alias("g").join(out.alias("o"), same("g", "o"), "left").select("g.*", name)


def top_k(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def top_k_per(df: DataFrame, group: str, key: str, k: int) -> DataFrame:

    counts = df.groupBy(group, key).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), key))).where(F.col("rank") <= k)
