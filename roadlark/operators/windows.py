"""Trajectory windows: runs, visits, gaps, buffers and status histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import BUFFER_FRAMES, HEARTBEAT_S, HISTORY_FRAMES, OCCLUSION_S, TRANSITIONS
from roadlark.functions import geo, kinematics


def trajectory_buffer(points: DataFrame, n: int = BUFFER_FRAMES, keys: Sequence[str] = ("track_id",), order: str = "k") -> DataFrame:
    """Each point with its track's last ``n`` points, itself included."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return points.withColumn("buffer", F.collect_list(F.struct("lat", "lng")).over(w))


def rolling(df: DataFrame, value: str, n: int, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.avg(value).over(w))


def deltas(points: DataFrame, keys: Sequence[str] = ("track_id",), t: str = "t", order: Sequence[str] = ("t",)) -> DataFrame:
    """Metres, seconds, speed and heading of the step to each point."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lat, lng = F.lag("lat").over(w), F.lag("lng").over(w)
    out = points.withColumns({"_lat": lat, "_lng": lng, "dt": F.col(t) - F.lag(t).over(w)})
    dx = (F.col("lng") - F.col("_lng")) * F.cos(F.radians("lat"))
    out = out.withColumn("step_m", geo.haversine(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng")))
    out = out.withColumn("step_kmh", kinematics.speed_kmh(F.col("step_m"), F.col("dt")))
    return out.withColumn("step_heading", kinematics.heading_deg(dx, F.col("lat") - F.col("_lat"))).drop("_lat", "_lng")


def runs(df: DataFrame, condition: Column, keys: Sequence[str], t: str = "t", gap_s: float | None = OCCLUSION_S, order: Sequence[str] = ()) -> DataFrame:
    """Islands of rows where ``condition`` holds: keys, run_start, run_end, n_frames, duration_s.

    A row where it does not hold ends a run, and so does a gap of more than ``gap_s`` between
    rows; shorter occlusions keep it. A null condition does not hold.
    """
    w = Window.partitionBy(*keys).orderBy(t, *order)
    hold = F.coalesce(condition, F.lit(False))
    broken = ~F.coalesce(F.lag("_hold").over(w), F.lit(False))
    if gap_s is not None:
        broken = broken | (F.col(t) - F.lag(t).over(w) > gap_s)
    marked = df.withColumn("_hold", hold).withColumn("_new", (F.col("_hold") & broken).cast("int")).withColumn("_run", F.sum("_new").over(w)).where("_hold")
    return marked.groupBy(*keys, "_run").agg(F.min(t).alias("run_start"), F.max(t).alias("run_end"), F.count("*").alias("n_frames")).withColumn("duration_s", F.col("run_end") - F.col("run_start")).drop("_run")


def sustained(df: DataFrame, condition: Column, keys: Sequence[str], *, seconds: Column | float | None = None, frames: int | None = None, t: str = "t", gap_s: float | None = OCCLUSION_S) -> DataFrame:
    """Runs longer than ``seconds`` or of more than ``frames`` frames; both strictly. A column of seconds must be a key."""
    found = runs(df, condition, keys, t, gap_s)
    if seconds is not None:
        found = found.where(F.col("duration_s") > seconds)
    if frames is not None:
        found = found.where(F.col("n_frames") > frames)
    return found


def split_on_gap(points: DataFrame, keys: Sequence[str] = ("track_id",), gap_s: float = OCCLUSION_S, t: str = "t") -> DataFrame:
    """Points with ``segment``: a new one after a gap of more than ``gap_s``."""
    w = Window.partitionBy(*keys).orderBy(t)
    return points.withColumn("_new", (F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0)) > gap_s).cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def zone_visits(points: DataFrame, keys: Sequence[str] = ("track_id", "zone_id"), t: str = "t") -> DataFrame:
    """One row per stay in a zone: entry, exit, points, first and exit heading, total turn and its smoothness."""
    w = Window.partitionBy(*keys).orderBy(t)
    turn = kinematics.signed_turn(F.lag("heading").over(w), F.col("heading"))
    turned = points.withColumn("_turn", F.coalesce(turn, F.lit(0.0)))
    return turned.groupBy(*keys).agg(
        F.min(t).alias("entered"),
        F.max(t).alias("left"),
        F.count("*").alias("n"),
        F.min_by("heading", t).alias("first_heading"),
        F.max_by("heading", t).alias("exit_heading"),
        F.sum("_turn").alias("turn"),
        F.when(F.sum(F.abs("_turn")) > 0, 1 - F.max(F.abs("_turn")) / F.sum(F.abs("_turn"))).otherwise(0.0).alias("smoothness"),
    )


def has_history(points: DataFrame, keys: Sequence[str] = ("track_id",), n: int = HISTORY_FRAMES, t: str = "t") -> DataFrame:
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(t))).where(F.col("_n") > n).drop("_n")


def pipeline_gaps(beats: DataFrame, seconds: float = HEARTBEAT_S, keys: Sequence[str] = ("session_id",), t: str = "t") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    return beats.withColumn("gap_start", F.lag(t).over(w)).withColumn("gap_s", F.col(t) - F.col("gap_start")).where(F.col("gap_s") > seconds)


def vs_previous(df: DataFrame, keys: Sequence[str], bucket: str, value: str = "n") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(bucket)
    before = F.lag(value).over(w)
    return df.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous"))


def check_transitions(history: DataFrame, key: str = "event_id", t: str = "t") -> DataFrame:
    """Status changes that the lifecycle does not allow."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    w = Window.partitionBy(key).orderBy(t)
    step = history.withColumn("before", F.lag("status").over(w)).where("before is not null and before <> status")
    return step.where(~F.array_contains(allowed, F.concat_ws(">", "before", "status")))


def timeline(events: DataFrame, keys: Sequence[str] = ("session_id",), order: Sequence[str] = ("t", "event_id")) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("seen", F.count("*").over(w))


def zone_versions(history: DataFrame, key: str = "zone_id", t: str = "t", tie: str | None = None) -> DataFrame:
    """Each version holds until the next; versions of one moment follow in the order of ``tie``."""
    w = Window.partitionBy(key).orderBy(*([t, tie] if tie else [t]))
    return history.withColumns({"valid_from": F.col(t), "valid_to": F.lead(t).over(w)})


def last_seconds(events: DataFrame, seconds: int, keys: Sequence[str], t: str = "t") -> DataFrame:
    """How many events of the key fall into the ``seconds`` up to each event."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))


def position_at(points: DataFrame, moment: Column, value: str, keys: Sequence[str], t: str = "t") -> DataFrame:
    """The last ``value`` at rows where ``moment`` holds, carried forward."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(f"{value}_at", F.last(F.when(moment, F.col(value)), ignorenulls=True).over(w))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank", ties: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, (F.rank() if ties else F.row_number()).over(w))


def severity_trend(dets: DataFrame, keys: Sequence[str], t: str = "t", severity: str = "severity", tie: str | None = None) -> DataFrame:
    """Change from the detection before; detections of one moment follow by severity, then by ``tie``."""
    w = Window.partitionBy(*keys).orderBy(t, severity, *([tie] if tie else []))
    return dets.withColumn("severity_change", F.col(severity) - F.lag(severity).over(w)).withColumn("seen_so_far", F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)))
