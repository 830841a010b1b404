"""The ten traffic rules over track points already joined with zones.

Points have track_id, zone_id, zone_type, t, speed, heading, vehicle_class and what the rule
reads. Every rule returns rule, track_id, zone_id, started, ended, n_frames and measured. All
thresholds are strict but that of the passengers. The confidence of a rule is reported with
``with_reference``; it is never a gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark import config as C
from roadlark.functions.kinematics import ang_diff
from roadlark.operators.filters import drop_emergency, full_bbox
from roadlark.operators.joins import asof, suppress_jams
from roadlark.operators.windows import sustained, zone_visits

KEYS = ["track_id", "zone_id"]


def _events(found: DataFrame, rule: str, measured: Column) -> DataFrame:
    return found.select(F.lit(rule).alias("rule"), "track_id", "zone_id", F.col("run_start").alias("started"), F.col("run_end").alias("ended"), "n_frames", measured.cast("double").alias("measured"))


def _of(points: DataFrame, *zone_types: str) -> DataFrame:
    return points.where(F.col("zone_type").isin(*zone_types))


def no_parking(points: DataFrame) -> DataFrame:
    """Slower than 2 km/h for longer than the zone's grace period."""
    own = _of(points, "no_parking").withColumn("grace_period", F.coalesce("grace_period", F.lit(C.PARKING_GRACE_S)))
    return _events(sustained(own, F.col("speed") < C.PARKED_KMH, [*KEYS, "grace_period"], seconds=F.col("grace_period")), "no_parking", F.col("duration_s"))


def wrong_way(points: DataFrame) -> DataFrame:
    """Against the permitted direction for more than 5 frames; a track whose last heading in the zone is not against it was turning.

    Without a heading at the exit the frames alone decide.
    """
    own = _of(points, "lane").where("permitted_dir is not null")
    against = lambda c: ang_diff(F.col(c), F.col("permitted_dir")) > C.WRONG_WAY_DEG
    own = own.withColumn("exit_heading", F.max_by("heading", "t").over(Window.partitionBy(*KEYS)))
    found = sustained(own, against("heading") & F.coalesce(against("exit_heading"), F.lit(True)), [*KEYS, "permitted_dir"], frames=C.WRONG_WAY_FRAMES)
    return _events(found, "wrong_way", F.col("n_frames"))


def illegal_u_turn(points: DataFrame) -> DataFrame:
    """Turned by more than 160 degrees inside a restricted zone, in a smooth arc."""
    visits = zone_visits(_of(points, "u_turn"))
    found = visits.where((F.abs("turn") > C.U_TURN_DEG) & (F.col("smoothness") >= C.U_TURN_SMOOTHNESS))
    return found.select(F.lit("illegal_u_turn").alias("rule"), *KEYS, F.col("entered").alias("started"), F.col("left").alias("ended"), F.lit(1).cast("long").alias("n_frames"), F.abs("turn").cast("double").alias("measured"))


def red_light(points: DataFrame, signals: DataFrame) -> DataFrame:
    """Crosses the stop line on red. ``offset`` is negative before the line; signals are (zone_id, t, state).

    Whoever stands behind the line when it turns red has not crossed yet; whoever is past it
    then does not cross on red, because the crossing step lies before that moment.
    """
    own = drop_emergency(_of(points, "stop_line"))
    before = F.lag("offset").over(Window.partitionBy(*KEYS).orderBy("t"))
    crossing = own.withColumn("_before", before).where((F.col("_before") < 0) & (F.col("offset") >= 0))
    found = asof(crossing.drop("_before"), signals, ["zone_id"]).where("state = 'RED'")
    return found.select(F.lit("red_light").alias("rule"), *KEYS, F.col("t").alias("started"), F.col("t").alias("ended"), F.lit(1).cast("long").alias("n_frames"), F.col("offset").cast("double").alias("measured"))


def speeding(points: DataFrame, *, frame_size: tuple[float, float] | None = None) -> DataFrame:
    """Above the limit for more than 10 frames, by the mean speed of a frame and its neighbours.

    With the frame's width and height, points whose ``box`` its edge cuts are left out first.
    """
    own = _of(points, "speed").where("speed_limit is not null")
    if frame_size is not None:
        own = full_bbox(own, *frame_size)
    smooth = F.avg("speed").over(Window.partitionBy(*KEYS).orderBy("t").rowsBetween(-1, 1))
    own = own.withColumn("smooth_speed", F.when(F.col("speed").isNotNull(), smooth))
    return _events(sustained(own, F.col("smooth_speed") > F.col("speed_limit"), [*KEYS, "speed_limit"], frames=C.SPEEDING_FRAMES), "speeding", F.col("n_frames"))


def lane(points: DataFrame) -> DataFrame:
    """Beyond a lane boundary for longer than 3 s; a dashed line allows twice that."""
    own = _of(points, "lane_boundary").withColumn("allowed_s", F.when(F.col("lane_type") == "dashed", 2 * C.LANE_S).otherwise(C.LANE_S))
    return _events(sustained(own, F.col("lane_offset") > 0, [*KEYS, "allowed_s"], seconds=F.col("allowed_s")), "lane", F.col("duration_s"))


def zebra_crossing(points: DataFrame, *, jam_keys: tuple[str, ...] = ("zone_id", "t")) -> DataFrame:
    """Stands on a crossing for longer than 10 s, unless the whole road stands."""
    own = _of(points, "zebra")
    free = suppress_jams(own, own, list(jam_keys), stopped_kmh=C.PARKED_KMH)
    return _events(sustained(free, F.col("speed") < C.PARKED_KMH, KEYS, seconds=C.ZEBRA_S), "zebra_crossing", F.col("duration_s"))


def no_helmet(points: DataFrame) -> DataFrame:
    """A bare head with more than 80 % confidence; the best frame of each track."""
    own = points.where(F.col("helmet_conf") > C.HELMET_CONFIDENCE)
    found = own.groupBy(*KEYS).agg(F.min("t").alias("run_start"), F.max("t").alias("run_end"), F.count("*").alias("n_frames"), F.max("helmet_conf").alias("m"))
    return _events(found, "no_helmet", F.col("m"))


def overloading(points: DataFrame) -> DataFrame:
    """Three persons or more on a two-wheeler."""
    own = points.where((F.col("passengers") >= C.PASSENGERS) & (F.col("vehicle_class") == "motorcycle"))
    found = own.groupBy(*KEYS).agg(F.min("t").alias("run_start"), F.max("t").alias("run_end"), F.count("*").alias("n_frames"), F.max("passengers").alias("m"))
    return _events(found, "overloading", F.col("m"))


def highway_stop(points: DataFrame, *, jam_keys: tuple[str, ...] = ("zone_id", "t")) -> DataFrame:
    """Slower than 5 km/h on a highway for longer than 20 s, unless the whole road stands; may be a breakdown."""
    own = _of(points, "highway")
    free = suppress_jams(own, own, list(jam_keys), stopped_kmh=C.HIGHWAY_KMH)
    return _events(sustained(free, F.col("speed") < C.HIGHWAY_KMH, KEYS, seconds=C.HIGHWAY_S), "highway_stop", F.col("duration_s"))


def all_rules(points: DataFrame, signals: DataFrame) -> DataFrame:
    found = [f(points) for f in (no_parking, wrong_way, illegal_u_turn, speeding, lane, zebra_crossing, no_helmet, overloading, highway_stop)]
    out = red_light(points, signals)
    for f in found:
        out = out.unionByName(f)
    return out


def with_reference(events: DataFrame, confidence: str = "confidence") -> DataFrame:
    """``reference_threshold`` of each rule and whether the event reaches it."""
    table = F.create_map(*[F.lit(x) for r, p in C.RULE_CONFIDENCE.items() for x in (r, p / 100)])
    return events.withColumn("reference_threshold", F.try_element_at(table, F.col("rule"))).withColumn("reaches_reference", F.col(confidence) >= F.col("reference_threshold"))
