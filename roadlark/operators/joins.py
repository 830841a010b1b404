"""Joins: zones, neighbourhoods, as-of, intervals, matching and the usual keys.

Every distance join has an equi key (grid cell, time bucket) and the exact distance as a
residual, so it shuffles by cell and is never a nested loop over all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import DUPLICATE_M, DUPLICATE_S, OCCLUSION_S
from roadlark.functions import geo
from roadlark.functions.kinematics import cosine
from roadlark.operators.cover import join_cover

#: Covers of more zones than this are never broadcast, whatever their bytes.
BROADCAST_ZONES = 10_000


def join_zones(points: DataFrame, zones: DataFrame, *, cell_m: float | None = None) -> DataFrame:
    """Points with the zones whose polygon holds them. Zones have zone_id, polygon and what else is wanted.

    Both sides meet by cell of the polygons' covers; ``cell_m`` bounds the width of the first cells.
    """
    return join_cover(points, zones, widest=cell_m and cell_m / geo.METRES_PER_DEGREE, most_zones=BROADCAST_ZONES)


def within_distance_join(a: DataFrame, b: DataFrame, metres: float, keys: Sequence[str] = (), most_lat: float = 89.0, extra: Column | None = None, suffix: str = "_b") -> DataFrame:
    """Pairs of rows at most ``metres`` apart with equal ``keys``; columns of ``b`` get the suffix.

    Cells are twice as wide as the reach, and a row of ``a`` goes to the four that its reach may touch. The copies are merged by
    shuffles: their files look small enough to be broadcast, and the driver would hold all copies.
    """
    dlat = metres / geo.METRES_PER_DEGREE * 1.0002
    dlng = dlat / max(1e-6, math.cos(math.radians(min(most_lat, 89.9))))
    place = lambda i, j: geo.cell(F.col("lat") + i * dlat, F.col("lng") + j * dlng, 2.01 * metres, most_lat)
    touched = F.array_distinct(F.array(*[F.struct(*[c.alias(n) for n, c in zip("ab", place(i, j), strict=True)]) for i in (-1, 1) for j in (-1, 1)]))
    left = a.withColumn("_n", F.explode(touched)).withColumns({"_ca": F.col("_n.a"), "_cb": F.col("_n.b")}).drop("_n")
    ka, kb = place(0, 0)
    right = b.withColumns({"_ca": ka, "_cb": kb})
    right = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
    on = (F.col("_ca") == F.col("_ca" + suffix)) & (F.col("_cb") == F.col("_cb" + suffix))
    for k in keys:
        on = on & (F.col(k) == F.col(k + suffix))
    on = on & (geo.haversine(F.col("lat"), F.col("lng"), F.col("lat" + suffix), F.col("lng" + suffix)) <= metres)
    if extra is not None:
        on = on & extra
    return left.join(right.hint("merge"), on).drop("_ca", "_cb", "_ca" + suffix, "_cb" + suffix)


def cross_session_dups(events: DataFrame, metres: float = DUPLICATE_M, seconds: float = DUPLICATE_S, most_lat: float = 89.0, t: str = "t") -> DataFrame:
    """Pairs of events of one type from different sessions, close in space and time."""
    slack, width = seconds + 0.001, 2 * max(seconds, 1) + 1
    bucket = lambda x: F.floor(x / width).cast("long")
    a = events.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col(t) - slack), bucket(F.col(t) + slack)))))
    b = events.withColumn("_b", bucket(F.col(t)))
    extra = (F.col("session_id") < F.col("session_id_b")) & (F.abs(F.col(t) - F.col(t + "_b")) <= seconds)
    return within_distance_join(a, b, metres, ["vtype", "_b"], most_lat, extra).drop("_b", "_b_b")


def keep_best(events: DataFrame, pairs: DataFrame, key: str = "event_id") -> DataFrame:
    """Events with status ``duplicate`` for the less confident one of each pair (ties: the larger id)."""
    first_wins = (F.col("confidence") > F.col("confidence_b")) | ((F.col("confidence") == F.col("confidence_b")) & (F.col(key) < F.col(key + "_b")))
    losers = pairs.select(F.when(first_wins, F.col(key + "_b")).otherwise(F.col(key)).alias(key)).distinct().withColumn("_dup", F.lit(True))
    return events.join(losers, key, "left").withColumn("status", F.when(F.col("_dup"), "duplicate").otherwise(F.col("status"))).drop("_dup")


def intervals(states: DataFrame, keys: Sequence[str], t: str = "t", value: str = "state") -> DataFrame:
    """State changes as intervals [valid_from, valid_to)."""
    w = Window.partitionBy(*keys).orderBy(t)
    return states.select(*keys, F.col(value), F.col(t).alias("valid_from"), F.lead(t).over(w).alias("valid_to"))


#: Seconds of a time bucket. Histories are swept bucket by bucket, so that a key with a long one is no single task.
SWEEP_S = 3600.0


def _swept(rows: DataFrame, keys: Sequence[str], mark: str, seen: Callable[[Column], Column], bucket_s: float) -> DataFrame:
    """``rows`` (keys, _t, _side, ``mark``) with _seen: ``seen`` over the marks of their keys so far, in the order of (_t, _side).

    Within a bucket it is a window; what the buckets before hold comes from one row a bucket.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col("_t") / bucket_s))
    own = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = bucketed.withColumns({"_within": seen(F.col(mark)).over(own), "_end": seen(F.col(mark)).over(whole)})
    ends = inside.groupBy(*keys, "_bucket").agg(F.first("_end").alias("_end"))
    before = seen(F.col("_end")).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), before.alias("_before"))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return inside.join(carried, on, "left").drop("_b", "_bucket", "_end", *[f"_k_{i}" for i in range(len(keys))])


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str = "t", values: Sequence[str] = ("state",), bucket_s: float = SWEEP_S) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before it.

    Both sides go through one sweep over their union, sorted by time, so the cost is a sort and
    not the product of the sides; a key's history is swept in buckets of ``bucket_s``, each with the last values carried in.
    """
    marks = F.struct(*[F.col(v) for v in values])
    columns = left.columns
    a = left.select(F.struct(*columns).alias("_row"), *keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(marks.alias("m")).schema["m"].dataType).alias("_mark"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), marks.alias("_mark"))
    both = _swept(a.unionByName(b), keys, "_mark", lambda c: F.last(c, ignorenulls=True), bucket_s).where("_side = 1")
    return both.withColumn("_last", F.coalesce("_within", "_before")).select("_row.*", *[F.col("_last")[v].alias(v) for v in values])


def tag_intervals(events: DataFrame, windows: DataFrame, keys: Sequence[str], tag: str, t: str = "t", bucket_s: float = SWEEP_S) -> DataFrame:
    """Events with boolean ``tag``: whether an interval [start, end] of their keys holds them.

    A sweep over events and starts in time order carries the latest end of what has begun, so the work is
    linear in both and no event meets a window. Intervals may nest and overlap; one without end,
    or that ends before it starts, holds nothing, and so does one of a null key.
    """
    sound = F.lit(True)
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    a = events.select(F.struct(*events.columns).alias("_row"), *keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_mark"))
    b = windows.where(sound & (F.col("start") <= F.col("end"))).select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *keys, F.col("start").cast("double").alias("_t"), F.lit(0).alias("_side"), F.col("end").cast("double").alias("_mark"))
    both = _swept(a.unionByName(b), keys, "_mark", F.max, bucket_s).where("_side = 1")
    return both.select("_row.*", F.coalesce(F.greatest("_within", "_before") >= F.col("_t"), F.lit(False)).alias(tag))


def enrich(events: DataFrame, *lookups: tuple[DataFrame, str]) -> DataFrame:
    for table, key in lookups:
        events = events.join(table, key, "left")
    return events


def split_new_existing(dets: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = inventory.select(*keys).distinct().withColumn("_known", F.lit(True))
    return dets.join(known, list(keys), "left").withColumn("action", F.when(F.col("_known"), "update").otherwise("insert")).drop("_known")


def suppress_jams(candidates: DataFrame, points: DataFrame, keys: Sequence[str], *, stopped_kmh: float, least_tracks: int = 3) -> DataFrame:
    """Drops candidates at moments when all of at least ``least_tracks`` tracks of the road stand still."""
    jam = points.groupBy(*keys).agg(F.bool_and(F.col("speed") < stopped_kmh).alias("_all"), F.count_distinct("track_id").alias("_n")).where((F.col("_all")) & (F.col("_n") >= least_tracks)).select(*keys)
    return candidates.join(jam, list(keys), "left_anti")


def compare_periods(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    left, right = a.withColumnRenamed(value, "n_a"), b.withColumnRenamed(value, "n_b")
    joined = left.join(right, list(keys), "full")
    return joined.select(*keys, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).withColumn("change", F.col("n_b") - F.col("n_a"))


#: Rows of a task of ``match_ground_truth``: their sort buffers take some tens of MB, whatever the table's size.
MATCH_ROWS = 250_000


def match_ground_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str], least_iou: float = 0.5, parts: int | None = None) -> DataFrame:
    """Each prediction with its best overlapping truth of the same frame; a truth is matched once, by confidence.

    Rows are dealt by prediction and by truth into ``parts``; if it is not told, predictions are counted for it.
    """
    parts = parts or max(1, -(-pred.count() // MATCH_ROWS))
    t = truth.select(*keys, F.col("truth_id"), F.col("box").alias("_tbox"))
    pairs = pred.select(*keys, "pred_id", "confidence", "box").join(t, list(keys)).withColumn("iou", geo.iou(F.col("box"), F.col("_tbox"))).where(F.col("iou") >= least_iou)
    pairs = pairs.select("pred_id", "truth_id", "confidence", "iou").repartition(parts, "pred_id")
    best = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("pred_id").orderBy(F.desc("iou"), "truth_id"))).where("_r = 1").repartition(parts, "truth_id")
    once = best.withColumn("_r", F.row_number().over(Window.partitionBy("truth_id").orderBy(F.desc("confidence"), "pred_id"))).where("_r = 1")
    found = once.select("pred_id", "truth_id", "iou").repartition(parts, "pred_id")
    return pred.repartition(parts, "pred_id").join(found, "pred_id", "left").withColumn("is_match", F.col("truth_id").isNotNull())


def reid(lost: DataFrame, new: DataFrame, seconds: float = OCCLUSION_S, least: float = 0.8) -> DataFrame:
    """For each lost track the most similar track that appears within ``seconds``."""
    n = new.select(*[F.col(c).alias(c + "_new") for c in new.columns])
    bucket = F.floor(F.col("t_end") / seconds).cast("long")
    a = lost.withColumn("_b", F.explode(F.array(bucket, bucket + 1)))
    b = n.withColumn("_b", F.floor(F.col("t_start_new") / seconds).cast("long"))
    pairs = a.join(b, "_b").where((F.col("t_start_new") > F.col("t_end")) & (F.col("t_start_new") - F.col("t_end") <= seconds) & (F.col("track_id") != F.col("track_id_new")))
    scored = pairs.withColumn("similarity", cosine(F.col("vec"), F.col("vec_new"))).where(F.col("similarity") >= least)
    return scored.withColumn("_r", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("similarity"), "track_id_new"))).where("_r = 1").drop("_r", "_b")


def affected_events(events: DataFrame, scenario: DataFrame) -> DataFrame:
    """Events inside any polygon of a scenario table (semi join; scenarios are drawn by hand and few)."""
    zones = scenario.withColumnRenamed("scenario_id", "zone_id").select("zone_id", "polygon")
    ids = join_zones(events.select("event_id", "lat", "lng"), zones).select("event_id").distinct()
    return events.join(ids, "event_id", "left_semi")


def compare_scenarios(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "after") -> DataFrame:
    return compare_periods(a.select(*keys, F.col(value).alias("n")), b.select(*keys, F.col(value).alias("n")), keys)


def attach_rider(dets: DataFrame, crops: DataFrame) -> DataFrame:
    return dets.join(crops, (dets["frame_no"] == crops["frame_no"]) & (dets["det_id"] == crops["parent_det_id"])).drop(crops["frame_no"])


def wet_pothole(masks: DataFrame, least_iou: float = 0.1, factor: float = 0.5) -> DataFrame:
    """Masks with ``waterlogged`` and a confidence lowered for potholes that overlap standing water of their frame."""
    water = masks.where("anomaly_type = 'waterlogging'").select("session_id", "frame_no", F.col("box").alias("_water"))
    wet = masks.where("anomaly_type = 'pothole'").join(water, ["session_id", "frame_no"]).where(geo.iou(F.col("box"), F.col("_water")) >= least_iou)
    out = masks.join(wet.select("det_id").distinct().withColumn("_wet", F.lit(True)), "det_id", "left").withColumn("waterlogged", F.coalesce("_wet", F.lit(False)))
    return out.withColumn("confidence", F.when(F.col("waterlogged"), F.col("confidence") * factor).otherwise(F.col("confidence"))).drop("_wet")


def attach_road_class(anomalies: DataFrame, zones: DataFrame) -> DataFrame:
    """Anomalies with the road class of their zone and whether a school or hospital is near."""
    return anomalies.join(zones.select("zone_id", "road_class", "near_school"), "zone_id", "left").withColumn("near_school", F.coalesce("near_school", F.lit(False)))
