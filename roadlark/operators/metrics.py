"""Accuracy metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import LOW_F1
from roadlark.functions import geo


def prf(df: DataFrame, truth: Column, flagged: Column, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, fpr (share of flagged that is wrong) and fnr."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = df.groupBy(*keys).agg(one(truth & flagged).alias("tp"), one(~truth & flagged).alias("fp"), one(truth & ~flagged).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    out = out.withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    return out.withColumn("fpr", 1 - F.col("precision")).withColumn("fnr", 1 - F.col("recall"))


def low_f1(scores: DataFrame, least: float = LOW_F1) -> DataFrame:
    return scores.where(F.col("f1") < least)


def average_precision(preds: DataFrame, n_truth: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Area under the precision-recall steps: mean over truths of the precision at each hit. ``preds`` has is_match."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("is_match").cast("int")
    stepped = preds.withColumn("_p", F.sum(hit).over(w) / F.count("*").over(w))
    sums = stepped.groupBy(*keys).agg(F.sum(F.when(F.col("is_match"), F.col("_p")).otherwise(0.0)).alias("_s"))
    return sums.join(n_truth, list(keys)).select(*keys, (F.col("_s") / F.col("n_truth")).alias("ap"))


#: Overlaps from which a prediction counts as a hit: 0.50, 0.55, ... 0.95.
IOU_STEPS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
#: Ranges of confidence that the precision curve is swept in.
CONFIDENCE_PARTS = 1024


def match_at(pred: DataFrame, truth: DataFrame, frame: Sequence[str], steps: Sequence[float] = IOU_STEPS) -> DataFrame:
    """``pred``'s frame keys, pred_id, confidence and is_match at each ``iou_step``, one truth for one prediction.

    In each frame predictions choose in the order of confidence (then pred_id); each takes the truth of the highest overlap
    that is still free and overlaps enough, so one whose best truth is taken falls back to its next. ``frame`` holds what
    both sides share (session, frame, class); a task sees the boxes of one frame.
    """
    t = truth.select(*frame, "truth_id", F.col("box").alias("_tbox"))
    near = pred.join(t, list(frame)).select("pred_id", F.struct((-geo.iou(F.col("box"), F.col("_tbox"))).alias("far"), "truth_id").alias("_c")).where(F.col("_c.far") <= -min(steps))
    near = near.groupBy("pred_id").agg(F.sort_array(F.collect_list("_c")).alias("_near"))
    own = pred.select(*frame, "pred_id", "confidence").join(near, "pred_id", "left")
    in_frame = own.groupBy(*frame).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("low"), "pred_id", "_near"))).alias("_preds"))
    stepped = in_frame.withColumn("iou_step", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    kind = truth.select(F.array("truth_id").alias("x")).schema["x"].dataType
    hits = F.array().cast(pred.select(F.array(F.struct("pred_id", "confidence", F.lit(True).alias("is_match"))).alias("x")).schema["x"].dataType)

    def choose(s: Column, p: Column) -> Column:
        def take(free: Column) -> Column:
            hit = F.get(free, F.lit(0))["truth_id"]
            found = F.size(free) > 0
            row = F.struct(p["pred_id"].alias("pred_id"), (-p["low"]).alias("confidence"), found.alias("is_match"))
            return F.struct(F.when(found, F.array_append(s["taken"], hit)).otherwise(s["taken"]).alias("taken"), F.array_append(s["hits"], row).alias("hits"))

        near = F.coalesce(p["_near"], F.array().cast(p_near))
        return geo.given(F.filter(near, lambda c: (c["far"] <= -F.col("iou_step")) & ~F.array_contains(s["taken"], c["truth_id"])), take)

    p_near = own.schema["_near"].dataType
    walked = stepped.select(*frame, "iou_step", F.aggregate("_preds", F.struct(F.array().cast(kind).alias("taken"), hits.alias("hits")), choose)["hits"].alias("_hits"))
    return walked.select(*frame, "iou_step", F.inline("_hits"))


def interpolated_precision(hits: DataFrame, n_truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the precision envelope of each key: keys, ap. ``hits`` has confidence (0 to 1) and is_match, ``n_truth`` keys and n_truth.

    A point of the curve takes all predictions from one confidence on; its envelope is the highest precision at it or at any
    point of more recall, a running maximum from the end. Both sweeps go by parts of the confidence: within a part a
    window, between parts one row a part. A key without truths has no ap; one without predictions has 0.
    """
    points = hits.groupBy(*keys, "confidence").agg(F.count("*").alias("_n"), F.sum(F.col("is_match").cast("int")).alias("_hit")).withColumn("_part", F.floor(F.col("confidence") * CONFIDENCE_PARTS))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.desc("confidence"))
    parts = points.groupBy(*keys, "_part").agg(F.sum("_n").alias("_pn"), F.sum("_hit").alias("_ph"))
    above = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_pn").over(above), F.lit(0)).alias("_bn"), F.coalesce(F.sum("_ph").over(above), F.lit(0)).alias("_bh"))
    both = [*keys, "_part"]
    curve = points.join(parts, both).withColumns({"_precision": (F.col("_bh") + F.sum("_hit").over(inside)) / (F.col("_bn") + F.sum("_n").over(inside))})
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = curve.groupBy(*both).agg(F.max("_precision").alias("_top"))
    tops = tops.select(*both, F.max("_top").over(below).alias("_later"))
    rising = Window.partitionBy(*both).orderBy("confidence")
    envelope = curve.join(tops, both).withColumn("_envelope", F.greatest(F.max("_precision").over(rising), "_later"))
    area = envelope.groupBy(*keys).agg(F.sum(F.col("_hit") * F.col("_envelope")).alias("_area"))
    return n_truth.where("n_truth > 0").join(area, list(keys), "left").select(*keys, (F.coalesce("_area", F.lit(0.0)) / F.col("n_truth")).alias("ap"))


def mean_average_precision(pred: DataFrame, truth: DataFrame, frame: Sequence[str], kind: str = "vehicle_class", steps: Sequence[float] = IOU_STEPS) -> DataFrame:
    """Of each class and in all (class null): ap_50, ap_75 and map, the mean over the ``steps`` of overlap. ``frame`` includes the class."""
    hits = match_at(pred, truth, frame, steps)
    n = truth.groupBy(kind).agg(F.count("*").alias("n_truth")).withColumn("iou_step", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    ap = interpolated_precision(hits, n, [kind, "iou_step"])
    at = lambda s: F.max(F.when(F.col("iou_step") == s, F.col("ap")))
    each = ap.groupBy(kind).agg(at(0.5).alias("ap_50"), at(0.75).alias("ap_75"), F.avg("ap").alias("map"))
    means = each.agg(*[F.avg(c).alias(c) for c in ("ap_50", "ap_75", "map")]).select(F.lit(None).cast(dict(each.dtypes)[kind]).alias(kind), "ap_50", "ap_75", "map")
    return each.unionByName(means)


def tracking_metrics(matched: DataFrame, t: str = "t") -> DataFrame:
    """MOTA, id switches and continuity from rows (truth_id, pred_track, t): null truth is a false alarm, null track a miss."""
    w = Window.partitionBy("truth_id").orderBy(t)
    both = F.col("truth_id").isNotNull() & F.col("pred_track").isNotNull()
    marked = matched.withColumn("_last", F.last(F.when(both, F.col("pred_track")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = marked.agg(one(F.col("truth_id").isNotNull()).alias("truths"), one(F.col("truth_id").isNotNull() & F.col("pred_track").isNull()).alias("misses"), one(F.col("truth_id").isNull()).alias("false_alarms"), one(both & (F.col("_last") != F.col("pred_track"))).alias("switches"))
    return out.withColumn("mota", 1 - (F.col("misses") + F.col("false_alarms") + F.col("switches")) / F.col("truths")).withColumn("switch_rate", F.col("switches") / F.col("truths")).withColumn("continuity", 1 - F.col("misses") / F.col("truths"))


#: Tasks among which the distinct values of a rank correlation are dealt.
RANK_BUCKETS = 256


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation, ties at their mean rank. Ranks come from the counts of equal values:
    sums within buckets of the value's range, plus what the buckets before hold."""

    def ranked(frame: DataFrame, c: str) -> DataFrame:
        sums = frame.groupBy(c).agg(F.count("*").alias("n"))
        value = F.col(c).cast("double")
        bounds = sums.select(value.alias("v")).approxQuantile("v", [k / RANK_BUCKETS for k in range(1, RANK_BUCKETS)], 0.2 / RANK_BUCKETS)
        edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<double>")
        sums = sums.withColumn("_b", F.size(F.filter(edges, lambda e: e <= value)))
        held = {r["_b"]: r["n"] for r in sums.groupBy("_b").agg(F.sum("n").alias("n")).collect()}
        before = F.array(*[F.lit(sum(n for b, n in held.items() if b < k)).cast("long") for k in range(RANK_BUCKETS)])
        upto = F.get(before, F.col("_b")) + F.sum("n").over(Window.partitionBy("_b").orderBy(c))
        return frame.join(sums.select(c, (upto - (F.col("n") - 1) / 2).alias(f"_r_{c}")), c)

    return ranked(ranked(df.select(x, y), x), y).agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count("*").alias("n"))


def geo_error(pred: DataFrame, lat: str = "lat", lng: str = "lng", true_lat: str = "true_lat", true_lng: str = "true_lng") -> DataFrame:
    far = geo.haversine(F.col(lat), F.col(lng), F.col(true_lat), F.col(true_lng))
    return pred.agg(F.avg(far).alias("mean_m"), F.max(far).alias("max_m"), F.avg((F.col("zone_id") == F.col("true_zone_id")).cast("double")).alias("zone_accuracy"))
