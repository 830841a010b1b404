"""Recommendations, what-if projections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.config import IMPACT, PROMOTE_SESSIONS, RECOMMENDATIONS
from roadlark.operators.aggregates import composition, trend
from roadlark.operators.joins import attach_road_class
from roadlark.operators.windows import vs_previous


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, s, r, m, list(needs)) for t, s, r, m, needs in RECOMMENDATIONS], "vtype string, least_share double, rec_type string, measure string, needs array<string>")


def place_context(dets: DataFrame, zones: DataFrame, key: str, kind: str = "anomaly_type") -> DataFrame:
    """What rules ask of a place, per key and type: most findings high, on arterial roads or near a school; found in two sessions or more."""
    most = lambda c: F.count_if(c) * 2 > F.count("*")
    return (
        attach_road_class(dets, zones)
        .groupBy(key, F.col(kind).alias("vtype"))
        .agg(
            most(F.col("severity_band") == "high").alias("mostly_high"),
            most(F.col("road_class") == "arterial").alias("arterial"),
            most(F.col("near_school")).alias("near_school"),
            (F.count_distinct("session_id") >= PROMOTE_SESSIONS).alias("chronic"),
        )
    )


#: What a zone table may say of a place for the traffic rules.
ZONE_FLAGS = ("at_intersection", "near_school", "multi_lane")


def zone_context(events: DataFrame, zones: DataFrame, key: str, kind: str = "vtype") -> DataFrame:
    """Per key and type, whether most of its events lie in zones at an intersection, near a school or hospital, on several lanes."""
    marked = events.join(zones.select("zone_id", *ZONE_FLAGS), "zone_id", "left")
    return marked.groupBy(key, kind).agg(*[(F.count_if(F.coalesce(F.col(f), F.lit(False))) * 2 > F.count("*")).alias(f) for f in ZONE_FLAGS])


def apply_rules(profiles: DataFrame, rules: DataFrame, key: str = "cluster_id", strict: bool = False) -> DataFrame:
    """Profiles (key, vtype, n, share) against the rule table: a share strictly above a rule's makes a recommendation.

    What a rule needs of the place is a boolean column of the profiles of that name; null does not
    hold. A column that the profiles lack says nothing, and the share alone decides, unless ``strict``
    demands it: then it does not hold, and no rule is weaker than it is written. Reports are strict.
    """
    found = profiles.join(F.broadcast(rules), "vtype").where(F.col("share") > F.col("least_share"))
    for need in sorted({n for *_, needs in RECOMMENDATIONS for n in needs}):
        holds = F.coalesce(F.col(need), F.lit(False)) if need in profiles.columns else F.lit(not strict)
        found = found.where(~F.array_contains("needs", need) | holds)
    return found.drop("needs")


def enforcement_hours(events: DataFrame, key: str, k: int = 1, ts: str = "ts") -> DataFrame:
    """The busiest hours of each place over all types."""
    counts = events.groupBy(key, F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "hour"))).where(F.col("rank") <= k)


def impact_table(spark) -> DataFrame:
    return spark.createDataFrame([(c, t, lo, mid, hi) for c, (t, lo, mid, hi) in IMPACT.items()], "change_type string, vtype string, low double, mid double, high double")


def project(affected: DataFrame, change_type: str, months: float, keys: tuple[str, ...] = ("vtype",)) -> DataFrame:
    """Events a month before, and after a change at low, middle and high effect; other types stay as they are."""
    table = impact_table(affected.sparkSession).where(F.col("change_type") == change_type)
    before = affected.groupBy(*keys).agg((F.count("*") / F.lit(months)).alias("before"))
    j = before.join(F.broadcast(table), "vtype", "left")
    after = lambda c: (F.col("before") * (1 - F.coalesce(c, F.lit(0.0)))).alias(f"after_{c}")
    return j.select(*keys, "before", after("low"), after("mid"), after("high"))


def zone_report(events: DataFrame, unit: str = "day", ts: str = "ts") -> DataFrame:
    """Counts by zone, type and period with the change from the period before and the rank of the zone's types."""
    counts = vs_previous(trend(events, unit, ts, ("zone_id", "vtype")), ("zone_id", "vtype"), "bucket")
    return counts.withColumn("rank", F.rank().over(Window.partitionBy("zone_id", "bucket").orderBy(F.desc("n"))))


def road_condition_report(inventory: DataFrame, key: str = "anomaly_id") -> DataFrame:
    w = Window.orderBy(F.desc("severity"), F.desc("n_sessions"), key)
    return inventory.groupBy("anomaly_type", "severity_band").agg(F.count("*").alias("n"), F.avg("severity").alias("mean_severity"), F.max("n_sessions").alias("most_sessions")).withColumn("priority", F.row_number().over(Window.orderBy(F.desc("mean_severity"), "anomaly_type"))) if "severity_band" in inventory.columns else inventory.withColumn("priority", F.row_number().over(w))


def session_report(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count("*").alias("n_events"), F.count_distinct("track_id").alias("vehicles"), F.avg("confidence").alias("mean_confidence"), F.percentile("confidence", F.lit(0.5)).alias("median_confidence"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def planning_report(clustered: DataFrame, events: DataFrame, zones: DataFrame, months: float) -> DataFrame:
    """Cluster profile, recommendation and the projected rate after it; ``zones`` tell what the rules ask of the place."""
    spark = clustered.sparkSession
    placed = clustered.select("event_id", "cluster_id", "vtype").join(events.select("event_id", "zone_id"), "event_id")
    profiles = composition(clustered).join(zone_context(placed, zones, "cluster_id"), ["cluster_id", "vtype"])
    rec = apply_rules(profiles, rule_table(spark), strict=True)
    effect = impact_table(spark).select("vtype", "mid")
    return rec.join(F.broadcast(effect), "vtype", "left").select("cluster_id", "vtype", "n", "share", "rec_type", (F.col("n") / F.lit(months)).alias("before"), (F.col("n") / F.lit(months) * (1 - F.coalesce("mid", F.lit(0.0)))).alias("after"))
