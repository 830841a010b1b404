"""Queries over road anomalies, clusters, recommendations, projections and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlark.operators import aggregates as agg
from roadlark.operators import anomalies as ano
from roadlark.operators import clustering, lists, planning
from roadlark.operators import windows as win
from roadlark.plans.fixtures import A, V, anomalies, metres, violations
from roadlark.plans.registry import query

WEIGHT = "least(1e0, greatest(0e0, raw * case anomaly_type when 'pothole' then 1e0 when 'crack' then 0.8e0 when 'waterlogging' then 0.9e0 else 0.7e0 end))"
BAND = "case when round(severity, 9) < 0.33e0 then 'low' when round(severity, 9) < 0.66e0 then 'medium' else 'high' end"
S = f"{A}, s as (select *, {BAND} as severity_band from (select *, {WEIGHT} as severity from a))"
KEYS = "anomaly_type, zone_id"


def scored(spark, sf_dir):
    out = ano.with_severity(anomalies(spark, sf_dir)).withColumn("severity", F.round("severity", 9))
    from roadlark.functions.scores import band

    return out.withColumn("severity_band", band(F.col("severity")))


@query(f"with {S} select det_id, anomaly_type, round(severity, 6) as severity, severity_band, count(*) as n from s group by all")
def anomaly_severity(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("det_id", "anomaly_type", F.round("severity", 6).alias("severity"), "severity_band").agg(F.count("*").alias("n"))


@query(f"with {S} select anomaly_type, count(*) filter (severity_band = 'low') as low, count(*) filter (severity_band = 'medium') as medium, count(*) filter (severity_band = 'high') as high from s group by all")
def severity_breakdown(spark, sf_dir):
    return agg.severity_breakdown(scored(spark, sf_dir))


@query(f"with {S} select {KEYS}, count(distinct session_id) as n_sessions, count(distinct session_id) >= 2 as chronic from s group by all")
def chronic_vs_oneoff(spark, sf_dir):
    return agg.chronic(scored(spark, sf_dir), ["anomaly_type", "zone_id"])


@query(f"with {S} select {KEYS}, count(distinct session_id) as n_sessions, min(t) as first_seen, max(t) as last_seen, count(*) as n_dets, round(max(severity), 6) as worst from s group by all")
def anomaly_recurrence(spark, sf_dir):
    return agg.recurrence(scored(spark, sf_dir), ["anomaly_type", "zone_id"]).select("anomaly_type", "zone_id", "n_sessions", "first_seen", "last_seen", "n_dets", F.round("worst", 6).alias("worst"))


@query(f"with {S}, i as (select {KEYS}, round(max(severity), 6) as severity, count(distinct session_id) as n_sessions, count(*) as n_dets from s group by all) select *, row_number() over (order by severity desc, n_sessions desc, anomaly_type, zone_id) as priority from i")
def condition_inventory_ranked(spark, sf_dir):
    i = scored(spark, sf_dir).groupBy("anomaly_type", "zone_id").agg(F.round(F.max("severity"), 6).alias("severity"), F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_dets"))
    return win.rank_within(i, [F.lit(1)], [F.desc("severity"), F.desc("n_sessions"), "anomaly_type", "zone_id"], "priority").withColumn("priority", F.col("priority").cast("long"))


@query(f"with {A} select distinct anomaly_type, zone_id, session_id from a")
def distinct_defects(spark, sf_dir):
    return lists.distinct_defects(anomalies(spark, sf_dir), ["anomaly_type", "zone_id", "session_id"])


@query(f"with {S}, c as (select distinct anomaly_type, lat, lng, session_id, l_key from (select *, l as l_key from (select s.*, (round(lat * 1000)::bigint * 100000 + round(lng * 1000)::bigint) as l from s))) select anomaly_type, l_key as spot, count(distinct session_id) as n_sessions from c group by all")
def anomaly_dedup_inventory(spark, sf_dir):
    """Detections of one type a metre or two apart are one defect: the fixture's spots lie 100 m from each other."""
    d = anomalies(spark, sf_dir).groupBy("anomaly_type", "lat", "lng").agg(F.min(F.col("part") * 10 + F.col("session_id")).alias("det_id"), F.collect_set("session_id").alias("sessions"))
    merged = ano.dedup(d, 3.0, most_lat=17.7)
    spot = F.round(F.col("lat") * 1000).cast("long") * 100000 + F.round(F.col("lng") * 1000).cast("long")
    return merged.withColumn("session_id", F.explode("sessions")).withColumn("spot", spot).groupBy("anomaly_type", "anomaly_id").agg(F.min("spot").alias("spot"), F.count_distinct("session_id").alias("n_sessions")).drop("anomaly_id")


@query(f"with {S}, x as (select {KEYS}, max(severity) as sev, count(*) as n, min(t) as f, max(t) as l from s where session_id = 0 group by all), y as (select {KEYS}, max(severity) as sev, count(*) as n, min(t) as f, max(t) as l from s where session_id = 1 group by all) select anomaly_type, zone_id, round(greatest(x.sev, y.sev), 6) as severity, coalesce(x.n, 0) + coalesce(y.n, 0) as n_dets, least(x.f, y.f) as first_seen, greatest(x.l, y.l) as last_seen, case when x.n is null then 'insert' when y.n is null then 'keep' else 'update' end as action from x full join y using (anomaly_type, zone_id)")
def anomaly_upsert(spark, sf_dir):
    def part(k):
        return scored(spark, sf_dir).where(f"session_id = {k}").groupBy("anomaly_type", "zone_id").agg(F.max("severity").alias("severity"), F.count("*").alias("n_dets"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))

    return ano.upsert(part(0), part(1), ["anomaly_type", "zone_id"]).withColumn("severity", F.round("severity", 6))


@query(f"with {S} select det_id, t, zone_id, round(severity - lag(severity) over (partition by anomaly_type, zone_id order by t, round(severity, 9), det_id), 6) as severity_change from (select det_id, anomaly_type, zone_id, t, max(severity) as severity from s group by all)")
def severity_trend(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("det_id", "anomaly_type", "zone_id", "t").agg(F.max("severity").alias("severity"))
    return win.severity_trend(d, ["anomaly_type", "zone_id"], tie="det_id").select("det_id", "t", "zone_id", F.round("severity_change", 6).alias("severity_change"))


@query(f"with {V}, {A} select zone_id, count(*) as n, sum(case when kind = 'violation' then 1 else 0 end)::bigint as n_violations from (select zone_id, 'violation' as kind from v union all select zone_id, 'anomaly' from a) group by all")
def combined_feed_union(spark, sf_dir):
    v = violations(spark, sf_dir).select("zone_id", F.lit("violation").alias("kind"))
    a = anomalies(spark, sf_dir).select("zone_id", F.lit("anomaly").alias("kind"))
    feed = lists.combined_feed(v, a)
    return feed.groupBy("zone_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kind") == "violation", 1).otherwise(0)).alias("n_violations"))


@query(f"with {V}, {A} select zone_id from v group by zone_id having count(*) >= 30 intersect select zone_id from a group by zone_id having count(*) >= 30")
def hot_in_both_intersect(spark, sf_dir):
    return lists.hot_in_both(violations(spark, sf_dir), anomalies(spark, sf_dir), 30)


DB = f"""{V}, n as (select a.event_id as a, b.event_id as b, a.vtype from v a join v b on a.vtype = b.vtype and abs(a.lat - b.lat) < 0.0005e0 and abs(a.lng - b.lng) < 0.0006e0 where {metres('a', 'b')} <= 50),
core as (select a, vtype from n group by all having count(*) >= 10), e as (select n.a, n.b from n where a in (select a from core) and b in (select a from core)),
r(node, label) as (select a, a from core union select e.b, r.label from r join e on e.a = r.node), l as (select node, min(label) as cluster_id from r group by node),
d as (select c.a as event_id, c.vtype, l.cluster_id, 'core' as role from core c join l on l.node = c.a union all select n.a, n.vtype, min(l.cluster_id), 'border' from n join l on l.node = n.b where n.a not in (select a from core) group by n.a, n.vtype)"""


def clustered(spark, sf_dir):
    v = violations(spark, sf_dir)
    return clustering.dbscan(v)


@query(f"with recursive {DB} select event_id, vtype, cluster_id, role from d")
def dbscan_clusters(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_id", "vtype", "cluster_id", "role")


@query(f"with recursive {DB} select count(*) as n from v where event_id not in (select event_id from d)")
def noise_events_anti(spark, sf_dir):
    return lists.noise(violations(spark, sf_dir), clustered(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"with recursive {DB} select cluster_id, count(*) as n_events, round(avg(confidence), 6) as mean_severity, min(t) as first_detected from d join v using (event_id) group by all")
def cluster_profile(spark, sf_dir):
    v = violations(spark, sf_dir).select("event_id", "lat", "lng", "t", "confidence")
    return agg.cluster_summary(clustered(spark, sf_dir).join(v, "event_id")).select("cluster_id", "n_events", F.round("mean_severity", 6).alias("mean_severity"), "first_detected")


REC = "rules(vtype, least_share, rec_type, mid) as (values ('red_light', 0.4, 'signal', 0.75), ('speeding', 0.4, 'speed_bump', 0.65), ('wrong_way', 0.4, 'one_way', 0.89), ('lane', 0.5, 'signage', 0.5))"
#: Zones by number: every other one at an intersection, and so on; with {z} for the number.
FLAGS = {"at_intersection": "{z} % 2 = 0", "near_school": "{z} % 5 <> 4", "multi_lane": "{z} % 3 <> 1"}
#: What the traffic rules need, as SQL over columns of these names.
NEEDS = "case vtype when 'red_light' then at_intersection when 'speeding' then near_school when 'lane' then multi_lane else true end"
#: Seventy road segments, each with a type of its own that two thirds of its events have.
SEGMENT = "case when event_id {div} 2 % 3 = 0 then event_id {div} 2 * 31 % 70 else event_id {div} 2 % 10 * 7 + event_id {div} 2 {div} 10 % 7 end"
Z = f"{V}, {REC}, c as (select {SEGMENT.format(div='//')} as segment, vtype, count(*) as n from v group by all), f as (select *, n / sum(n) over (partition by segment) as share, {', '.join(e.format(z='segment') + ' as ' + k for k, e in FLAGS.items())} from c)"


def zone_flags(spark, n: int):
    return spark.range(n).selectExpr("id as zone_id", *[f"{e.format(z='id')} as {k}" for k, e in FLAGS.items()])


@query(f"with {Z} select segment, vtype, n, round(share, 6) as share, rec_type from f join rules using (vtype) where share > least_share and {NEEDS}")
def recommendations(spark, sf_dir):
    """Traffic measures at the real shares, with what the rules ask of the place."""
    v = violations(spark, sf_dir).withColumn("zone_id", F.expr(SEGMENT.format(div="div")))
    profiles = agg.composition(v, "zone_id").join(planning.zone_context(v, zone_flags(spark, 70), "zone_id"), ["zone_id", "vtype"])
    found = planning.apply_rules(profiles, planning.rule_table(spark), "zone_id", strict=True)
    return found.select(F.col("zone_id").alias("segment"), "vtype", "n", F.round("share", 6).alias("share"), "rec_type")


@query(f"""with {S}, c as (select part // 2 as place, anomaly_type as vtype, count(*) as n, 2 * count(*) filter (severity_band = 'high') > count(*) as mostly_high, 2 * count(*) filter (zone_id % 3 = 0) > count(*) as arterial, count(distinct session_id) >= 2 as chronic from s group by all),
    f as (select *, n / sum(n) over (partition by place) as share from c) select place, vtype, n, round(share, 6) as share, case vtype when 'pothole' then 'resurfacing' else 'drainage' end as rec_type from f where share > 0.4e0 and ((vtype = 'pothole' and mostly_high and arterial) or (vtype = 'waterlogging' and chronic))""")
def road_recommendations(spark, sf_dir):
    """Resurfacing and drainage at the real shares, with what the rules ask of the place; a place is two neighbouring parts."""
    found = scored(spark, sf_dir).withColumn("place", F.expr("part div 2"))
    zones = spark.range(23).selectExpr("id as zone_id", "if(id % 3 = 0, 'arterial', 'local') as road_class", "id % 5 = 0 as near_school")
    profiles = agg.composition(found, "place", "anomaly_type").withColumnRenamed("anomaly_type", "vtype")
    profiles = profiles.join(planning.place_context(found, zones, "place"), ["place", "vtype"])
    return planning.apply_rules(profiles, planning.rule_table(spark), "place", strict=True).select("place", "vtype", "n", F.round("share", 6).alias("share"), "rec_type")


@query(f"with {V}, h as (select zone_id, (t // 3600) % 24 as hour, count(*) as n from v group by all) select zone_id, hour, n, r as rank from (select *, row_number() over (partition by zone_id order by n desc, hour) as r from h) where r <= 2")
def enforcement_hours(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("hour", F.expr("t div 3600 % 24"))
    return agg.top_k_per(v, "zone_id", "hour", 2).select("zone_id", "hour", "n", F.col("rank").cast("long").alias("rank"))


@query(f"with {V}, c as (select vtype, count(*) / 3e0 as before from v where zone_id < 5 group by all) select vtype, round(before, 6) as before, round(before * case vtype when 'red_light' then 0.3e0 else 1e0 end, 6) as after_low, round(before * case vtype when 'red_light' then 0.25e0 else 1e0 end, 6) as after_mid, round(before * case vtype when 'red_light' then 0.2e0 else 1e0 end, 6) as after_high from c")
def what_if_projection(spark, sf_dir):
    p = planning.project(violations(spark, sf_dir).where("zone_id < 5"), "signal", 3)
    return p.select("vtype", *[F.round(c, 6).alias(c) for c in ("before", "after_low", "after_mid", "after_high")])


@query(f"with {V}, a as (select vtype, count(*) * case vtype when 'red_light' then 0.25e0 else 1e0 end as n from v group by vtype), b as (select vtype, count(*) * case vtype when 'speeding' then 0.35e0 else 1e0 end as n from v group by vtype) select vtype, round(a.n, 6) as n_a, round(b.n, 6) as n_b, round(b.n - a.n, 6) as change from a full join b using (vtype)")
def scenario_compare(spark, sf_dir):
    from roadlark.operators.joins import compare_scenarios

    v = violations(spark, sf_dir)
    out = compare_scenarios(planning.project(v, "signal", 1), planning.project(v, "speed_bump", 1), ["vtype"], "after_mid")
    return out.select("vtype", *[F.round(c, 6).alias(c) for c in ("n_a", "n_b", "change")])


@query(f"with {V}, c as (select zone_id, vtype, t // 86400 as bucket, count(*) as n from v where zone_id in (3, 5) group by all) select zone_id, vtype, bucket, n, lag(n) over w as previous, n - lag(n) over w as change, rank() over (partition by zone_id, bucket order by n desc) as rank from c window w as (partition by zone_id, vtype order by bucket)")
def zone_report(spark, sf_dir):
    v = violations(spark, sf_dir).where("zone_id in (3, 5)").withColumn("bucket", F.expr("t div 86400"))
    counts = win.vs_previous(v.groupBy("zone_id", "vtype", "bucket").agg(F.count("*").alias("n")), ["zone_id", "vtype"], "bucket")
    return win.rank_within(counts, ["zone_id", "bucket"], [F.desc("n")], ties=True).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {S} select anomaly_type, severity_band, count(*) as n, round(avg(severity), 6) as mean_severity, max(session_id) as last_session from s group by all")
def road_condition_report(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("anomaly_type", "severity_band").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("mean_severity"), F.max("session_id").alias("last_session"))


@query(f"with {V} select session_id, count(*) as n_events, count(distinct track_id) as vehicles, round(avg(confidence), 6) as mean_confidence, round(quantile_cont(confidence, 0.5), 6) as median_confidence, min(t) as first_t, max(t) as last_t from v group by all")
def session_report(spark, sf_dir):
    r = planning.session_report(violations(spark, sf_dir))
    return r.select("session_id", "n_events", "vehicles", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("median_confidence", 6).alias("median_confidence"), "first_t", "last_t")


@query(f"""with recursive {DB}, {REC}, c as (select cluster_id, vtype, count(*) as n, {', '.join('2 * count(*) filter (' + e.format(z='v.zone_id') + ') > count(*) as ' + k for k, e in FLAGS.items())} from d join v using (event_id, vtype) group by all), f as (select *, n / sum(n) over (partition by cluster_id) as share from c)
    select cluster_id, vtype, n, round(share, 6) as share, rec_type, round(n / 12e0, 6) as before, round(n / 12e0 * (1 - mid), 6) as after from f join rules using (vtype) where share > least_share and {NEEDS}""")
def planning_report(spark, sf_dir):
    r = planning.planning_report(clustered(spark, sf_dir), violations(spark, sf_dir), zone_flags(spark, 23), 12)
    return r.select("cluster_id", "vtype", "n", *[F.round(c, 6).alias(c) for c in ("share",)], "rec_type", *[F.round(c, 6).alias(c) for c in ("before", "after")])


@query(f"with {S} select zone_id, round(sum(severity * power(2e0, -(10000000 - t) / 2592000e0)) / sum(power(2e0, -(10000000 - t) / 2592000e0)), 6) as condition_score, count(*) as n from s group by all")
def condition_score(spark, sf_dir):
    return agg.condition_score(scored(spark, sf_dir), "zone_id", 10000000.0).select("zone_id", F.round("condition_score", 6).alias("condition_score"), "n")
