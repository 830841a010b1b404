"""Queries over violation events: filters, roll-ups, windows, lists, joins between sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlark.functions import geo, scores
from roadlark.operators import aggregates as agg
from roadlark.operators import filters, joins, lists, metrics
from roadlark.operators import windows as win
from roadlark.plans.fixtures import DAY0, V, metres, violations
from roadlark.plans.registry import query
from roadlark.streaming import live, matching

R6 = "round({}, 6)"
LAT = 17.7  # no fixture event lies further north


def r6(c: str):
    return F.round(c, 6).alias(c)


@query(f"with {V} select event_id, vtype, zone_id, status, round(confidence, 6) as confidence from v where vtype = 'speeding' and status = 'resolved' and t >= 3600 and t < 200000 and confidence >= 0.6")
def violation_list_filter(spark, sf_dir):
    v = filters.apply_filter(violations(spark, sf_dir), kind="speeding", status="resolved", start=3600, end=200000, min_confidence=0.6)
    return v.select("event_id", "vtype", "zone_id", "status", r6("confidence"))


@query(f"with {V} select event_id, vtype, session_id, round(lat, 6) as lat, round(lng, 6) as lng from v where event_id = 77")
def violation_by_id(spark, sf_dir):
    return filters.get_by_id(violations(spark, sf_dir), 77).select("event_id", "vtype", "session_id", r6("lat"), r6("lng"))


@query(f"with {V} select vtype, zone_id, strftime(ts, '%Y-%m-%d') as day, count(*) as n from (select *, ts from v) group by grouping sets ((vtype), (zone_id), (strftime(ts, '%Y-%m-%d')))")
def violation_stats_gsets(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_seconds(F.col("t") + DAY0), "yyyy-MM-dd"))
    return agg.stats(v, ["vtype", "zone_id", "day"]).select("vtype", "zone_id", "day", "n")


@query(f"with {V} select vtype, zone_id, count(*) as n from v group by rollup (vtype, zone_id)")
def violation_rollup(spark, sf_dir):
    return agg.rollup_stats(violations(spark, sf_dir), ["vtype", "zone_id"])


@query(f"with {V} select vtype, status, count(*) as n from v group by cube (vtype, status)")
def violation_cube(spark, sf_dir):
    return agg.cube_stats(violations(spark, sf_dir), ["vtype", "status"])


@query(f"with {V}, h as (select vtype, cast(floor(lat / 0.001e0) as bigint) as cell_lat, cast(floor(lng / 0.001e0) as bigint) as cell_lng, count(*) as n from v where t >= 600 and t < 5000000 group by all) select *, rank() over (partition by vtype order by n desc) as rank from h")
def violation_heatmap(spark, sf_dir):
    v = filters.apply_filter(violations(spark, sf_dir), start=600, end=5000000)
    return win.rank_within(agg.heatmap(v, 0.001, ["vtype"]), ["vtype"], [F.desc("n")], ties=True).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {V} select vtype, (t // 3600) % 24 as hour, count(*) as n from v group by all")
def hour_of_day_heatmap(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("hour", F.expr("t div 3600 % 24"))
    return v.groupBy("vtype", "hour").agg(F.count("*").alias("n"))


@query(f"with {V} select vtype, t // 86400 as bucket, count(*) as n from v group by all")
def trend_buckets(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("bucket", F.expr("t div 86400"))
    return v.groupBy("vtype", "bucket").agg(F.count("*").alias("n"))


@query(f"with {V}, c as (select zone_id, t // 604800 as bucket, count(*) as n from v group by all) select *, lag(n) over (partition by zone_id order by bucket) as previous, n - lag(n) over (partition by zone_id order by bucket) as change from c")
def period_over_period(spark, sf_dir):
    c = violations(spark, sf_dir).withColumn("bucket", F.expr("t div 604800")).groupBy("zone_id", "bucket").agg(F.count("*").alias("n"))
    return win.vs_previous(c, ["zone_id"], "bucket")


@query(f"with {V}, a as (select vtype, count(*) as n from v where t < 100000 group by all), b as (select vtype, count(*) as n from v where t >= 100000 and t < 200000 group by all) select vtype, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b, coalesce(b.n, 0) - coalesce(a.n, 0) as change from a full join b using (vtype)")
def compare_two_periods(spark, sf_dir):
    v = violations(spark, sf_dir)
    part = lambda a, b: filters.apply_filter(v, start=a, end=b).groupBy("vtype").agg(F.count("*").alias("n"))
    return joins.compare_periods(part(0, 100000), part(100000, 200000), ["vtype"])


@query(f"with {V} select zone_id, n, rank() over (order by n desc) as rank from (select zone_id, count(*) as n from v group by all)")
def zone_ranking(spark, sf_dir):
    counts = violations(spark, sf_dir).groupBy("zone_id").agg(F.count("*").alias("n"))
    return win.rank_within(counts, [F.lit(1)], [F.desc("n")], ties=True).withColumn("rank", F.col("rank").cast("long"))


@query(f"with {V}, c as (select zone_id, vtype, count(*) as n from v group by all) select zone_id, vtype, n, r as rank from (select *, row_number() over (partition by zone_id order by n desc, vtype) as r from c) where r <= 3")
def top_types_per_zone(spark, sf_dir):
    return agg.top_k_per(violations(spark, sf_dir), "zone_id", "vtype", 3).select("zone_id", "vtype", "n", F.col("rank").cast("long").alias("rank"))


@query(f"with {V} select zone_id, count(*) as n from v group by zone_id order by n desc, zone_id limit 5")
def top_hotspots(spark, sf_dir):
    return agg.top_k(violations(spark, sf_dir), ["zone_id"], 5)


@query(f"with {V} select vtype, cast(floor(round(confidence / 0.1e0, 9)) as bigint) as bucket, count(*) as n from v group by all")
def confidence_histogram(spark, sf_dir):
    return agg.histogram(violations(spark, sf_dir), "confidence", 0.1, ["vtype"])


@query(f"with {V} select session_id, event_id, round(avg(confidence) over (partition by session_id order by t, event_id rows between 29 preceding and current row), 6) as rolling from v")
def rolling_confidence(spark, sf_dir):
    return win.rolling(violations(spark, sf_dir), "confidence", 30, ["session_id"], ["t", "event_id"], "rolling").select("session_id", "event_id", r6("rolling"))


@query(f"with {V} select a.event_id, b.event_id as event_id_b, a.vtype, round({metres('a', 'b')}, 4) as metres from v a join v b on a.vtype = b.vtype and a.session_id < b.session_id and abs(a.t - b.t) <= 5 and a.event_id // 20 between b.event_id // 20 - 1 and b.event_id // 20 + 1 where {metres('a', 'b')} <= 10")
def cross_session_duplicates(spark, sf_dir):
    pairs = joins.cross_session_dups(violations(spark, sf_dir), most_lat=LAT)
    return pairs.select("event_id", "event_id_b", "vtype", F.round(geo.haversine(F.col("lat"), F.col("lng"), F.col("lat_b"), F.col("lng_b")), 4).alias("metres"))


@query(
    f"with {V}, d as (select a.event_id as x, a.confidence as cx, b.event_id as y, b.confidence as cy from v a join v b on a.vtype = b.vtype and a.session_id < b.session_id and abs(a.t - b.t) <= 5 and a.event_id // 20 between b.event_id // 20 - 1 and b.event_id // 20 + 1 where {metres('a', 'b')} <= 10), l as (select distinct case when cx > cy or (cx = cy and x < y) then y else x end as event_id from d) select status, count(*) as n from (select case when event_id in (select event_id from l) then 'duplicate' else status end as status from v) group by all"
)
def duplicate_status(spark, sf_dir):
    v = violations(spark, sf_dir)
    marked = joins.keep_best(v, joins.cross_session_dups(v, most_lat=LAT))
    return marked.groupBy("status").agg(F.count("*").alias("n"))


@query(f"with {V} select vtype, round(avg(case when status = 'dismissed' then 1e0 else 0e0 end), 6) as rate, count(*) as n, avg(case when status = 'dismissed' then 1e0 else 0e0 end) > 0.2e0 as retrain from v group by vtype")
def dismissal_rate(spark, sf_dir):
    return agg.dismissal_rate(violations(spark, sf_dir)).select("vtype", r6("rate"), "n", "retrain")


@query(f"with {V} select track_id, round(avg(confidence), 6) as mean_confidence, avg(confidence) < 0.6e0 as low_light from v group by track_id")
def low_light_sessions(spark, sf_dir):
    return agg.low_light(violations(spark, sf_dir), key="track_id").select("track_id", r6("mean_confidence"), "low_light")


@query(f"with {V} select zone_id, t // 600 as frame_no, count(distinct track_id) as vehicles, count(distinct track_id) > 8 as dense from v group by all")
def density_warning(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("frame_no", F.expr("t div 600"))
    return agg.frame_density(v, 8, ["zone_id", "frame_no"])


@query(f"with {V} select session_id, count(distinct track_id) as vehicles, count(*) as n from v group by all")
def session_counters(spark, sf_dir):
    return agg.session_counters(violations(spark, sf_dir))


@query(f"with {V} select zone_id, vtype, count(*) as n, array_to_string(list_sort(list(event_id)), ',') as event_ids from v group by all")
def traceable_counts(spark, sf_dir):
    return agg.trace_ids(violations(spark, sf_dir), ["zone_id", "vtype"])


@query(f"with {V} select vtype, round(count(*) / (365 / 30e0), 6) as per_month from v group by all")
def monthly_rate(spark, sf_dir):
    return agg.monthly_rate(violations(spark, sf_dir), 365).select("vtype", r6("per_month"))


@query(f"with {V} select event_id, t from v order by t desc, event_id desc limit 50")
def live_feed(spark, sf_dir):
    return lists.live_feed(violations(spark, sf_dir), 50).select("event_id", "t")


@query(f"with {V}, m as (select max(t) as now from v) select event_id, vtype, t from v, m where t > now - 60 and t <= now")
def catch_up_60s(spark, sf_dir):
    v = violations(spark, sf_dir)
    now = v.agg(F.max("t")).first()[0] or 0
    return lists.catch_up(v, now).select("event_id", "vtype", "t")


@query(f"with {V} select event_id, count(*) over (partition by vtype order by t range between 600 preceding and current row) as recent from v")
def recent_window(spark, sf_dir):
    return win.last_seconds(violations(spark, sf_dir), 600, ["vtype"]).select("event_id", "recent")


@query(f"with {V} select event_id, session_id, count(*) over (partition by session_id order by t, event_id rows unbounded preceding) as seen from v")
def session_timeline(spark, sf_dir):
    return win.timeline(violations(spark, sf_dir)).select("event_id", "session_id", "seen")


@query(f"with {V}, h as (select track_id, t, event_id, status, lag(status) over (partition by track_id order by t, event_id) as before from v) select event_id, before, status from h where before is not null and before <> status and before || '>' || status not in ('flagged>reviewed', 'flagged>duplicate', 'flagged>dropped', 'reviewed>actioned', 'reviewed>dismissed', 'actioned>resolved')")
def status_lifecycle_check(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("order", F.struct("t", "event_id"))
    return win.check_transitions(v, "track_id", "order").select("event_id", "before", "status")


@query(f"with {V}, g as (select track_id, t, lag(t) over (partition by track_id order by t, event_id) as gap_start from v) select track_id, gap_start, t - gap_start as gap_s from g where t - gap_start > 40000")
def pipeline_gaps(spark, sf_dir):
    return win.pipeline_gaps(violations(spark, sf_dir), 40000, ["track_id"]).select("track_id", "gap_start", "gap_s")


@query(f"with {V}, g as (select track_id, t, event_id, case when t - lag(t) over (partition by track_id order by t, event_id) > 20000 then 1 else 0 end as n from v), s as (select track_id, t, sum(n) over (partition by track_id order by t, event_id) as segment from g) select track_id, cast(segment as bigint) as segment, min(t) as first_t, max(t) as last_t, count(*) as n from s group by all")
def track_lost_sessions(spark, sf_dir):
    s = win.split_on_gap(violations(spark, sf_dir), ["track_id"], 20000)
    return s.groupBy("track_id", "segment").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


@query(f"with {V} select vtype, quantile_cont(confidence, 0.95) as p95 from v group by vtype")
def p95_latency(spark, sf_dir):
    return agg.percentile(violations(spark, sf_dir), "confidence", 0.95, ["vtype"])


@query(f"with {V} select count(*) as n, round(corr(x, y), 6) as rho from (select rank() over (order by confidence) + (count(*) over (partition by confidence) - 1) / 2e0 as x, rank() over (order by t) + (count(*) over (partition by t) - 1) / 2e0 as y from v)")
def spearman_severity(spark, sf_dir):
    return metrics.spearman(violations(spark, sf_dir), "confidence", "t").select("n", r6("rho"))


@query(f"with {V} select event_id, case when confidence < 0.6 then 'red' when confidence < 0.8 then 'yellow' else 'green' end as colour, 'vtype ' || vtype || ', zone ' || zone_id as description, 'violations/' || strftime(ts, '%Y/%m/%d') || '/' || event_id || '.jpg' as path, concat_ws(',', case when confidence < 0.6 then 'low_light' end, case when session_id = 1 then 'second_session' end) as tags from v")
def event_labels(spark, sf_dir):
    v = violations(spark, sf_dir)
    colour = F.when(F.col("confidence") < 0.6, "red").when(F.col("confidence") < 0.8, "yellow").otherwise("green")
    text = scores.describe(F.concat(F.lit("vtype "), F.col("vtype")), F.concat(F.lit("zone "), F.col("zone_id")))
    tags = F.array_join(scores.quality_tags(low_light=F.col("confidence") < 0.6, second_session=F.col("session_id") == 1), ",")
    # the day is formatted from whole seconds, whatever the session's time zone
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.expr("cast(t div 86400 as int)"))
    return v.select("event_id", colour.alias("colour"), text.alias("description"), scores.snapshot_path("violations", day, F.col("event_id")).alias("path"), tags.alias("tags"))


@query(f"with {V} select event_id, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || session_id || ',' || zone_id || ']}},\"properties\":{{\"vtype\":\"' || vtype || '\"}}}}' as geojson from v")
def geojson_export(spark, sf_dir):
    v = violations(spark, sf_dir)
    return v.select("event_id", geo.point_geojson(F.col("zone_id"), F.col("session_id"), F.struct("vtype")).alias("geojson"))


@query(f"""with {V}, z as (select zone_id, zone_id % 5 as x, zone_id % 7 as y, string_agg('[' || session_id || '.0,' || event_id || '.0]', ',' order by t, event_id) as line, count(*) as n from v group by zone_id)
    select zone_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || line || ']}},"properties":{{"n":' || n || '}}}}' as line,
    '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || x || '.0,' || y || '.0],[' || x + 3 || '.0,' || y || '.0],[' || x + 3 || '.0,' || y + 2 || '.0],[' || x || '.0,' || y + 2 || '.0],[' || x || '.0,' || y || '.0]]]}},"properties":{{"n":' || n || '}}}}' as ring, true as returns from z where n >= 2""")
def geojson_shapes(spark, sf_dir):
    """The line of a zone's events and a rectangle each, as text and back."""
    from roadlark.functions.geo import from_line_geojson, from_polygon_geojson, line_geojson, polygon_geojson

    place = lambda x, y: F.struct(x.cast("double").alias("lng"), y.cast("double").alias("lat"))
    line = F.transform(F.sort_array(F.collect_list(F.struct("t", "event_id", "session_id"))), lambda e: place(e["session_id"], e["event_id"]))
    z = violations(spark, sf_dir).groupBy("zone_id").agg(line.alias("path"), F.count("*").alias("n"))
    x, y = F.col("zone_id") % 5, F.col("zone_id") % 7
    z = z.withColumn("area", F.array(place(x, y), place(x + 3, y), place(x + 3, y + 2), place(x, y + 2)))
    z = z.select("*", line_geojson(F.col("path"), F.struct("n")).alias("line"), polygon_geojson(F.col("area"), F.struct("n")).alias("ring")).where("n >= 2")
    return z.select("zone_id", "line", "ring", ((from_line_geojson(F.col("line")) == F.col("path")) & (from_polygon_geojson(F.col("ring")) == F.col("area"))).alias("returns"))


@query(f"with {V}, z as (select c_custkey as user_id, c_nationkey % 23 as zone_id from customer) select event_id, zone_id from v where zone_id in (select zone_id from z where user_id = 57)")
def rbac_zone_scope(spark, sf_dir):
    z = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as user_id", "c_nationkey % 23 as zone_id")
    return filters.zone_scoped(violations(spark, sf_dir), z, 57).select("event_id", "zone_id")


@query("with u as (select c_custkey as user_id, case c_custkey % 5 when 0 then 'OFFICER' when 1 then 'OPERATOR' when 2 then 'PLANNER' when 3 then 'MAINTENANCE' else 'ADMIN' end as role from customer) select user_id, role, role in ('OFFICER', 'ADMIN') as allowed from u")
def rbac_permission(spark, sf_dir):
    u = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey as user_id", "case c_custkey % 5 when 0 then 'OFFICER' when 1 then 'OPERATOR' when 2 then 'PLANNER' when 3 then 'MAINTENANCE' else 'ADMIN' end as role")
    return filters.has_permission(u.withColumn("action", F.lit("dismiss_violations"))).select("user_id", "role", "allowed")


@query(f"with {V}, m as (select max(t) as now from v) select vtype, count(*) as n from v, m where t >= now - 86400 * 2 group by all")
def retention(spark, sf_dir):
    v = violations(spark, sf_dir)
    now = v.agg(F.max("t")).first()[0] or 0
    return filters.retain(v, now, days=2, anonymise=("track_id",)).groupBy("vtype").agg(F.count("*").alias("n"))


@query(f"with {V}, r as (select o_custkey % 23 as zone_id, count(*) as orders from orders group by all) select event_id, zone_id, orders from v left join r using (zone_id)")
def event_enrichment(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.expr("o_custkey % 23").alias("zone_id")).agg(F.count("*").alias("orders"))
    return joins.enrich(violations(spark, sf_dir), (r, "zone_id")).select("event_id", "zone_id", "orders")


@query(f"with {V}, w as (select zone_id, min(t) + 1000 as s, min(t) + 90000 as e from v group by all) select event_id, exists (select 1 from w where w.zone_id = v.zone_id and v.t between s and e) as degraded from v")
def degraded_intervals(spark, sf_dir):
    v = violations(spark, sf_dir)
    w = v.groupBy("zone_id").agg((F.min("t") + 1000).alias("start"), (F.min("t") + 90000).alias("end"))
    return joins.tag_intervals(v, w, ["zone_id"], "degraded").select("event_id", "degraded")


@query(f"with {V} select event_id, zone_id from v where lat > 17.50501 and lat < 17.56501 and lng > 78.58501 and lng < 78.66501")
def scenario_affected_events(spark, sf_dir):
    ring = [(78.58501, 17.50501), (78.66501, 17.50501), (78.66501, 17.56501), (78.58501, 17.56501)]
    s = spark.createDataFrame([(1, ring)], "scenario_id long, polygon array<struct<lng:double,lat:double>>")
    return joins.affected_events(violations(spark, sf_dir), s).select("event_id", "zone_id")


@query(f"with {V} select zone_id, t as valid_from, lead(t) over (partition by zone_id order by t, event_id) as valid_to from v")
def zone_version_intervals(spark, sf_dir):
    return win.zone_versions(violations(spark, sf_dir), tie="event_id").select("zone_id", "valid_from", "valid_to")


@query(f"with {V}, x as (select distinct b.event_id from v a join v b on a.vtype = b.vtype and a.session_id <> b.session_id and abs(a.t - b.t) <= 5 and abs(a.lat - b.lat) < 0.001 and {metres('a', 'b')} <= 10e0 and (a.confidence > b.confidence or a.confidence = b.confidence and a.event_id < b.event_id)) select event_id, case when event_id in (select event_id from x) then 'duplicate' else status end as status from v")
def cross_session_replay(spark, sf_dir):
    """The stream's verdict on every event, once all are through."""
    v = violations(spark, sf_dir).drop("ts")
    return matching.replayed(spark, {"events": v}, lambda events: matching.cross_session_stream(events, most_lat=17.7)).select("event_id", "status")


@query(f"with {V}, s as (select zone_id, t, event_id as state from v where event_id % 7 = 0), x as (select zone_id, event_id, t from v where event_id % 7 = 3) select event_id, zone_id, (select max_by(state, (t, state)) from s where s.zone_id = x.zone_id and s.t <= x.t) as state from x")
def signal_replay(spark, sf_dir):
    """The state of a zone at its crossings, from two streams."""
    v = violations(spark, sf_dir)
    s = v.where("event_id % 7 = 0").select("zone_id", "t", F.col("event_id").alias("state"))
    x = v.where("event_id % 7 = 3").select("event_id", "zone_id", "t")
    build = lambda crossings, signals: matching.asof_stream(crossings, signals, "zone_id")
    return matching.replayed(spark, {"crossings": x, "signals": s}, build, keys=["zone_id"]).select("event_id", "zone_id", "state")


def _since(c: str):
    """A timestamp of a replay as its seconds."""
    return (F.unix_seconds(c) - matching.LATER).alias(c)


@query(f"with {V} select t // 60 * 60 as start, vtype, count(*) as n from v group by all")
def counters_replay(spark, sf_dir):
    """Events a minute and type, each minute told once it is over."""
    v = violations(spark, sf_dir).select("t", "vtype")
    return matching.replayed(spark, {"events": v}, lambda events: live.live_counters(events), told_by=None).select(_since("start"), "vtype", "n")


@query(f"with {V}, w as (select t // 10 * 10 - unnest([0, 10, 20]) as start, session_id, confidence from v) select start, session_id, round(avg(confidence), 6) as mean_confidence from w group by all")
def sliding_replay(spark, sf_dir):
    v = violations(spark, sf_dir).select("t", "session_id", "confidence")
    found = matching.replayed(spark, {"events": v}, lambda events: live.sliding_confidence(events), told_by=None)
    return found.select(_since("start"), "session_id", r6("mean_confidence"))


@query(f"with {V}, g as (select track_id, t, case when t - lag(t) over (partition by track_id order by t) <= 5 then 0 else 1 end as new from v), s as (select track_id, t, sum(new) over (partition by track_id order by t) as k from g) select track_id, min(t) as start, max(t) + 5 as lost_at, count(*) as n from s group by track_id, k")
def lost_track_replay(spark, sf_dir):
    """A track's stays, each told when it has been silent for five seconds."""
    v = violations(spark, sf_dir).select("t", "track_id")
    return matching.replayed(spark, {"points": v}, lambda points: live.track_sessions(points), told_by=None).select("track_id", _since("start"), _since("lost_at"), "n")


@query(f"with {V} select event_id, case when event_id % 40 > 20 then 'violation' when event_id % 40 >= 10 then 'warning' else 'ok' end as altitude_status from v where event_id % 40 >= 10 or event_id % 9 = 0")
def telemetry_replay(spark, sf_dir):
    v = violations(spark, sf_dir).selectExpr("event_id", "t", "cast(100 + event_id % 40 as double) as alt", "if(event_id % 9 = 0, 0, 3) as gps_fix")
    return matching.replayed(spark, {"telemetry": v}, lambda telemetry: live.telemetry_alerts(telemetry)).select("event_id", "altitude_status")
