"""Queries over single scores, geometry, visibility rules, work lists and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.functions import geo, kinematics, scores
from roadlark.operators import aggregates, clustering, filters, joins, lifecycle, lists, metrics
from roadlark.operators import windows as win
from roadlark.plans.fixtures import A, P, V, anomalies, metres, track_points, violations
from roadlark.plans.registry import query
from roadlark.plans.roads import S, scored
from roadlark.sources import readers

CLAMP = "greatest(0e0, least(1e0, {}))"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"with {A} select det_id, session_id, count(*) as n, round(max({CLAMP.format('0.6e0 * ' + CLAMP.format('area / 0.5e0') + ' + 0.4e0 * ' + CLAMP.format('raw'))}), 6) as severity from a where anomaly_type = 'pothole' group by all")
def pothole_severity(spark, sf_dir):
    a = filters.apply_filter(anomalies(spark, sf_dir), kind="pothole", kind_column="anomaly_type")
    return a.groupBy("det_id", "session_id").agg(F.count("*").alias("n"), r6(F.max(scores.pothole_severity(F.col("area"), F.col("raw"), 0.5)), "severity"))


@query(f"with {A} select det_id, session_id, count(*) as n, round(max({CLAMP.format('case when area > 0 then raw * 0.2e0 / area else 0e0 end * case when session_id = 0 then 1e0 else 0.6e0 end')}), 6) as severity from a where anomaly_type = 'crack' group by all")
def crack_severity(spark, sf_dir):
    a = filters.apply_filter(anomalies(spark, sf_dir), kind="crack", kind_column="anomaly_type")
    return a.groupBy("det_id", "session_id").agg(F.count("*").alias("n"), r6(F.max(scores.crack_severity(F.col("raw") * 0.2, F.col("area"), F.col("session_id") == 0)), "severity"))


@query(f"with {A} select det_id, session_id, count(*) as n, round(max({CLAMP.format('area / 0.6e0 * 0.7e0 + 0.1e0 * least(3, session_id)')}), 6) as severity from a where anomaly_type = 'waterlogging' group by all")
def waterlogging_severity(spark, sf_dir):
    a = filters.apply_filter(anomalies(spark, sf_dir), kind="waterlogging", kind_column="anomaly_type")
    return a.groupBy("det_id", "session_id").agg(F.count("*").alias("n"), r6(F.max(scores.waterlogging_severity(F.col("area"), F.lit(0.6), F.col("session_id"))), "severity"))


@query(f"with {A} select det_id, session_id, count(*) as n, round(max({CLAMP.format('0.8e0 * ' + CLAMP.format('area / 0.35e0') + ' + 0.1e0 * least(2, session_id)')}), 6) as severity from a where anomaly_type = 'debris' group by all")
def debris_severity(spark, sf_dir):
    a = filters.apply_filter(anomalies(spark, sf_dir), kind="debris", kind_column="anomaly_type")
    return a.groupBy("det_id", "session_id").agg(F.count("*").alias("n"), r6(F.max(scores.debris_severity(F.col("area"), F.lit(0.35), F.col("session_id"))), "severity"))


@query(f"with {S} select det_id, session_id, t, severity_band, zone_id from s where anomaly_type = 'crack' and severity_band = 'high' and zone_id = 5 and t >= 600")
def anomaly_list_filter(spark, sf_dir):
    a = filters.apply_filter(scored(spark, sf_dir), kind="crack", kind_column="anomaly_type", severity="high", zone=5, start=600)
    return a.select("det_id", "session_id", "t", "severity_band", "zone_id")


BOX = [(78.48, 17.38), (78.4805, 17.38), (78.4805, 17.3806), (78.48, 17.3806)]


def box(corners=BOX):
    return F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in corners])


_dy, _dx = "greatest(0e0, 17.38e0 - lat, lat - 17.3806e0) * 111195.0802335329e0", "greatest(0e0, 78.48e0 - lng, lng - 78.4805e0) * cos(radians(lat)) * 111195.0802335329e0"


@query(f"with {V} select event_id, sqrt(power({_dy}, 2) + power({_dx}, 2)) <= 50e0 as inside from v")
def zone_buffer(spark, sf_dir):
    """A rectangle and 50 m around it, by edge distance; the twin measures the gap on either axis."""
    return violations(spark, sf_dir).select("event_id", F.coalesce(geo.within_buffer(F.col("lat"), F.col("lng"), box(), 50.0), F.lit(False)).alias("inside"))


@query(f'with {P}, s as (select track_id, k, lat, lng, lag(lat) over w as plat, lag(lng) over w as plng from p window w as (partition by track_id order by k)) select track_id, k from s where sign(plat - (17.405e0 + script_lat)) * sign(lat - (17.405e0 + script_lat)) < 0'.replace("script_lat", "(track_id % 10) * 0.01e0"))
def line_crossings(spark, sf_dir):
    """Steps over a line at each script's latitude that is longer than any road."""
    p = track_points(spark, sf_dir)
    w = Window.partitionBy("track_id").orderBy("k")
    s = p.withColumns({"plat": F.lag("lat").over(w), "plng": F.lag("lng").over(w), "at": 17.405 + F.col("track_id") % 10 * 0.01})
    over = geo.crosses(F.col("plng"), F.col("plat"), F.col("lng"), F.col("lat"), F.lit(70.0), F.col("at"), F.lit(90.0), F.col("at"))
    return s.where(over).select("track_id", "k")


@query("select n_nationkey as zone_id, round(78e0 + n_nationkey * 0.1e0 + 0.02e0, 6) as lng, round(17e0 + 0.015e0, 6) as lat from nation")
def zone_centroids(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", (78.0 + F.col("n_nationkey") * 0.1).alias("x"))
    corner = lambda dx, y: F.struct((F.col("x") + dx).alias("lng"), F.lit(y).alias("lat"))
    c = geo.centroid(F.array(corner(0.0, 17.0), corner(0.04, 17.0), corner(0.04, 17.03), corner(0.0, 17.03)))
    return n.select(F.col("n_nationkey").alias("zone_id"), r6(c["lng"], "lng"), r6(c["lat"], "lat"))


@query(f"with {P} select track_id, k, case when k % 50 > 30 then 'red' when k % 50 > 0 then 'yellow' else 'green' end as marker from p")
def marker_status(spark, sf_dir):
    return track_points(spark, sf_dir).select("track_id", "k", scores.marker_status(F.col("k") % 50, F.lit(30)).alias("marker"))


@query(f"with {V} select event_id, case vtype when 'speeding' then 'red' when 'lane' then 'orange' else 'grey' end as colour from v")
def event_colours(spark, sf_dir):
    return violations(spark, sf_dir).select("event_id", scores.colour(F.col("vtype"), {"speeding": "red", "lane": "orange"}).alias("colour"))


@query(f"with {V}, d as (select zone_id, t // 86400 as day, count(*) as n from v group by all), l as (select *, lag(n) over (partition by zone_id order by day) as before from d) select zone_id, day, n, case when before <> 0 then round((n - before) * 100e0 / before, 6) end as change_percent from l")
def daily_percent_change(spark, sf_dir):
    d = violations(spark, sf_dir).groupBy("zone_id", F.expr("t div 86400").alias("day")).agg(F.count("*").alias("n"))
    v = win.vs_previous(d, ["zone_id"], "day")
    return v.select("zone_id", "day", "n", r6(scores.percent_change(F.col("previous"), F.col("n")), "change_percent"))


@query(f"with {V} select event_id, (event_id % 60) >= 15 and (event_id % 100) / 100e0 >= 0.2e0 as usable from v")
def shadow_check(spark, sf_dir):
    return violations(spark, sf_dir).select("event_id", scores.shadow_ok(F.col("event_id") % 60, F.col("event_id") % 100 / 100.0).alias("usable"))


@query("with d as (select l_orderkey * 10 + l_linenumber as det_id, case when l_partkey % 4 = 3 then 'debris' else 'pothole' end as anomaly_type, l_suppkey % 23 as zone_id, case when l_partkey % 8 = 3 then 'vehicle' end as mask_class from lineitem) select anomaly_type, zone_id, count(*) as n from d where anomaly_type <> 'debris' or (mask_class is null and zone_id not in (3, 4)) group by all")
def false_debris_dropped(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("case when l_partkey % 4 = 3 then 'debris' else 'pothole' end as anomaly_type", "l_suppkey % 23 as zone_id", "case when l_partkey % 8 = 3 then 'vehicle' end as mask_class")
    works = spark.createDataFrame([(3,), (4,)], "zone_id long")
    return filters.drop_false_debris(d, works, ["zone_id"]).groupBy("anomaly_type", "zone_id").agg(F.count("*").alias("n"))


@query(f"with {P} select track_id, k, passengers from p where helmet_conf > 0.8e0 or passengers >= 3")
def helmet_or_overload(spark, sf_dir):
    p = track_points(spark, sf_dir).withColumn("no_helmet_confidence", F.col("helmet_conf"))
    return filters.helmet_overload(p).select("track_id", "k", "passengers")


@query(f"with {S}, n as (select anomaly_type, zone_id, count(distinct session_id) as n_sessions from s group by all) select *, case when n_sessions >= 2 then 'promoted' else 'low_confidence' end as visibility from n")
def promoted_anomalies(spark, sf_dir):
    found = scored(spark, sf_dir).groupBy("anomaly_type", "zone_id").agg(F.count_distinct("session_id").alias("n_sessions"))
    return filters.promote(found)


@query(f"with {V}, f as (select session_id, t // 60 as frame_no, count(*) * 40 + min(event_id) % 90 as vehicles from v group by all) select event_id, case when vehicles > 80 then 0.55e0 else 0.5e0 end as threshold from v join f on v.session_id = f.session_id and v.t // 60 = f.frame_no")
def crowded_thresholds(spark, sf_dir):
    v = violations(spark, sf_dir).withColumn("frame_no", F.expr("t div 60"))
    frames = v.groupBy("session_id", "frame_no").agg((F.count("*") * 40 + F.min("event_id") % 90).alias("vehicles"))
    return filters.density_threshold(v, frames).select("event_id", "threshold")


@query(f"with {V}, c as (select zone_id, vtype, count(*) as n_events from v group by all) select * from c where n_events >= 4")
def large_groups(spark, sf_dir):
    return filters.min_events(violations(spark, sf_dir).groupBy("zone_id", "vtype").agg(F.count("*").alias("n_events")), 4)


@query(f"with {V} select event_id, hour(ts) as hour from v where hour(ts) between 7 and 9")
def morning_events(spark, sf_dir):
    return filters.hour_between(violations(spark, sf_dir), 7, 9).select("event_id", F.hour("ts").cast("long").alias("hour"))


@query(f"with {V} select event_id, array_to_string(list_filter([case when confidence < 0.6e0 then 'low_light' end, case when event_id % 3 = 0 then 'weather' end], lambda x: x is not null), ',') as tags from v")
def quality_tags(spark, sf_dir):
    v = filters.tag_quality(violations(spark, sf_dir), low_light=F.col("confidence") < 0.6, weather=F.col("event_id") % 3 == 0)
    return v.select("event_id", F.array_join("tags", ",").alias("tags"))


@query(f"with {A}, k as (select distinct anomaly_type, zone_id from a where session_id = 0) select det_id, a.session_id, case when k.zone_id is null then 'insert' else 'update' end as action, count(*) as n from a left join k on a.anomaly_type = k.anomaly_type and a.zone_id = k.zone_id where a.session_id > 0 group by all")
def new_or_known_anomalies(spark, sf_dir):
    a = anomalies(spark, sf_dir)
    out = joins.split_new_existing(a.where("session_id > 0"), a.where("session_id = 0"), ["anomaly_type", "zone_id"])
    return out.groupBy("det_id", "session_id", "action").agg(F.count("*").alias("n"))


@query("with p as (select l_orderkey * 10 + l_linenumber as pred_id, l_orderkey as frame_no, l_linenumber as i, max(l_discount) as confidence from lineitem group by all), m as (select pred_id, frame_no * 10 + i - i % 2 as truth_id, case when i % 2 = 0 then 1e0 else 8e0 / 12e0 end as iou, confidence from p), b as (select *, row_number() over (partition by truth_id order by confidence desc, pred_id) as r from m) select pred_id, count(*) as n, max(case when r = 1 then truth_id end) as truth_id, max(case when r = 1 then round(iou, 6) end) as iou from b group by pred_id")
def ground_truth_matches(spark, sf_dir):
    """Boxes of ten metres: truths at even places 40 m apart, predictions on them or two metres aside."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = max(1, -(-rows.count() // joins.MATCH_ROWS))
    # frames are dealt once, and all of a frame's steps stay in its task
    li = rows.selectExpr("l_orderkey as frame_no", "l_linenumber as i", "l_orderkey * 10 + l_linenumber as pred_id", "l_discount").repartition(parts, "frame_no")
    li = li.groupBy("frame_no", "i", "pred_id").agg(F.max("l_discount").cast("double").alias("confidence"))
    at = lambda x: F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 10.0).alias("x2"), F.lit(10.0).alias("y2"))
    low = (F.col("i") - F.col("i") % 2) * 20.0
    pred = li.select("pred_id", "frame_no", "confidence", at(low + F.when(F.col("i") % 2 == 1, 2.0).otherwise(0.0)).alias("box"))
    truth = li.select("frame_no", (F.col("frame_no") * 10 + F.col("i") - F.col("i") % 2).alias("truth_id"), at(low).alias("box")).distinct()
    found = joins.match_ground_truth(pred, truth, ["frame_no"], parts=parts)
    return found.groupBy("pred_id").agg(F.count("*").alias("n"), F.max("truth_id").alias("truth_id"), F.max(F.round("iou", 6)).alias("iou"))


@query("select distinct l_orderkey as frame_no, l_linenumber as det_id, l_linenumber * 2 as crop_id from lineitem where l_linenumber % 3 = 0")
def riders_attached(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey as frame_no", "cast(l_linenumber as long) as det_id").distinct()
    crops = li.where("det_id % 3 = 0").selectExpr("frame_no", "det_id as parent_det_id", "det_id * 2 as crop_id")
    return joins.attach_rider(li, crops).select("frame_no", "det_id", "crop_id")


@query(f"with {S} select zone_id, case when zone_id % 3 = 0 then 'arterial' when zone_id < 20 then 'local' end as road_class, zone_id < 20 and zone_id % 4 = 0 as near_school, count(*) as n from (select s.* exclude (zone_id), s.zone_id from s) group by all".replace("case when zone_id % 3", "case when zone_id >= 20 then null when zone_id % 3"))
def road_classes(spark, sf_dir):
    zones = spark.range(20).selectExpr("id as zone_id", "case when id % 3 = 0 then 'arterial' else 'local' end as road_class", "id % 4 = 0 as near_school")
    out = joins.attach_road_class(scored(spark, sf_dir), zones)
    return out.groupBy("zone_id", "road_class", "near_school").agg(F.count("*").alias("n"))


@query(f"with {S}, i as (select anomaly_type, zone_id, round(max(severity), 6) as severity, min(det_id) as anomaly_id from s group by all), w as (select *, case when anomaly_id % 2 = 0 then 'work_order_issued' else 'open' end as status from i) select anomaly_id, anomaly_type, zone_id, severity from w where status = 'work_order_issued'")
def open_work_orders(spark, sf_dir):
    i = scored(spark, sf_dir).groupBy("anomaly_type", "zone_id").agg(F.round(F.max("severity"), 6).alias("severity"), F.min("det_id").alias("anomaly_id"))
    i = i.withColumn("status", F.when(F.col("anomaly_id") % 2 == 0, "work_order_issued").otherwise("open"))
    return lists.work_orders(i).select("anomaly_id", "anomaly_type", "zone_id", "severity")


@query(f"with {V} select event_id, t from v order by t desc, event_id desc limit 25")
def recent_event_ids(spark, sf_dir):
    return lists.recent_ids(violations(spark, sf_dir), 25)


@query("with a as (select o_orderkey as junction_id, o_custkey as ts, case when o_orderkey % 2 = 0 then 'RED' end as state from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as junction_id, o_custkey as ts, 'GREEN' as state from orders) select junction_id, ts, coalesce(a.state, b.state) as state from a full join b using (junction_id, ts)")
def signal_fallback(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as junction_id", "o_custkey as ts")
    api = o.where("junction_id % 3 <> 0").withColumn("state", F.when(F.col("junction_id") % 2 == 0, "RED"))
    return readers.signal_state(api, o.withColumn("state", F.lit("GREEN")))


@query(f"with {V} select event_id, t from v where session_id = 1")
def session_playback(spark, sf_dir):
    return readers.playback(violations(spark, sf_dir), 1).select("event_id", "t")


@query(f"with {V}, s as (select zone_id, count(*) filter (event_id % 3 = 0) as tp, count(*) filter (event_id % 3 = 1) as fp, count(*) filter (event_id % 3 = 2) as fn from v group by all) select zone_id, round(2e0 * tp / (2 * tp + fp + fn), 6) as f1 from s where 2e0 * tp / (2 * tp + fp + fn) < 0.65e0")
def weak_zones(spark, sf_dir):
    v = violations(spark, sf_dir)
    found = metrics.prf(v, F.col("event_id") % 3 != 1, F.col("event_id") % 3 != 2, ["zone_id"])
    return metrics.low_f1(found).select("zone_id", r6(F.col("f1"), "f1"))


@query(f"with {P} select track_id, k, last_value(case when k % 10 = 0 then speed end ignore nulls) over (partition by track_id order by t rows between unbounded preceding and current row) as speed_at from p")
def speed_at_tenth_frame(spark, sf_dir):
    return win.position_at(track_points(spark, sf_dir), F.col("k") % 10 == 0, "speed", ["track_id"]).select("track_id", "k", "speed_at")


@query(f"with {A}, f as (select det_id, session_id, anomaly_type, lat, lng from a where zone_id = 7), s as (select det_id, min(session_id) as session_id, min(anomaly_type) as anomaly_type from f group by det_id) select anomaly_type, count(*) as n, count(distinct session_id) as sessions from s group by all")
def zone_inspection(spark, sf_dir):
    one = filters.apply_filter(anomalies(spark, sf_dir), zone=7).groupBy("det_id").agg(F.min("session_id").alias("session_id"), F.min("anomaly_type").alias("anomaly_type"))
    return one.groupBy("anomaly_type").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))


AN = f"""{A}, v as (select min(part * 10 + session_id) as event_id, anomaly_type as vtype, lat, lng from a group by anomaly_type, lat, lng),
n as (select a.event_id as a, b.event_id as b, a.vtype from v a join v b on a.vtype = b.vtype and abs(a.lat - b.lat) < 0.003e0 and abs(a.lng - b.lng) < 0.003e0 where {metres('a', 'b')} <= 250),
core as (select a, vtype from n group by all having count(*) >= 6), e as (select n.a, n.b from n where a in (select a from core) and b in (select a from core)),
r(node, label) as (select a, a from core union select e.b, r.label from r join e on e.a = r.node), l as (select node, min(label) as cluster_id from r group by node)"""


@query(f"with recursive {AN} select cluster_id, vtype as anomaly_type, count(*) as n from core join l on l.node = core.a group by all")
def anomaly_clusters(spark, sf_dir):
    """Road anomalies clustered by place: sizes of the clusters' cores."""
    spots = anomalies(spark, sf_dir).groupBy("anomaly_type", "lat", "lng").agg(F.min(F.expr("part * 10 + session_id")).alias("spot_id"))
    found = clustering.dbscan(spots, metres=250.0, least=6, kind="anomaly_type", key="spot_id").where("role = 'core'")
    return found.groupBy("cluster_id", "anomaly_type").agg(F.count("*").alias("n"))


#: Three decisions a recommendation: the first two follow each other, the third may come too late.
DECIDED = ("reviewed", "accepted", "rejected", "pending")


@query("""with recursive o as (select o_orderkey as id, unnest([0, 1, 2]) as t from orders), c as (select id, t, case (id + t * (id % 5)) % 4 when 0 then 'reviewed' when 1 then 'accepted' when 2 then 'rejected' else 'pending' end as st from o),
    w as (select o_orderkey as id, -1 as t, 'pending' as status, 0 as n, 0 as no from orders union all
      select id, t, case when fine then st else status end, n + fine::int, no + (not fine and st <> status)::int from (select w.id, c.t, c.st, w.status, w.n, w.no, w.status <> c.st and (w.status = 'pending' and c.st <> 'pending' or w.status = 'reviewed' and c.st in ('accepted', 'rejected')) as fine from w join c on c.id = w.id and c.t = w.t + 1))
    select id as recommendation_id, status, n as n_applied, no as n_refused from w where t = 2""")
def recommendation_decisions(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("recommendation_id"))
    wanted = F.element_at(F.array(*[F.lit(s) for s in DECIDED]), ((F.col("recommendation_id") + F.col("t") * (F.col("recommendation_id") % 5)) % 4 + 1).cast("int"))
    changes = o.withColumn("t", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("status", wanted)
    return lifecycle.decide(o.withColumn("status", F.lit("pending")), changes)


@query(f"with {P}, q as (select track_id, k, (lng - lag(lng) over w) * cos(radians(lat)) as dx, lat - lag(lat) over w as dy from p window w as (partition by track_id order by t)) select track_id, k, round((degrees(atan2(dx, dy)) + 360) % 360, 3) % 360 as heading from q where dx is not null and (abs(dx) > 1e-9 or abs(dy) > 1e-9)")
def step_headings(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("t")
    dx, dy = (F.col("lng") - F.lag("lng").over(w)) * F.cos(F.radians("lat")), F.col("lat") - F.lag("lat").over(w)
    p = track_points(spark, sf_dir).withColumns({"dx": dx, "dy": dy}).where("dx is not null and (abs(dx) > 1e-9 or abs(dy) > 1e-9)")
    return p.select("track_id", "k", (F.round(kinematics.heading_deg(F.col("dx"), F.col("dy")), 3) % 360).alias("heading"))


@query(f"with {V} select event_id, round((confidence * 3 + (event_id % 7) / 7e0 * 2 + (zone_id % 5) / 5e0) / 6, 6) as score from v")
def weighted_confidence(spark, sf_dir):
    factors = F.array(F.col("confidence"), F.expr("event_id % 7 / 7D"), F.expr("zone_id % 5 / 5D"))
    return violations(spark, sf_dir).select("event_id", r6(scores.confidence(factors, F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))), "score"))


@query(f"with {P} select track_id, k from p where k % 40 > 0 and k % 40 + 12 < 48 and k % 9 > 0 and k % 9 + 20 < 28")
def whole_boxes(spark, sf_dir):
    box = F.struct(*[F.expr(f"cast({e} as double)").alias(c) for c, e in (("x1", "k % 40"), ("y1", "k % 9"), ("x2", "k % 40 + 12"), ("y2", "k % 9 + 20"))])
    return filters.full_bbox(track_points(spark, sf_dir).withColumn("box", box), 48.0, 28.0).select("track_id", "k")


@query(f"with {V} select zone_id, count(*) as n from v where session_id = 1 group by all")
def session_zone_counts(spark, sf_dir):
    return aggregates.zone_counts(violations(spark, sf_dir), 1)


@query(f"""with {A}, m as (select det_id, min(session_id) as session_id, min(part) as part, max(raw) as raw from a group by det_id), f as (select det_id, session_id, part // 4 as frame_no, part % 4 = 0 as pothole, 0.5e0 + raw / 4 as c from m where part % 2 = 0), w as (select distinct session_id, frame_no, true as wet from f where not pothole)
    select det_id, pothole and frame_no % 3 < 2 and coalesce(wet, false) as waterlogged, round(case when pothole and frame_no % 3 < 2 and coalesce(wet, false) then c * 0.5e0 else c end, 6) as confidence from f left join w using (session_id, frame_no)""")
def wet_potholes(spark, sf_dir):
    """A pothole and standing water in one frame: over it, beside it with a quarter in common, or away from it."""
    m = anomalies(spark, sf_dir).groupBy("det_id").agg(F.min("session_id").alias("session_id"), F.min("part").alias("part"), F.max("raw").alias("raw")).where("part % 2 = 0")
    m = m.selectExpr("det_id", "session_id", "part div 4 as frame_no", "if(part % 4 = 0, 'pothole', 'waterlogging') as anomaly_type", "cast(0.5D + raw / 4 as double) as confidence")
    x = F.when(F.col("anomaly_type") == "pothole", 0.0).otherwise(F.col("frame_no") % 3 * 6.0)
    box = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 10.0).alias("x2"), F.lit(10.0).alias("y2"))
    return joins.wet_pothole(m.withColumn("box", box)).select("det_id", "waterlogged", r6(F.col("confidence"), "confidence"))
