"""Queries over track points: zones, kinematics, the ten rules, matching and tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadlark.functions import geo, kinematics, scores
from roadlark.operators import aggregates as agg
from roadlark.operators import assignment, filters, forest, joins, lists, metrics, rules, tracking
from roadlark.operators import windows as win
from roadlark.plans.fixtures import P, PZ, events, metres, signals, track_points, violations, zones
from roadlark.plans.registry import query


def in_zones(spark, sf_dir):
    return joins.join_zones(track_points(spark, sf_dir), filters.active_zones(zones(spark)))


def _r6(c):
    return F.round(c, 6).alias(c)


def _out(found):
    return found.select("rule", "track_id", "zone_id", "started", "ended", "n_frames", F.round("measured", 6).alias("measured"))


def _islands(zone: int, condition: str, having: str, rule: str, measured: str) -> str:
    """Runs by differences of row numbers, with no rows of the fixture more than a second apart."""
    return f"""with {PZ}, q as (select *, row_number() over (partition by track_id order by t) - row_number() over (partition by track_id, ({condition}) order by t) as run from pz where zone_id = {zone}),
    g as (select track_id, zone_id, min(t) as started, max(t) as ended, count(*) as n_frames from q where {condition} group by track_id, zone_id, run)
    select '{rule}' as rule, track_id, zone_id, started, ended, n_frames, round(cast({measured} as double), 6) as measured from g where {having}"""


@query(f"with {PZ} select track_id, k, zone_id from pz")
def zone_point_in_polygon(spark, sf_dir):
    return in_zones(spark, sf_dir).select("track_id", "k", "zone_id")


@query(
    f"""with {P}, q as (select *, lag(lat) over w as la, lag(lng) over w as ln, t - lag(t) over w as dt from p window w as (partition by track_id order by t)), o as (select track_id, k, dt, lat, lng, la, ln from q where la is not null)
    select track_id, k, dt, round({metres('x', 'y').replace('x.lat', 'la').replace('x.lng', 'ln').replace('y.lat', 'lat').replace('y.lng', 'lng')}, 4) as step_m, round({metres('x', 'y').replace('x.lat', 'la').replace('x.lng', 'ln').replace('y.lat', 'lat').replace('y.lng', 'lng')} / dt * 3.6e0, 4) as step_kmh from o"""
)
def speed_heading(spark, sf_dir):
    return win.deltas(track_points(spark, sf_dir)).where("dt is not null").select("track_id", "k", "dt", F.round("step_m", 4).alias("step_m"), F.round("step_kmh", 4).alias("step_kmh"))


@query(_islands(0, "speed < 2", "ended - started > 30", "no_parking", "ended - started"))
def no_parking(spark, sf_dir):
    return _out(rules.no_parking(in_zones(spark, sf_dir)))


LEFT_AGAINST = "track_id in (select track_id from pz where zone_id = 1 group by track_id having arg_max(heading, t) between 151 and 209)"


@query(_islands(1, "heading > 150 and heading < 210", f"n_frames > 5 and {LEFT_AGAINST}", "wrong_way", "n_frames"))
def wrong_way(spark, sf_dir):
    return _out(rules.wrong_way(in_zones(spark, sf_dir)))


@query(f"with {PZ}, q as (select *, heading - lag(heading) over (partition by track_id order by t) as d from pz where zone_id = 2), g as (select track_id, zone_id, min(t) as started, max(t) as ended, sum(coalesce(d, 0)) as turn, max(abs(coalesce(d, 0))) as top, sum(abs(coalesce(d, 0))) as total from q group by all) select 'illegal_u_turn' as rule, track_id, zone_id, started, ended, cast(1 as bigint) as n_frames, round(abs(turn), 6) as measured from g where round(abs(turn), 6) > 160 and 1 - top / total >= 0.5")
def illegal_u_turn(spark, sf_dir):
    # the ramp's steps are rounded, so that an exact 160 degrees stays one
    points = in_zones(spark, sf_dir).withColumn("heading", F.round("heading", 6))
    return _out(rules.illegal_u_turn(points))


@query(f"""with {PZ}, q as (select *, lag("offset") over (partition by track_id order by t) as b from pz where zone_id = 3 and vehicle_class <> 'ambulance') select 'red_light' as rule, track_id, zone_id, t as started, t as ended, cast(1 as bigint) as n_frames, round("offset", 6) as measured from q where b < 0 and "offset" >= 0 and t % 60 < 30""")
def red_light_asof(spark, sf_dir):
    return _out(rules.red_light(in_zones(spark, sf_dir), signals(spark, sf_dir)))


@query(_islands(4, "speed > 60", "n_frames > 10", "speeding", "n_frames"))
def speeding(spark, sf_dir):
    return _out(rules.speeding(in_zones(spark, sf_dir)))


@query(_islands(5, "lane_offset > 0", "ended - started > 3", "lane", "ended - started"))
def lane_violation(spark, sf_dir):
    return _out(rules.lane(in_zones(spark, sf_dir)))


@query(_islands(6, "speed < 2", "ended - started > 10", "zebra_crossing", "ended - started"))
def zebra_crossing_jam_suppressed(spark, sf_dir):
    return _out(rules.zebra_crossing(in_zones(spark, sf_dir)))


@query(f"with {PZ} select 'no_helmet' as rule, track_id, zone_id, min(t) as started, max(t) as ended, count(*) as n_frames, round(max(helmet_conf), 6) as measured from pz where helmet_conf > 0.8e0 group by all")
def no_helmet(spark, sf_dir):
    return _out(rules.no_helmet(in_zones(spark, sf_dir)))


@query(f"with {PZ} select 'overloading' as rule, track_id, zone_id, min(t) as started, max(t) as ended, count(*) as n_frames, round(cast(max(passengers) as double), 6) as measured from pz where passengers >= 3 and vehicle_class = 'motorcycle' group by all")
def overloading(spark, sf_dir):
    return _out(rules.overloading(in_zones(spark, sf_dir)))


@query(_islands(9, "speed < 5", "ended - started > 20", "highway_stop", "ended - started"))
def highway_stop(spark, sf_dir):
    return _out(rules.highway_stop(in_zones(spark, sf_dir)))


@query(f"with {P} select track_id, k, count(*) over (partition by track_id order by k rows between 29 preceding and current row) as buffered from p")
def trajectory_buffer(spark, sf_dir):
    return win.trajectory_buffer(track_points(spark, sf_dir)).select("track_id", "k", F.size("buffer").cast("long").alias("buffered"))


@query(f"with {P} select track_id, count(*) as n, array_to_string(list(k order by k), ',') as line from p group by all")
def trajectory_lines(spark, sf_dir):
    p = track_points(spark, sf_dir)
    line = F.sort_array(F.collect_list(F.struct("k", "lng", "lat")))
    return p.groupBy("track_id").agg(F.count("*").alias("n"), F.array_join(F.transform(line, lambda x: x["k"].cast("string")), ",").alias("line"))


@query(f"with {P} select track_id, k from (select track_id, k, row_number() over (partition by track_id order by t) as r from p) where r > 10")
def with_history(spark, sf_dir):
    return win.has_history(track_points(spark, sf_dir)).select("track_id", "k")


@query(f"with {PZ} select track_id, zone_id, min(t) as entered, max(t) as \"left\", count(*) as n from pz group by all")
def zone_entry_timer(spark, sf_dir):
    return win.zone_visits(in_zones(spark, sf_dir)).select("track_id", "zone_id", "entered", "left", "n")


@query(f"with {P} select track_id, max(k) as k, max(t) as t from p group by track_id having max(t) > (select max(t) from p) - 30000")
def live_state_latest(spark, sf_dir):
    p = track_points(spark, sf_dir)
    now = p.agg(F.max("t")).first()[0] or 0
    return lists.latest_state(p, "track_id", 30000, now).select("track_id", "k", "t")


@query(f"with {P}, m as (select track_id, t - 7 as t, k as state from p where k % 9 = 0) select track_id, k, (select state from m where m.track_id = p.track_id and m.t <= p.t order by m.t desc limit 1) as state from p")
def telemetry_asof(spark, sf_dir):
    p = track_points(spark, sf_dir)
    m = p.where("k % 9 = 0").select("track_id", (F.col("t") - 7).alias("t"), F.col("k").alias("state"))
    return joins.asof(p.select("track_id", "k", "t"), m, ["track_id"]).select("track_id", "k", "state")


@query(f"with {P} select track_id, k, 100 + k % 25 as alt, case when 100 + k % 25 > 120 then 'violation' when 100 + k % 25 >= 110 then 'warning' else 'ok' end as status from p")
def altitude_compliance(spark, sf_dir):
    p = track_points(spark, sf_dir).withColumn("alt", F.expr("100 + k % 25"))
    return p.select("track_id", "k", "alt", scores.altitude_status(F.col("alt")).alias("status"))


@query(f"with {P} select track_id, min(100 + k % 25) as min_alt, max(100 + k % 25) as max_alt, round(avg(100 + k % 25), 6) as mean_alt from p group by all")
def altitude_profile(spark, sf_dir):
    p = track_points(spark, sf_dir).withColumn("alt", F.expr("100 + k % 25"))
    return agg.altitude_profile(p, ["track_id"]).select("track_id", "min_alt", "max_alt", _r6("mean_alt"))


@query(f"with {P}, c as (select distinct script, cast(floor(lat / (5 / 111195.0802335329e0)) as bigint) as a, cast(floor(lng / (5 / 111195.0802335329e0)) as bigint) as b from p) select script, count(*) * 25e0 as covered_sq_m from c group by all")
def session_coverage(spark, sf_dir):
    return agg.coverage(track_points(spark, sf_dir), 5.0, ["script"])


@query(f"with {P} select track_id, k, round(120 * 6.3e0 / (8 * (1000 + k)), 9) as gsd, round((k % 40) * power(120 * 6.3e0 / (8 * (1000 + k)), 2), 9) as area from p")
def gsd_and_area(spark, sf_dir):
    g = geo.gsd(F.lit(120.0), F.lit(6.3), F.lit(8.0), F.col("k") + 1000)
    return track_points(spark, sf_dir).select("track_id", "k", F.round(g, 9).alias("gsd"), F.round(scores.area_sq_m(F.col("k") % 40, g), 9).alias("area"))


@query(f"with {P} select track_id, k, round(lat + (540 - (k * 11) % 1080) * 0.05e0 / 111195.0802335329e0, 7) as lat, round(lng + ((k * 17) % 1920 - 960) * 0.05e0 / (111195.0802335329e0 * cos(radians(lat))), 7) as lng from p")
def pixel_projection(spark, sf_dir):
    at = geo.pixel_to_gps(F.expr("k * 17 % 1920"), F.expr("k * 11 % 1080"), F.lit(1920), F.lit(1080), F.lit(0.05), F.lit(0.0), F.col("lat"), F.col("lng"))
    return track_points(spark, sf_dir).select("track_id", "k", F.round(at["lat"], 7).alias("lat"), F.round(at["lng"], 7).alias("lng"))


@query(f"with {P} select track_id, k, round(greatest(0, least(10 + k % 7, 14) - greatest(k % 7, 4)) * greatest(0, least(10, 8) - greatest(0, 2)) / (100 + 60 - greatest(0, least(10 + k % 7, 14) - greatest(k % 7, 4)) * 6e0), 6) as iou from p")
def box_iou(spark, sf_dir):
    box = lambda x1, y1, x2, y2: F.struct(F.expr(f"cast({x1} as double)").alias("x1"), F.lit(float(y1)).alias("y1"), F.expr(f"cast({x2} as double)").alias("x2"), F.lit(float(y2)).alias("y2"))
    return track_points(spark, sf_dir).select("track_id", "k", F.round(geo.iou(box("k % 7", 0, "k % 7 + 10", 10), box("4", 2, "14", 8)), 6).alias("iou"))


@query(f"with {P} select track_id, k, least((heading - 350 + 720) % 360, 360 - (heading - 350 + 720) % 360) as off_north from (select track_id, k, round(heading, 6) as heading from p)")
def heading_difference(spark, sf_dir):
    p = track_points(spark, sf_dir).withColumn("heading", F.round("heading", 6))
    return p.select("track_id", "k", kinematics.ang_diff(F.col("heading"), F.lit(350.0)).alias("off_north"))


@query("with e as (select vec_id, label, embedding from embeddings), q as (select a.vec_id as track_id, b.vec_id as track_id_new, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as r from e a, range(1, 6) r(d) join e b on b.vec_id = a.vec_id + d where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.1e0) select track_id, track_id_new, similarity from q where r = 1")
def reid_cosine_match(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    lost = e.select(F.col("vec_id").alias("track_id"), F.col("vec_id").cast("double").alias("t_end"), F.col("embedding").alias("vec"))
    new = e.select(F.col("vec_id").alias("track_id"), F.col("vec_id").cast("double").alias("t_start"), F.col("embedding").alias("vec"))
    return joins.reid(lost, new, 5.0, 0.1).select("track_id", "track_id_new", F.round("similarity", 6).alias("similarity"))


@query("with s as (select doc_id, quality = 1 as truth, doc_id % 3 <> 0 as flagged, doc_id % 4 as kind from labels), c as (select kind, sum(case when truth and flagged then 1 else 0 end)::bigint as tp, sum(case when not truth and flagged then 1 else 0 end)::bigint as fp, sum(case when truth and not flagged then 1 else 0 end)::bigint as fn from s group by kind) select kind, tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round(1 - tp / (tp + fp), 6) as fpr, round(1 - tp / (tp + fn), 6) as fnr from c")
def precision_recall_f1(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("kind", F.col("doc_id") % 4)
    found = metrics.prf(s, F.col("quality") == 1, F.col("doc_id") % 3 != 0, ["kind"])
    return found.select("kind", "tp", "fp", "fn", *[_r6(c) for c in ("precision", "recall", "f1", "fpr", "fnr")])


@query("with s as (select doc_id % 4 as kind, doc_id, quality = 1 as m from labels), p as (select *, sum(m::int) over w / count(*) over w as pr from s window w as (partition by kind order by doc_id desc rows unbounded preceding)) select kind, round(sum(case when m then pr else 0 end) / sum(m::int), 6) as ap from p group by kind")
def average_precision(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("doc_id") % 4).alias("kind"), "doc_id", (F.col("quality") == 1).alias("is_match"))
    n = s.groupBy("kind").agg(F.sum(F.col("is_match").cast("int")).alias("n_truth"))
    return metrics.average_precision(s, n, ["kind"], [F.desc("doc_id")]).select("kind", _r6("ap"))


@query(f"with {P}, q as (select track_id as truth, t, case when k % 10 = 0 then null else track_id * 10 + k // 30 end as pred from p), l as (select *, last_value(pred ignore nulls) over (partition by truth order by t rows between unbounded preceding and 1 preceding) as before from q), c as (select count(*) as truths, count(*) filter (pred is null) as misses, count(*) filter (pred is not null and before <> pred) as switches from l) select truths, misses, cast(0 as bigint) as false_alarms, switches, round(1 - (misses + switches) / truths, 6) as mota, round(switches / truths, 6) as switch_rate, round(1 - misses / truths, 6) as continuity from c")
def tracking_accuracy(spark, sf_dir):
    m = track_points(spark, sf_dir).select(F.col("track_id").alias("truth_id"), "t", F.expr("case when k % 10 = 0 then null else track_id * 10 + k div 30 end").alias("pred_track"))
    return metrics.tracking_metrics(m).select("truths", "misses", "false_alarms", "switches", _r6("mota"), _r6("switch_rate"), _r6("continuity"))


@query(f"with {P}, q as (select script, lat, lng, lat + 0.00001e0 as tlat from p) select round(avg({metres('x', 'y').replace('x.lat', 'lat').replace('x.lng', 'lng').replace('y.lat', 'tlat').replace('y.lng', 'lng')}), 4) as mean_m, round(avg((script % 5 <> 0)::int), 6) as zone_accuracy from q")
def geo_accuracy(spark, sf_dir):
    p = track_points(spark, sf_dir).select("lat", "lng", (F.col("lat") + 0.00001).alias("true_lat"), F.col("lng").alias("true_lng"), F.col("script").alias("zone_id"), F.when(F.col("script") % 5 != 0, F.col("script")).otherwise(-1).alias("true_zone_id"))
    return metrics.geo_error(p).select(F.round("mean_m", 4).alias("mean_m"), _r6("zone_accuracy"))


@query()
def kalman_smooth(spark, sf_dir):
    return tracking.kalman(track_points(spark, sf_dir))


@query()
def trajectory_hull(spark, sf_dir):
    return tracking.hull(violations(spark, sf_dir), "zone_id")


@query()
def isolation_outliers(spark, sf_dir):
    features = win.deltas(track_points(spark, sf_dir)).where("dt is not null").groupBy("track_id").agg(F.avg("step_kmh").alias("mean_kmh"), F.max("step_kmh").alias("top_kmh"))
    return forest.isolation_forest(features, ("mean_kmh", "top_kmh"), "track_id")


#: Camera of a track point: tilted by up to 25 degrees from straight down, or nearly level, where upper pixels see no ground.
CAMERA = {"yaw": "k * 7 % 360", "pitch": "case when k % 10 = 0 then -4 else -90 + k % 25 end", "roll": "k % 11 - 5", "px": "k * 17 % 1920", "py": "k * 11 % 1080"}
RAY = """r0 as (select *, radians(yaw) as a, radians(pitch) as b, radians(roll) as c, (px - 960) / 1500e0 as u, (py - 540) / 1500e0 as v from (select *, {cols} from p)),
  r1 as (select *, u * cos(c) - v * sin(c) as rt, u * sin(c) + v * cos(c) as be from r0),
  r2 as (select *, (cos(b) + be * sin(b)) * sin(a) + rt * cos(a) as east, (cos(b) + be * sin(b)) * cos(a) - rt * sin(a) as north, be * cos(b) - sin(b) as down from r1),
  r3 as (select *, down > 0 and 120 * sqrt(east * east + north * north) <= 10000 * down as seen from r2)""".format(cols=", ".join(f"{v} as {k}" for k, v in CAMERA.items()))


@query(f"with {P}, {RAY} select track_id, k, case when seen then round(lat + north * 120 / down / 111195.0802335329e0, 7) end as lat, case when seen then round(lng + east * 120 / down / (111195.0802335329e0 * cos(radians(lat))), 7) end as lng from r3")
def tilted_projection(spark, sf_dir):
    p = track_points(spark, sf_dir).selectExpr("*", *[f"{v} as {k}" for k, v in CAMERA.items()])
    angles = [F.col(c) for c in ("yaw", "pitch", "roll")]
    at = geo.pixel_to_ground(F.col("px"), F.col("py"), F.lit(1920), F.lit(1080), F.lit(1500.0), *angles, F.lit(120.0), F.col("lat"), F.col("lng"))
    return p.withColumn("at", at).select("track_id", "k", F.round("at.lat", 7).alias("lat"), F.round("at.lng", 7).alias("lng"))


#: The classic series of transverse Mercator in powers of the longitude's distance, another one than the operator's.
UTM = """u0 as (select *, 6378137e0 as a, 1 / 298.257223563e0 as f, radians(lat) as phi, cast(floor((lng + 180) / 6) + 1 as int) as zone from p),
  u1 as (select *, f * (2 - f) as e, f * (2 - f) / (1 - f * (2 - f)) as ep, radians(lng - (zone * 6 - 183)) * cos(phi) as s, power(tan(phi), 2) as tt from u0),
  u2 as (select *, a / sqrt(1 - e * power(sin(phi), 2)) as n, ep * power(cos(phi), 2) as c,
    a * ((1 - e / 4 - 3 * e * e / 64 - 5 * power(e, 3) / 256) * phi - (3 * e / 8 + 3 * e * e / 32 + 45 * power(e, 3) / 1024) * sin(2 * phi) + (15 * e * e / 256 + 45 * power(e, 3) / 1024) * sin(4 * phi) - 35 * power(e, 3) / 3072 * sin(6 * phi)) as m from u1),
  u3 as (select *, 500000 + 0.9996e0 * n * (s + (1 - tt + c) * power(s, 3) / 6 + (5 - 18 * tt + tt * tt + 72 * c - 58 * ep) * power(s, 5) / 120) as x,
    0.9996e0 * (m + n * tan(phi) * (s * s / 2 + (5 - tt + 9 * c + 4 * c * c) * power(s, 4) / 24 + (61 - 58 * tt + tt * tt + 600 * c - 330 * ep) * power(s, 6) / 720)) as y from u2)"""


@query(f"with {P}, {UTM} select track_id, k, zone, round(x, 1) as x, round(y, 1) as y, true as returns from u3")
def utm_projection(spark, sf_dir):
    p = track_points(spark, sf_dir).withColumn("u", geo.to_utm(F.col("lat"), F.col("lng")))
    back = geo.from_utm(F.col("u.x"), F.col("u.y"), F.col("u.zone"), F.col("u.north"))
    returns = geo.haversine(F.col("lat"), F.col("lng"), F.col("back.lat"), F.col("back.lng")) < 0.01
    return p.withColumn("back", back).select("track_id", "k", "u.zone", F.round("u.x", 1).alias("x"), F.round("u.y", 1).alias("y"), returns.alias("returns"))


#: Six truths of a class side by side in a frame, each overlapping the next, and two predictions a truth, off by up to four pixels.
BOXES = "select event_id, event_id {div} 2 {div} 12 as frame_no, event_id {div} 2 % 2 as kind, event_id {div} 2 % 12 {div} 2 * 6 as place, event_id * 7 % 9 - 4 as off, (50 + event_id * 37 % 50) / 100{d} as confidence from "
MAP = """with recursive b as (""" + BOXES.format(div="//", d="e0") + """events), truth as (select event_id as truth_id, frame_no, kind, place from b where event_id % 2 = 0),
  near as (select b.event_id, list({'far': -o, 'id': truth_id} order by -o, truth_id) as c from (select b.event_id, truth_id, greatest(0, 10 - abs(b.place + off - truth.place)) * 10e0 / (200 - greatest(0, 10 - abs(b.place + off - truth.place)) * 10) as o from b join truth using (frame_no, kind)) b where o >= 0.5e0 group by all),
  ranked as (select b.*, coalesce(c, []) as c, row_number() over (partition by frame_no, kind order by confidence desc, event_id) as r from b left join near using (event_id)),
  steps as (select round(0.5e0 + 0.05e0 * k, 2) as s from range(10) t(k)),
  walk as (select frame_no, kind, s, cast(0 as bigint) as r, cast([] as bigint[]) as taken, 0e0 as confidence, false as hit from (select distinct frame_no, kind from b), steps
    union all select frame_no, kind, s, r, case when free is null then taken else list_append(taken, free) end, confidence, free is not null
    from (select w.frame_no, w.kind, s, n.r, taken, n.confidence, list_filter(n.c, lambda x: x.far <= -s and not list_contains(taken, x.id))[1].id as free from walk w join ranked n on n.frame_no = w.frame_no and n.kind = w.kind and n.r = w.r + 1)),
  points as (select kind, s, confidence, count(*) as n, sum(hit::int) as h from walk where r > 0 group by all),
  curve as (select *, sum(h) over w / sum(n) over w as pr from points window w as (partition by kind, s order by confidence desc)),
  env as (select *, max(pr) over (partition by kind, s order by confidence) as e from curve),
  ap as (select kind, s, sum(h * e) / (select count(*) from truth where truth.kind = env.kind) as ap from env group by kind, s),
  each as (select kind, max(case when s = 0.5e0 then ap end) as ap_50, max(case when s = 0.75e0 then ap end) as ap_75, avg(ap) as map from ap group by kind)
  select kind, round(ap_50, 6) as ap_50, round(ap_75, 6) as ap_75, round(map, 6) as map from each union all select null, round(avg(ap_50), 6), round(avg(ap_75), 6), round(avg(map), 6) from each"""


@query(MAP)
def mean_average_precision(spark, sf_dir):
    b = events(spark, sf_dir).selectExpr(*BOXES.format(div="div", d="D").removeprefix("select ").removesuffix(" from ").split(", "))
    box = lambda x: F.struct(x.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (x + 10).cast("double").alias("x2"), F.lit(10.0).alias("y2")).alias("box")
    pred = b.select("frame_no", "kind", F.col("event_id").alias("pred_id"), "confidence", box(F.col("place") + F.col("off")))
    truth = b.where("event_id % 2 = 0").select("frame_no", "kind", F.col("event_id").alias("truth_id"), box(F.col("place")))
    return metrics.mean_average_precision(pred, truth, ["frame_no", "kind"], "kind").select("kind", *[_r6(c) for c in ("ap_50", "ap_75", "map")])


@query(f"with {P} select count(*) as truths, count(*) filter (k % 10 = 0) as misses, cast(0 as bigint) as false_alarms, cast(0 as bigint) as switches, round(1 - count(*) filter (k % 10 = 0) / count(*), 6) as mota from p")
def assigned_tracks(spark, sf_dir):
    """Twenty vehicles to a session, neighbours driving through each other; every tenth frame is unseen, no track is lost or swapped."""
    p = track_points(spark, sf_dir).selectExpr("track_id", "track_id div 20 as session_id", "k as frame_no", "track_id * 100000 + k as det_id", "t", "track_id % 20 * 40 + k * (case when track_id % 2 = 0 then 3 else -3 end) as x")
    box = F.struct(F.col("x").cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("x") + 25).cast("double").alias("x2"), F.lit(12.0).alias("y2"))
    seen = p.where("frame_no % 10 <> 0").select("session_id", "frame_no", "det_id", box.alias("box"))
    named = assignment.assign_tracks(seen, chunk_frames=40, shared_frames=8)
    matched = p.join(named.select("det_id", F.col("assigned_track").alias("pred_track")), "det_id", "left").withColumnRenamed("track_id", "truth_id")
    # Spark rounds the shortest decimal text of a double, SQL the double itself: they differ at some halves of the sixth place
    mota = (F.round(F.col("mota") * 1e6) / 1e6).alias("mota")
    return metrics.tracking_metrics(matched).select("truths", "misses", "false_alarms", "switches", mota)
