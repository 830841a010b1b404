"""Boundary cases and invariants of the operators on tiny frames."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadlark.functions import geo, kinematics, scores
from roadlark.operators import anomalies, clustering, filters, joins, lists, metrics, planning, rules, tracking, windows

SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
POINTS = "track_id long, zone_id long, zone_type string, t long, speed double, heading double, permitted_dir double, grace_period int, speed_limit int, lane_type string, lane_offset double, helmet_conf double, passengers int, offset double, vehicle_class string, lat double, lng double"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def point(**more):
    row = {"track_id": 1, "zone_id": 1, "zone_type": "no_parking", "t": 0, "speed": 40.0, "heading": 0.0, "permitted_dir": 0.0, "grace_period": None, "speed_limit": 60, "lane_type": "solid", "lane_offset": -1.0, "helmet_conf": 0.0, "passengers": 1, "offset": -1.0, "vehicle_class": "car", "lat": 0.0, "lng": 0.0}
    return tuple((row | more).values())


def frame(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def test_distance_and_polygons(spark):
    lit = F.lit
    assert value(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(geo.METRES_PER_DEGREE, rel=1e-9)
    ring = F.array(*[F.struct(lit(x).alias("lng"), lit(y).alias("lat")) for x, y in SQUARE])
    inside = lambda y, x: value(spark, geo.point_in_polygon(lit(y), lit(x), ring))
    assert inside(0.5, 1.0) and not inside(1.5, 1.0) and not inside(0.5, 2.5) and not inside(0.5, -0.1)
    assert value(spark, geo.centroid(ring)).asDict() == pytest.approx({"lng": 1.0, "lat": 0.5})
    assert value(spark, geo.within_buffer(lit(-0.00001), lit(1.0), ring, 2.0)) and not value(spark, geo.within_buffer(lit(-0.0001), lit(1.0), ring, 2.0))
    assert value(spark, geo.crosses(*[lit(float(v)) for v in (0, -1, 0, 1, -1, 0, 1, 0)])) and not value(spark, geo.crosses(*[lit(float(v)) for v in (0, 1, 0, 2, -1, 0, 1, 0)]))
    text = value(spark, geo.point_geojson(lit(17.5), lit(78.5), F.struct(lit("a").alias("k"))))
    assert value(spark, geo.from_point_geojson(lit(text))).asDict() == {"lng": 78.5, "lat": 17.5}


def test_angles_and_scores(spark):
    lit = F.lit
    assert value(spark, kinematics.ang_diff(lit(359.0), lit(1.0))) == 2 and value(spark, kinematics.signed_turn(lit(359.0), lit(1.0))) == 2
    assert value(spark, kinematics.heading_deg(lit(1.0), lit(0.0))) == 90
    assert [value(spark, scores.altitude_status(lit(float(a)))) for a in (109, 110, 120, 121)] == ["ok", "warning", "warning", "violation"]
    assert [value(spark, scores.band(lit(s))) for s in (0.32, 0.33, 0.66)] == ["low", "medium", "high"]
    assert value(spark, scores.percent_change(lit(142.0), lit(35.5))) == -75
    assert value(spark, scores.confidence(F.array(lit(1.0), lit(0.5)), F.array(lit(1.0), lit(3.0)))) == pytest.approx(0.625)
    assert value(spark, scores.marker_status(lit(31), lit(30))) == "red"


@pytest.mark.parametrize(("seconds", "grace", "found"), [(29, None, 0), (30, None, 0), (31, None, 1), (31, 40, 0), (41, 40, 1)])
def test_no_parking_grace(spark, seconds, grace, found):
    rows = [point(t=t, speed=1.0, grace_period=grace) for t in range(seconds + 1)]
    assert rules.no_parking(frame(spark, rows)).count() == found


@pytest.mark.parametrize(("gap", "runs"), [(5, 1), (6, 2)])
def test_occlusion_keeps_or_splits_a_run(spark, gap, runs):
    rows = [point(t=t, speed=1.0) for t in [*range(40), *range(39 + gap, 80 + gap)]]
    assert rules.no_parking(frame(spark, rows)).count() == runs


def test_frame_rules(spark):
    for n, found in ((5, 0), (6, 1)):
        assert rules.wrong_way(frame(spark, [point(zone_type="lane", t=t, heading=180.0) for t in range(n)])).count() == found
    for n, found in ((10, 0), (11, 1)):
        assert rules.speeding(frame(spark, [point(zone_type="speed", t=t, speed=61.0) for t in range(n)])).count() == found
    assert rules.wrong_way(frame(spark, [point(zone_type="lane", t=t, heading=150.0) for t in range(9)])).count() == 0


def test_wrong_way_judges_the_exit(spark):
    lane = lambda *headings: frame(spark, [point(zone_type="lane", t=t, heading=h) for t, h in enumerate(headings)])
    against = [180.0] * 7
    assert rules.wrong_way(lane(*against, 10.0)).count() == 0
    assert [r["n_frames"] for r in rules.wrong_way(lane(0.0, *against)).collect()] == [7]
    assert rules.wrong_way(lane(*against, None)).count() == 1


def test_speeding_smooths_and_leaves_cut_boxes_out(spark):
    own = lambda speeds: frame(spark, [point(zone_type="speed", t=t, speed=s) for t, s in enumerate(speeds)])
    dip = [70.0] * 6 + [45.0] + [70.0] * 5
    assert [r["n_frames"] for r in rules.speeding(own(dip)).collect()] == [12]
    assert rules.speeding(own([40.0, 70.0, 40.0] * 6)).count() == 0
    assert rules.speeding(own([70.0] * 5 + [None] + [70.0] * 6)).count() == 0
    box = lambda x2: F.struct(F.lit(5.0).alias("x1"), F.lit(5.0).alias("y1"), x2.alias("x2"), F.lit(9.0).alias("y2"))
    boxed = own([70.0] * 12).withColumn("box", box(F.when(F.col("t") < 2, 100.0).otherwise(50.0)))
    assert rules.speeding(boxed).count() == 1 and rules.speeding(boxed, frame_size=(100.0, 100.0)).count() == 0


def test_rules_ask_for_the_place(spark):
    rows = [(1, "pothole", 0.9, True, True, None), (2, "pothole", 0.9, True, False, None), (3, "pothole", 0.9, None, True, True), (4, "waterlogging", 0.41, False, False, True), (5, "waterlogging", 0.40, True, True, True), (6, "waterlogging", 0.9, True, True, None), (7, "wrong_way", 0.5, None, None, None)]
    profiles = spark.createDataFrame(rows, "cluster_id long, vtype string, share double, arterial boolean, mostly_high boolean, chronic boolean")
    got = planning.apply_rules(profiles, planning.rule_table(spark))
    assert sorted((r["cluster_id"], r["rec_type"]) for r in got.collect()) == [(1, "resurfacing"), (4, "drainage"), (7, "one_way")]
    dets = spark.createDataFrame([(1, "pothole", 0, 7, "high"), (1, "pothole", 1, 7, "high"), (1, "pothole", 1, 8, "low"), (2, "pothole", 0, 8, "high"), (2, "pothole", 0, None, "low")], "place long, anomaly_type string, session_id long, zone_id long, severity_band string")
    zones = spark.createDataFrame([(7, "arterial", True), (8, "local", None)], "zone_id long, road_class string, near_school boolean")
    got = {r["place"]: (r["mostly_high"], r["arterial"], r["near_school"], r["chronic"]) for r in planning.place_context(dets, zones, "place").collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, False)}


def test_u_turn(spark):
    turn = lambda total: [point(zone_type="u_turn", t=t, heading=total * t / 10) for t in range(11)]
    assert rules.illegal_u_turn(frame(spark, turn(160.0))).count() == 0 and rules.illegal_u_turn(frame(spark, turn(170.0))).count() == 1
    jerk = [point(zone_type="u_turn", t=0, heading=0.0), point(zone_type="u_turn", t=1, heading=175.0)]
    assert rules.illegal_u_turn(frame(spark, jerk)).count() == 0


def test_red_light(spark):
    signals = spark.createDataFrame([(1, 0, "GREEN"), (1, 10, "RED"), (1, 20, "GREEN")], "zone_id long, t long, state string")
    cross = lambda at, **k: [point(zone_type="stop_line", t=at - 1, offset=-1.0, **k), point(zone_type="stop_line", t=at, offset=0.5, **k)]
    for at, found in ((9, 0), (10, 1), (19, 1), (20, 0)):
        assert rules.red_light(frame(spark, cross(at)), signals).count() == found
    assert rules.red_light(frame(spark, cross(12, vehicle_class="ambulance")), signals).count() == 0


def test_lane_zebra_highway_and_jams(spark):
    assert rules.lane(frame(spark, [point(zone_type="lane_boundary", t=t, lane_offset=1.0) for t in range(5)])).count() == 1
    assert rules.lane(frame(spark, [point(zone_type="lane_boundary", t=t, lane_offset=1.0, lane_type="dashed") for t in range(5)])).count() == 0
    alone = [point(zone_type="zebra", t=t, speed=1.0) for t in range(12)]
    assert rules.zebra_crossing(frame(spark, alone)).count() == 1
    jam = [point(zone_type="zebra", track_id=k, t=t, speed=1.0) for t in range(12) for k in range(3)]
    assert rules.zebra_crossing(frame(spark, jam)).count() == 0
    assert rules.highway_stop(frame(spark, [point(zone_type="highway", t=t, speed=4.0) for t in range(22)])).count() == 1


def test_riders(spark):
    rows = [point(track_id=1, helmet_conf=0.80), point(track_id=2, helmet_conf=0.81), point(track_id=3, passengers=3, vehicle_class="motorcycle"), point(track_id=4, passengers=2, vehicle_class="motorcycle")]
    assert [r["track_id"] for r in rules.no_helmet(frame(spark, rows)).collect()] == [2]
    assert [r["track_id"] for r in rules.overloading(frame(spark, rows)).collect()] == [3]


def test_raising_a_threshold_never_adds_runs(spark):
    rng = random.Random(2)
    rows = [point(track_id=k, t=t, speed=rng.choice([1.0, 3.0, 40.0])) for k in range(6) for t in range(60)]
    f = frame(spark, rows)
    counts = [windows.sustained(f, F.col("speed") < 5, ["track_id"], seconds=s).count() for s in (0, 1, 3, 6)]
    assert counts == sorted(counts, reverse=True)


def test_empty_and_single_points(spark):
    assert rules.all_rules(frame(spark, []), spark.createDataFrame([], "zone_id long, t long, state string")).count() == 0
    assert windows.deltas(frame(spark, [point()])).where("dt is not null").count() == 0


def test_distance_join_equals_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, 60 + rng.random() * 0.002, 10 + rng.random() * 0.004, rng.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, lat double, lng double, kind int")
    got = {(r["id"], r["id_b"]) for r in joins.within_distance_join(df, df, 25.0, ["kind"], most_lat=61).collect()}

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in pts for b in pts if a[3] == b[3] and metres(a, b) <= 25.0}


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 7, 12)] + [("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 10, "y")], "k string, t long, state string")
    assert {(r["k"], r["t"], r["state"]) for r in joins.asof(left, right, ["k"]).collect()} == {("a", 0, None), ("a", 5, "x"), ("a", 7, "x"), ("a", 12, "y"), ("b", 3, None)}


def test_large_zone_tables_join_by_cell(spark, monkeypatch):
    pts = spark.createDataFrame([(1, 0.5, 1.0), (2, 5.0, 5.0)], "track_id long, lat double, lng double")
    zones = spark.createDataFrame([(7, SQUARE)], "zone_id long, polygon array<struct<lng:double,lat:double>>")
    plain = joins.join_zones(pts, zones).select("track_id", "zone_id").collect()
    monkeypatch.setattr(joins, "BROADCAST_ZONES", 0)
    assert joins.join_zones(pts, zones, cell_m=20_000.0).select("track_id", "zone_id").collect() == plain == [(1, 7)]


def test_duplicates_between_sessions(spark):
    cols = "event_id long, session_id long, vtype string, t long, lat double, lng double, confidence double, status string"
    step = 1 / geo.METRES_PER_DEGREE
    rows = [(1, 0, "a", 0, 0.0, 0.0, 0.7, "flagged"), (2, 1, "a", 5, 9.9 * step, 0.0, 0.9, "flagged"), (3, 1, "a", 6, 0.0, 0.0, 0.9, "flagged"), (4, 1, "b", 0, 0.0, 0.0, 0.9, "flagged"), (5, 1, "a", 0, 10.1 * step, 0.0, 0.9, "flagged")]
    ev = spark.createDataFrame(rows, cols)
    pairs = joins.cross_session_dups(ev)
    assert [(r["event_id"], r["event_id_b"]) for r in pairs.collect()] == [(1, 2)]
    assert {r["event_id"]: r["status"] for r in joins.keep_best(ev, pairs).collect()}[1] == "duplicate"


def test_anomalies_of_three_sessions_are_one(spark):
    step = 1 / geo.METRES_PER_DEGREE
    rows = [(i, "pothole", i, 0.0, i * 2.9 * step, 0.5, 10 * i) for i in range(3)] + [(9, "pothole", 0, 1.0, 1.0, 0.2, 0), (10, "crack", 0, 0.0, 0.0, 0.2, 0)]
    dets = spark.createDataFrame(rows, "det_id long, anomaly_type string, session_id long, lat double, lng double, severity double, t long")
    inv = {r["anomaly_id"]: r for r in anomalies.inventory(anomalies.dedup(dets, most_lat=2)).collect()}
    assert set(inv) == {0, 9, 10} and inv[0]["n_sessions"] == 3 and inv[0]["last_seen"] == 20
    assert [r["visibility"] for r in filters.promote(spark.createDataFrame([(1,), (2,)], "n_sessions long")).collect()] == ["low_confidence", "promoted"]


def test_dbscan_border_tie_and_order(spark):
    step = 1 / geo.METRES_PER_DEGREE
    rows = [(i, "a", 0.0, 0.0) for i in range(1, 4)] + [(i, "a", 0.0, 90 * step) for i in range(11, 14)] + [(20, "a", 0.0, 45 * step), (30, "a", 0.0, 900 * step), (40, "b", 0.0, 0.0)]
    want = {(i, 1, "core") for i in (1, 2, 3)} | {(i, 11, "core") for i in (11, 12, 13)} | {(20, 1, "border")}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "event_id long, vtype string, lat double, lng double")
        got = clustering.dbscan(df, metres=50.0, least=8)
        assert got.count() == 0
        # the middle point sees all seven, each end only four
        got = {(r["event_id"], r["cluster_id"], r["role"]) for r in clustering.dbscan(df, metres=50.0, least=4).collect()}
        assert got == {(i, 1, "core") for i in (1, 2, 3, 11, 12, 13, 20)}
        got = {(r["event_id"], r["cluster_id"], r["role"]) for r in clustering.dbscan(df.where("event_id <> 20").unionByName(df.where("event_id = 20").withColumn("lng", F.lit(45 * step))), metres=44.9, least=3).collect()}
        assert got == want - {(20, 1, "border")}


def test_lifecycle_lists_and_rules(spark):
    h = spark.createDataFrame([(1, 0, "flagged"), (1, 1, "reviewed"), (1, 2, "resolved"), (2, 0, "flagged"), (2, 1, "duplicate")], "event_id long, t long, status string")
    assert [(r["event_id"], r["before"], r["status"]) for r in windows.check_transitions(h).collect()] == [(1, "reviewed", "resolved")]
    assert lists.catch_up(spark.range(100).withColumnRenamed("id", "t"), 99).count() == 60
    profiles = spark.createDataFrame([(1, "red_light", 4, 0.40), (2, "red_light", 5, 0.41)], "cluster_id long, vtype string, n long, share double")
    assert [r["cluster_id"] for r in planning.apply_rules(profiles, planning.rule_table(spark)).collect()] == [2]
    requests = spark.createDataFrame([("OFFICER", "dismiss_violations"), ("PLANNER", "dismiss_violations"), ("ADMIN", "manage_users")], "role string, action string")
    assert {(r["role"], r["allowed"]) for r in filters.has_permission(requests).collect()} == {("OFFICER", True), ("PLANNER", False), ("ADMIN", True)}


def test_density_boundary(spark):
    from roadlark.operators.aggregates import frame_density

    rows = [(1, 1, k) for k in range(80)] + [(1, 2, k) for k in range(81)]
    got = {r["frame_no"]: r["dense"] for r in frame_density(spark.createDataFrame(rows, "session_id long, frame_no long, track_id long")).collect()}
    assert got == {1: False, 2: True}


def test_matching_and_metrics(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    pred = spark.createDataFrame([(1, 1, 0.9, (0.0, 0.0, 10.0, 10.0)), (2, 1, 0.8, (0.0, 0.0, 10.0, 9.0)), (3, 1, 0.7, (50.0, 50.0, 60.0, 60.0))], f"pred_id long, frame_no int, confidence double, box {box}")
    truth = spark.createDataFrame([(7, 1, (0.0, 0.0, 10.0, 10.0))], f"truth_id long, frame_no int, box {box}")
    got = {r["pred_id"]: r["is_match"] for r in joins.match_ground_truth(pred, truth, ["frame_no"]).collect()}
    assert got == {1: True, 2: False, 3: False}
    rho = metrics.spearman(spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (2.0, 30.0), (3.0, 40.0)], "x double, y double"), "x", "y").first()["rho"]
    assert rho == pytest.approx(0.9486832980505138)


def test_matching_tasks_are_bounded_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(joins, "MATCH_ROWS", 100, raising=False)
    pred = spark.range(3000).selectExpr("id as pred_id", "id div 2 as frame_no", "id % 7 / 10D as confidence", "struct(0D as x1, 0D as y1, 10D as x2, 10D - id % 2 as y2) as box")
    truth = spark.range(1500).selectExpr("id as truth_id", "id as frame_no", "struct(0D as x1, 0D as y1, 10D as x2, 10D as y2) as box")
    found = joins.match_ground_truth(pred, truth, ["frame_no"]).withColumn("part", F.spark_partition_id()).collect()
    assert max(Counter(r["part"] for r in found).values()) <= 300
    best = {max((a, a + 1), key=lambda k: (k % 7, -k)) for a in range(0, 3000, 2)}
    assert {r["pred_id"]: r["truth_id"] for r in found} == {k: k // 2 if k in best else None for k in range(3000)}


def test_tracking(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [("s", f, k, (100.0 * k + f, 0.0, 100.0 * k + f + 20, 20.0)) for f in range(10) for k in range(2)]
    got = tracking.assign_tracks(spark.createDataFrame(rows, f"session_id string, frame_no int, det_id long, box {box}")).collect()
    assert {r["assigned_track"] for r in got if r["det_id"] == 0} != {r["assigned_track"] for r in got if r["det_id"] == 1} and len({r["assigned_track"] for r in got}) == 2
    pts = [(1, float(x), float(y)) for x in range(5) for y in range(5)]
    ring = tracking.hull(spark.createDataFrame(pts, "cluster_id long, lng double, lat double")).first()["hull"]
    assert {(p["lng"], p["lat"]) for p in ring} == {(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)}
    line = spark.createDataFrame([(1, t, 17 + 1e-5 * t, 78.0) for t in range(30)], "track_id long, t long, lat double, lng double")
    last = tracking.kalman(line).orderBy("t").collect()[-1]
    assert last["next_lat"] == pytest.approx(17 + 1e-5 * 30, abs=2e-6)
    values = spark.createDataFrame([(i, 1.0 + i % 3 * 0.1) for i in range(50)] + [(99, 50.0)], "k long, v double")
    assert [r["k"] for r in tracking.robust_outliers(values, ("v",), "k").where("is_outlier").collect()] == [99]


def test_patrols_and_wet_potholes(spark):
    ring = "array<struct<lng:double,lat:double>>"
    move = lambda dx, dy: [(x + dx, y + dy) for x, y in SQUARE]
    patrols = spark.createDataFrame([(1, move(0.0, 0.0)), (2, move(5.0, 5.0)), (3, [(-9.0, -9.0), (20.0, -9.0), (20.0, -8.5), (-9.0, -8.5)])], f"patrol_id long, polygon {ring}")
    no_fly = spark.createDataFrame([(move(1.0, 0.5),), ([(4.0, 4.0), (9.0, 4.0), (9.0, 9.0), (4.0, 9.0)],)], f"polygon {ring}")
    assert [r["patrol_id"] for r in filters.valid_patrol(patrols, no_fly).collect()] == [3]
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    masks = spark.createDataFrame([(1, "s", 1, "pothole", 0.8, (0.0, 0.0, 10.0, 10.0)), (2, "s", 1, "waterlogging", 0.8, (5.0, 0.0, 15.0, 10.0)), (3, "s", 2, "pothole", 0.8, (0.0, 0.0, 10.0, 10.0))], f"det_id long, session_id string, frame_no int, anomaly_type string, confidence double, box {box}")
    got = {r["det_id"]: (r["waterlogged"], r["confidence"]) for r in joins.wet_pothole(masks).collect()}
    assert got == {1: (True, 0.4), 2: (False, 0.8), 3: (False, 0.8)}
    tagged = filters.tag_quality(masks, wet=F.col("anomaly_type") == "waterlogging").collect()
    assert [r["tags"] for r in tagged] == [[], ["wet"], []]


def test_distance_joins_are_shuffled_and_lose_no_pair(spark, capsys, tmp_path):
    """Copies of rows are never broadcast; pairs over edges of cells and time buckets, on both sides of zero, are found."""
    rng = random.Random(12)
    step = 1 / geo.METRES_PER_DEGREE
    rows = [(i, i % 3, "k", rng.choice([-1, 1]) * rng.uniform(0, 30), rng.uniform(-40, 40) * step, rng.uniform(-40, 40) * step) for i in range(500)]
    spark.createDataFrame(rows, "event_id long, session_id long, vtype string, t double, lat double, lng double").write.parquet(f"{tmp_path}/events")
    pairs = joins.cross_session_dups(spark.read.parquet(f"{tmp_path}/events"), most_lat=1.0)
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out
    near = lambda a, b: 2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(a[4] - b[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(a[5] - b[5]) / 2) ** 2)) <= 10
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[1] and abs(a[3] - b[3]) <= 5 and near(a, b))
    assert want and sorted((r["event_id"], r["event_id_b"]) for r in pairs.collect()) == want
