"""Forest, average precision, sweeps, exact percentiles, projections and GeoJSON against plain loops."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlark.functions import geo
from roadlark.operators import aggregates, forest, joins, metrics

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


# isolation forest


def depth_of(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.child[node] + int(row[tree.feature[node]] >= tree.cut[node])
    return tree.depth[node]


def test_forest_finds_planted_outliers_and_equals_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (3000, 2)), [[9, 9], [-8, 7], [10, -11]]]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(5000, None, 1.0), (5001, float("nan"), 1.0)]
    frame = spark.createDataFrame(rows, "k long, a double, b double").repartition(5)
    got = {r["k"]: (r["outlier_score"], r["is_outlier"]) for r in forest.isolation_forest(frame, ("a", "b"), "k", trees=60).collect()}
    assert len(got) == len(rows) and got[5000] == got[5001] == (None, False)
    order = sorted(range(len(x)), key=lambda i: -got[i][0])
    assert set(order[:3]) == {3000, 3001, 3002} and all(got[i][1] for i in order[:3])
    assert sum(got[i][1] for i in range(3000)) < 60
    own = forest.fit(x, 20, 128, 3)
    usual = 2 * sum(1 / i for i in range(1, 128)) - 2 * 127 / 128
    for row in x[::97]:
        plain = 2 ** (-sum(depth_of(t, row) for t in own.trees) / len(own.trees) / usual)
        assert own.scores(row[None])[0] == pytest.approx(plain, rel=2e-3)  # c(n) takes the logarithm for the harmonic sum


def test_forest_of_nothing_and_of_equal_rows(spark):
    none = spark.createDataFrame([], "k long, a double")
    assert forest.isolation_forest(none, ("a",), "k").count() == 0
    same = forest.isolation_forest(spark.createDataFrame([(i, 1.0) for i in range(20)], "k long, a double"), ("a",), "k").collect()
    assert len({r["outlier_score"] for r in same}) == 1 and not any(r["is_outlier"] for r in same)
    again = [forest.isolation_forest(spark.createDataFrame([(i, float(i * i)) for i in range(50)], "k long, a double").repartition(n), ("a",), "k").orderBy("k").collect() for n in (1, 4)]
    assert again[0] == again[1]


# average precision


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def test_average_precision_in_crowded_frames(spark, monkeypatch):
    rng = random.Random(6)
    truth, pred = [], []
    for f in range(12):
        for kind in ("car", "bus"):
            for k in range(rng.randint(0, 7)):
                truth.append((len(truth), f, kind, (k * 5.0, 0.0, k * 5.0 + 10, 10.0)))
            for _ in range(rng.randint(0, 14)):
                at = rng.randint(0, 7) * 5.0 + rng.uniform(-4, 4)
                pred.append((len(pred), f, kind, round(rng.random(), rng.choice([1, 3])), (at, 0.0, at + 10, 10.0)))
    want = {}
    for kind in ("car", "bus"):
        n = sum(t[2] == kind for t in truth)
        for step in metrics.IOU_STEPS:
            hits, taken = [], set()
            for p in sorted((p for p in pred if p[2] == kind), key=lambda p: (-p[3], p[0])):
                near = sorted((-overlap(p[4], t[3]), t[0]) for t in truth if t[1:3] == p[1:3] and t[0] not in taken)
                hit = bool(near) and -near[0][0] >= step
                taken |= {near[0][1]} if hit else set()
                hits.append((p[3], hit))
            points = [(sum(c >= x for c, _ in hits), sum(h for c, h in hits if c >= x)) for x in sorted({c for c, _ in hits}, reverse=True)]
            area, before = 0.0, 0
            for i, (_, h) in enumerate(points):
                area += (h - before) * max(b / a for a, b in points[i:])
                before = h
            want[kind, step] = area / n
    p = spark.createDataFrame(pred, f"pred_id long, frame_no int, kind string, confidence double, box {BOX}")
    t = spark.createDataFrame(truth, f"truth_id long, frame_no int, kind string, box {BOX}")
    for parts in (1024, 3):
        monkeypatch.setattr(metrics, "CONFIDENCE_PARTS", parts)
        got = {r["kind"]: r for r in metrics.mean_average_precision(p, t, ["frame_no", "kind"], "kind").collect()}
        for kind in ("car", "bus"):
            assert got[kind]["ap_50"] == pytest.approx(want[kind, 0.5]) and got[kind]["ap_75"] == pytest.approx(want[kind, 0.75])
            assert got[kind]["map"] == pytest.approx(np.mean([want[kind, s] for s in metrics.IOU_STEPS]))
        assert got[None]["map"] == pytest.approx(np.mean(list(want.values())))
    assert {r["kind"]: r["map"] for r in metrics.mean_average_precision(p.limit(0), t, ["frame_no", "kind"], "kind").collect()} == {"car": 0.0, "bus": 0.0, None: 0.0}


def test_a_prediction_falls_back_to_its_second_truth(spark):
    t = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0)), (2, 0, (3.0, 0.0, 13.0, 10.0))], f"truth_id long, frame_no int, box {BOX}")
    p = spark.createDataFrame([(7, 0, 0.9, (0.5, 0.0, 10.5, 10.0)), (8, 0, 0.8, (1.0, 0.0, 11.0, 10.0))], f"pred_id long, frame_no int, confidence double, box {BOX}")
    assert {r["pred_id"]: r["is_match"] for r in metrics.match_at(p, t, ["frame_no"], (0.5,)).collect()} == {7: True, 8: True}


# sweeps


@pytest.mark.parametrize("bucket_s", [7.0, 3600.0])
def test_intervals_and_states_by_sweep(spark, bucket_s):
    """Nested, overlapping, empty and backward intervals; null keys and times; buckets shorter than an interval."""
    rng = random.Random(1)
    events = [(i, rng.choice(["a", "b", None]), rng.uniform(0, 500)) for i in range(500)] + [(9000, "a", None), (9001, "c", 5.0)] + [(9100, "a", 3.0)] * 2
    spans = [(rng.choice(["a", "b", None]), s, s + rng.uniform(-5, 60)) for s in (rng.uniform(0, 500) for _ in range(50))] + [("a", 100.0, 400.0), ("b", 3.0, 3.0), ("b", 4.0, None)]
    e = spark.createDataFrame(events, "event_id long, k string, t double")
    w = spark.createDataFrame(spans, "k string, start double, end double")
    holds = lambda k, t: t is not None and k is not None and any(k == a and b <= t <= (c if c is not None else -1) for a, b, c in spans)
    tagged = joins.tag_intervals(e, w, ["k"], "in_span", bucket_s=bucket_s)
    assert tagged.columns == ["event_id", "k", "t", "in_span"]
    assert collections.Counter((r["event_id"], r["in_span"]) for r in tagged.collect()) == collections.Counter((i, holds(k, t)) for i, k, t in events)
    states = w.where("k is not null").select("k", F.col("start").alias("t"), F.col("start").alias("state"))
    for r in joins.asof(e, states, ["k"], bucket_s=bucket_s).collect():
        if r["k"] is not None and r["t"] is not None:
            assert r["state"] == max((b for a, b, _ in spans if a == r["k"] and b <= r["t"]), default=None)
    assert joins.tag_intervals(e, w.limit(0), ["k"], "in_span").where("in_span").count() == 0 and joins.tag_intervals(e.limit(0), w, ["k"], "in_span").count() == 0
    plan = joins.tag_intervals(e, w, ["k"], "in_span")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("ordered", "splits"), [(4096, 256), (5, 3)])
def test_percentiles_equal_the_engine_s(spark, monkeypatch, ordered, splits):
    """Ranges narrowed again and again: values over 18 orders of magnitude, ties, single values, groups of nulls."""
    monkeypatch.setattr(aggregates, "ORDERED_VALUES", ordered)
    monkeypatch.setattr(aggregates, "SPLITS", splits)
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([None, rng.gauss(0, 1), rng.randint(0, 5) * 1.0, 10 ** rng.uniform(-9, 9)])) for _ in range(1500)] + [("z", None), ("o", 4.0), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.5, 0.95):
        got = {r["k"]: r[f"p{round(q * 100)}"] for r in aggregates.percentile(df, "v", q, ["k"]).collect()}
        assert got == {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")).collect()}
    assert aggregates.percentile(df, "v", 0.5).first()[0] == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert aggregates.percentile(df.limit(0), "v", 0.5).first()[0] is None


# rules of a place


def test_strict_rules_never_fire_without_what_they_need(spark):
    from roadlark.operators import planning

    profiles = spark.createDataFrame([(1, "red_light", 9, 0.9), (2, "wrong_way", 9, 0.9), (3, "speeding", 9, 0.9)], "cluster_id long, vtype string, n long, share double")
    kept = lambda df, **o: sorted(r["cluster_id"] for r in planning.apply_rules(df, planning.rule_table(spark), **o).collect())
    assert kept(profiles, strict=True) == [2] and kept(profiles) == [1, 2, 3]
    assert kept(profiles.withColumn("at_intersection", F.lit(True)).withColumn("near_school", F.lit(None).cast("boolean")), strict=True) == [1, 2]
    events = spark.createDataFrame([(1, 7, "lane"), (1, 7, "lane"), (1, 8, "lane"), (2, 8, "lane"), (2, None, "lane")], "cluster_id long, zone_id long, vtype string")
    zones = spark.createDataFrame([(7, True, None, True), (8, False, True, False)], "zone_id long, at_intersection boolean, near_school boolean, multi_lane boolean")
    got = {r["cluster_id"]: (r["at_intersection"], r["near_school"], r["multi_lane"]) for r in planning.zone_context(events, zones, "cluster_id").collect()}
    assert got == {1: (True, False, True), 2: (False, False, False)}


# projections and shapes


def at(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_pixels_of_tilted_cameras(spark):
    """Known rays: the axis of a camera at 45 degrees hits the ground as far off as it is high; the horizon and the sky hit nothing."""
    look = lambda x, y, yaw, pitch, roll, alt=100.0: at(spark, geo.pixel_to_ground(*[F.lit(float(v)) for v in (x, y, 1000, 1000, 500, yaw, pitch, roll, alt, 0.0, 0.0)]))
    metre = 1 / geo.METRES_PER_DEGREE
    for yaw, east, north in ((0, 0, 100), (90, 100, 0), (180, 0, -100), (270, -100, 0)):
        p = look(500, 500, yaw, -45, 0)
        assert (p["lng"], p["lat"]) == pytest.approx((east * metre, north * metre), abs=1e-9)
    p = look(1000, 500, 0, -90, 0)  # straight down, a pixel to the right: as far east as high
    assert (p["lng"], p["lat"]) == pytest.approx((100 * metre, 0), abs=1e-9)
    p = look(1000, 500, 0, -90, 90)  # rolled clockwise by a quarter, the right side points to the camera's south
    assert (p["lng"], p["lat"]) == pytest.approx((0, -100 * metre), abs=1e-9)
    assert look(500, 500, 0, 0, 0) is None and look(500, 0, 0, -10, 0) is None and look(500, 500, 0, -45, 0, 0.0) is None
    nadir = at(spark, geo.pixel_to_gps(*[F.lit(float(v)) for v in (700, 300, 1000, 1000, 0.2, 30, 0.0, 0.0)]))
    p = look(700, 300, 30, -90, 0)
    assert (p["lng"], p["lat"]) == pytest.approx((nadir["lng"], nadir["lat"]), abs=1e-9)


def test_utm_both_ways(spark):
    """Round trips far below a centimetre over both hemispheres; the central meridian lies at 500 km."""
    rng = random.Random(3)
    places = [(rng.uniform(-80, 84), rng.uniform(-180, 179.99)) for _ in range(300)] + [(0.0, 3.0), (-0.0, -177.0), (84.0, 0.0), (-80.0, 5.999)]
    df = spark.createDataFrame(places, "lat double, lng double").withColumn("u", geo.to_utm(F.col("lat"), F.col("lng")))
    df = df.withColumn("b", geo.from_utm(F.col("u.x"), F.col("u.y"), F.col("u.zone"), F.col("u.north")))
    off = df.select(F.max(geo.haversine(F.col("lat"), F.col("lng"), F.col("b.lat"), F.col("b.lng"))), F.min("u.x"), F.max("u.x"), F.min("u.y")).first()
    assert off[0] < 0.001 and 166_000 <= off[1] and off[2] <= 834_000 and off[3] >= 0
    middle = at(spark, geo.to_utm(F.lit(0.0), F.lit(3.0)))
    assert (middle["zone"], middle["x"], middle["y"]) == (31, pytest.approx(500_000), pytest.approx(0))
    # a degree of the meridian at the equator: 110,574.4 m on the ellipsoid
    assert at(spark, geo.to_utm(F.lit(1.0), F.lit(3.0)))["y"] == pytest.approx(110_574.4 * 0.9996, abs=0.5)
    assert at(spark, geo.to_utm(F.lit(85.0), F.lit(3.0))) is None


def test_shapes_as_geojson_and_back(spark):
    import json

    ring = lambda places: F.array(*[F.struct(F.lit(float(x)).alias("lng"), F.lit(float(y)).alias("lat")) for x, y in places])
    own = [(0, 0), (2, 0), (2, 1)]
    text = at(spark, geo.polygon_geojson(ring(own[::-1]), F.struct(F.lit(1).alias("k"))))
    rings = json.loads(text)["geometry"]["coordinates"]
    assert rings == [[[0.0, 0.0], [2.0, 0.0], [2.0, 1.0], [0.0, 0.0]]] or (rings[0][0] == rings[0][-1] and len(rings[0]) == 4)
    doubled = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(rings[0], rings[0][1:], strict=False))
    assert doubled > 0 and json.loads(text)["properties"] == {"k": 1}
    back = at(spark, geo.from_polygon_geojson(F.lit(text)))
    assert {(p["lng"], p["lat"]) for p in back} == {(float(x), float(y)) for x, y in own} and len(back) == 3
    line = at(spark, geo.line_geojson(ring(own), F.struct(F.lit(1).alias("k"))))
    assert [(p["lng"], p["lat"]) for p in at(spark, geo.from_line_geojson(F.lit(line)))] == own
    assert at(spark, geo.from_line_geojson(F.lit(text))) is None and at(spark, geo.from_polygon_geojson(F.lit(line))) is None
    assert at(spark, geo.line_geojson(ring(own[:1]), F.struct(F.lit(1).alias("k")))) is None and at(spark, geo.polygon_geojson(ring(own[:2]), F.struct(F.lit(1).alias("k")))) is None
    assert math.isfinite(doubled)
