"""Polygon covers against ray casting in plain loops."""

import math
import random

from pyspark.sql import functions as F

from roadlark.operators import cover, joins
from roadlark.plans import catalog

POLYGON = "zone_id long, polygon array<struct<lng:double,lat:double>>"


def holds(ring, y, x):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            inside = not inside
    return inside


def found(points, zones, **options):
    return sorted((r["id"], r["zone_id"]) for r in joins.join_zones(points, zones, **options).collect())


def test_concave_polygons_of_all_sizes(spark, monkeypatch):
    """Stars from 100 m to 200 km, some over each other, with points on and beside their corners."""
    rng = random.Random(2)
    rings = []
    for i in range(50):
        cx, cy, r, n = rng.uniform(-3, 3), rng.uniform(-3, 3), 10 ** rng.uniform(-3, 0.3), rng.randint(3, 12)
        rings.append((i, [(cx + r * rng.uniform(0.2, 1) * math.cos(2 * math.pi * k / n), cy + r * rng.uniform(0.2, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]))
    at = [(i, rng.uniform(-3.5, 3.5), rng.uniform(-3.5, 3.5)) for i in range(1500)]
    at += [(5000 + 10 * i + k, y + d, x) for i, ring in rings for k, (x, y) in enumerate(ring[:3]) for d in (0.0, 1e-9)]
    want = sorted((i, z) for i, y, x in at for z, ring in rings if holds(ring, y, x))
    points = spark.createDataFrame([*at, (-1, None, 1.0), (-2, 1.0, None)], "id long, lat double, lng double")
    zones = spark.createDataFrame([*rings, (900, []), (901, None), (902, [(1.0, 1.0)])], POLYGON)
    assert found(points, zones) == want
    monkeypatch.setattr(cover, "BROADCAST_BYTES", 0)
    assert found(points, zones) == want and found(points, zones, cell_m=100_000.0) == want
    none = spark.createDataFrame([], POLYGON)
    assert found(points, none) == [] and found(points.limit(0), zones) == []


def test_holes_between_zones_and_common_edges(spark):
    """A frame of four zones around a hole: no point of the hole is in a zone, a point on a common edge is in one."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    frame = [(1, box(0.0, 0.0, 3.0, 1.0)), (2, box(0.0, 2.0, 3.0, 1.0)), (3, box(0.0, 1.0, 1.0, 1.0)), (4, box(2.0, 1.0, 1.0, 1.0))]
    at = [(10 * i + j, j * 0.5, i * 0.5) for i in range(7) for j in range(7)]
    want = sorted((i, z) for i, y, x in at for z, ring in frame if holds(ring, y, x))
    assert found(spark.createDataFrame(at, "id long, lat double, lng double"), spark.createDataFrame(frame, POLYGON)) == want
    assert len({i for i, _ in want}) == len(want) == 32


def test_twenty_thousand_zones(spark):
    """Zones that nobody broadcasts: arrow heads on a grid, each point compared with the zones around it."""
    head = [(0.0, 0.0), (0.008, 0.0), (0.004, 0.004), (0.008, 0.008), (0.0, 0.008)]
    corner = spark.range(20_000).selectExpr("id as zone_id", "(id % 200) * 0.01D as x", "(id div 200) * 0.01D as y")
    zones = corner.select("zone_id", F.array(*[F.struct((F.col("x") + a).alias("lng"), (F.col("y") + b).alias("lat")) for a, b in head]).alias("polygon"))
    at = [(i, (i * 37 % 9973) * 0.0001, (i * 91 % 19997) * 0.0001) for i in range(4000)]
    want = []
    for i, y, x in at:
        a, b = int(x / 0.01), int(y / 0.01)
        near = [(p, q) for p in range(a - 1, a + 2) for q in range(b - 1, b + 2) if 0 <= p < 200 and 0 <= q < 100]
        want += [(i, a + 200 * b) for a, b in near if holds([(a * 0.01 + p, b * 0.01 + q) for p, q in head], y, x)]
    points = spark.createDataFrame(at, "id long, lat double, lng double")
    assert found(points, zones) == sorted(want)
    plan = joins.join_zones(points, zones)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_rule_compares_all_points_with_all_zones(spark):
    for name in ("zone_point_in_polygon", "zone_entry_timer", "scenario_affected_events", "no_parking", "wrong_way", "illegal_u_turn", "red_light_asof", "speeding", "lane_violation", "zebra_crossing_jam_suppressed", "no_helmet", "overloading", "highway_stop"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
