"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from roadlark.schemas import INPUTS, STORED, schema
from roadlark.sources import readers, sinks
from roadlark.streaming import live


def test_schemas_parse(spark):
    for text in [*STORED.values(), *INPUTS.values()]:
        assert spark.createDataFrame([], text).count() == 0
    assert schema("a int").fieldNames() == ["a"]


def test_readers(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "000015.txt").write_text("2 0.5 0.5 0.1 0.2\nbroken line\n0 a b c d\n")
    rows = readers.read_labels(spark, str(tmp_path / "labels")).collect()
    assert [(r["frame_no"], r["class_id"], r["h"]) for r in rows] == [(15, 2, 0.2)]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": "z", "zone_type": "lane"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "zones.json").write_text(json.dumps(shape, indent=1))
    zone = readers.read_zones(spark, str(tmp_path / "zones.json")).first()
    assert zone["id"] == "z" and len(zone["polygon"]) == 3
    (tmp_path / "frames").mkdir()
    for n in (1, 5, 10):
        (tmp_path / "frames" / f"{n:06}.png").write_bytes(b"x")
    assert sorted(r["frame_no"] for r in readers.read_sim_frames(spark, str(tmp_path / "frames")).collect()) == [5, 10]
    api = spark.createDataFrame([("j", 1, None), ("j", 2, "RED")], "junction_id string, ts long, state string")
    seen = spark.createDataFrame([("j", 1, "GREEN"), ("j", 2, "GREEN")], "junction_id string, ts long, state string")
    assert {(r["ts"], r["state"]) for r in readers.signal_state(api, seen).collect()} == {(1, "GREEN"), (2, "RED")}
    assert readers.normalise(api, ["ts", "alt"], "live").columns == ["ts", "alt", "origin"]


def test_sinks(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "id string, x long")
    for _ in range(2):
        sinks.append_new(batch, f"{tmp_path}/t", "id")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    fresh = spark.createDataFrame([(1, 0.5, 2, 10, 20)], "anomaly_id long, severity double, n_dets long, first_seen long, last_seen long")
    sinks.upsert_table(fresh, f"{tmp_path}/u", 1)
    second = sinks.upsert_table(fresh.withColumn("last_seen", F.lit(30).cast("long")), f"{tmp_path}/u", 2).first()
    assert (second["n_dets"], second["last_seen"]) == (4, 30)
    report = spark.createDataFrame([(1, 17.0, 78.0)], "k long, lat double, lng double")
    sinks.export(report, f"{tmp_path}/g", "geojson")
    assert json.loads(spark.read.text(f"{tmp_path}/g").first()[0])["geometry"]["coordinates"] == [78.0, 17.0]
    with pytest.raises(ValueError):
        sinks.export(report, f"{tmp_path}/p", "pdf")
    assert sinks.payloads("session_status", spark.createDataFrame([("s", "active")], "session_id string, status string")).first()["event"] == "session_status"
    assert sinks.backoff() == [1, 2, 4, 8, 16, 30]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError

    assert sinks.write_with_retry(flaky, [0, 0, 0], sleep=lambda s: None) == 2


def run_stream(spark, tmp_path, name, rows, columns, build, mode="append"):
    src = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(src)
    stream = build(spark.readStream.schema(columns).parquet(src))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"select * from {name}").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    points = [(1, 1, float(t), t < 35) for t in range(50)] + [(2, 1, float(t), True) for t in range(31)]
    got = run_stream(spark, tmp_path, "runs", points, "track_id long, zone_id long, t double, holds boolean", lambda s: live.sustained_stream(s, 30.0))
    assert [(r["track_id"], r["started"], r["told_at"]) for r in got] == [(1, 0.0, 31.0)]
    times = [("speeding", f"2026-01-01 00:0{m}:00") for m in range(6)]
    got = run_stream(spark, tmp_path, "counters", times, "vtype string, ts string", lambda s: live.live_counters(live.with_event_time(s, "0 seconds")))
    assert sum(r["n"] for r in got) == 5  # the last window is still open
    tele = [("s", a, g) for a, g in ((100.0, 1), (115.0, 1), (100.0, 0))]
    got = run_stream(spark, tmp_path, "alerts", tele, "session_id string, alt double, gps_fix int", live.telemetry_alerts)
    assert len(got) == 2
    got = run_stream(spark, tmp_path, "positions", [(1, 1.0, 17.0, 78.0), (1, 2.0, 17.1, 78.0)], "track_id long, t double, lat double, lng double", lambda s: live.live_state(s, 3_600_000), "update")
    assert [(r["t"], r["expired"]) for r in got] == [(2.0, False)]


def test_replay_is_ordered_and_idempotent(spark, tmp_path):
    spark.createDataFrame([("b", 2), ("a", 1)], "id string, t long").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema("id string, t long").parquet(f"{tmp_path}/in")
        live.replay(stream, lambda b, n: sinks.append_new(b, f"{tmp_path}/out", "id"), f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
