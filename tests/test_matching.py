"""Streams matched with streams, against the same work in one batch."""

import random

import pandas as pd
from pyspark.sql import functions as F

from roadlark.functions import geo
from roadlark.operators import joins
from roadlark.streaming import matching

EVENTS = "event_id long, session_id long, vtype string, t double, lat double, lng double, confidence double, status string"


def test_last_state_of_late_and_tied_signals(spark):
    rng = random.Random(4)
    x = spark.createDataFrame([(i, rng.choice([1, 2, 3]), float(rng.randint(0, 900)), "note " + str(i)) for i in range(120)], "id long, zone_id long, t double, note string")
    s = spark.createDataFrame([(z, t + 0.5 * (z == 2), f"s{t}") for z in (1, 2) for t in rng.sample(range(900), 40)], "zone_id long, t double, state string")
    got = matching.replayed(spark, {"crossings": x, "signals": s}, lambda crossings, signals: matching.asof_stream(crossings, signals, "zone_id"), keys=["zone_id"])
    want = joins.asof(x, s, ["zone_id"])
    pick = lambda df: sorted((r["id"], r["zone_id"], r["t"], r["note"], r["state"]) for r in df.collect())
    assert str(pick(got)) == str(pick(want)) and got.count() == 120


def test_a_signal_within_the_watermark_counts_and_each_crossing_is_told_once(spark, tmp_path):
    """Rows come in several batches; a signal that is late but within the delay decides about a crossing told before it came in."""
    cross, sign = "id long, zone_id long, t double, ts timestamp", "zone_id long, t double, state string, ts timestamp"
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds("t"))
    def add(name, rows, columns, n):
        timed(spark.createDataFrame(rows, columns)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{n}")

    read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}").withWatermark("ts", "20 seconds")

    def drain():
        told = matching.asof_stream(read("x", cross), read("s", sign), "zone_id")
        with matching.stateful(spark):
            told.writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["id"], r["state"]) for r in spark.read.schema(told.schema).parquet(f"{tmp_path}/told").collect())

    add("x", [(1, 1, 100.0)], "id long, zone_id long, t double", 0)
    add("s", [(1, 50.0, "GREEN"), (1, 101.0, "GREEN")], "zone_id long, t double, state string", 0)
    assert drain() == []
    add("s", [(1, 95.0, "RED")], "zone_id long, t double, state string", 1)  # six seconds behind
    add("x", [(2, 1, 103.0)], "id long, zone_id long, t double", 1)
    assert drain() == []
    add("s", [(1, 500.0, "RED")], "zone_id long, t double, state string", 2)
    add("x", [(3, 1, 500.0)], "id long, zone_id long, t double", 2)
    assert drain() == [(1, "RED"), (2, "GREEN")]
    assert drain() == [(1, "RED"), (2, "GREEN")]


def test_doubles_between_sessions_over_cell_edges(spark):
    rng = random.Random(8)
    step = 1 / geo.METRES_PER_DEGREE
    rows = [(i, rng.randint(0, 2), rng.choice(["a", "b"]), rng.uniform(0, 60), rng.uniform(0, 60) * step, rng.uniform(0, 60) * step, rng.choice([0.5, 0.7, 0.9]), "flagged") for i in range(250)]
    rows += [(900, 0, "a", 70.0, 9.99999 * step, 0.0, 0.5, "flagged"), (901, 1, "a", 75.0, 10.00002 * step, 0.0, 0.5, "confirmed"), (902, 1, "a", 80.1, 10.0 * step, 0.0, 0.9, "flagged"), (903, 0, "a", 10.0, None, None, 0.5, "flagged")]
    events = spark.createDataFrame(rows, EVENTS)
    got = matching.replayed(spark, {"events": events}, lambda events: matching.cross_session_stream(events, most_lat=1.0))
    want = joins.keep_best(events, joins.cross_session_dups(events, most_lat=1.0))
    pick = lambda df: sorted((r["event_id"], r["session_id"], r["t"], r["status"]) for r in df.collect())
    assert pick(got) == pick(want)
    assert sum(r[3] == "duplicate" for r in pick(want)) > 40


class _State(list):
    exists = lambda self: bool(self)
    get = lambda self: iter(self)
    appendList = list.extend

    def put(self, rows):
        self[:] = rows


class _Value(list):
    exists = lambda self: bool(self)
    get = lambda self: self[0]

    def update(self, value):
        self[:] = [value]


class _Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.timers, self.set = set(), 0

    getListState = lambda self, name, schema: _State()
    getValueState = lambda self, name, schema: _Value()

    def registerTimer(self, ms):
        self.timers.add(ms)
        self.set += 1

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def _drain(processor, frame, ms):
    """What a key tells at the watermark, and how many timers it took."""
    handle = _Handle()
    processor.init(handle)
    list(processor.handleInputRows(("k",), iter([frame[:50], frame[50:]]), _Clock(0)))
    out = []
    while due := sorted(t for t in handle.timers if t <= ms):
        handle.timers.discard(due[0])
        out += list(processor.handleExpiredTimer(("k",), _Clock(ms), None))
    return pd.concat(out), handle


def test_a_key_waits_with_one_timer_for_all_its_crossings():
    n = 3000
    frame = pd.DataFrame({"side": [1, 0] * n, "t": [float(i) for i in range(2 * n)], "value": [None if i % 2 == 0 else f"s{i}" for i in range(2 * n)], "payload": [str(i) if i % 2 == 0 else None for i in range(2 * n)]})
    told, handle = _drain(matching._LastState(), frame, 4000 * 1000)
    assert dict(zip(told["payload"], told["value"], strict=True)) == {str(i): f"s{i - 1}" if i else None for i in range(0, 4000, 2)}
    assert handle.set <= 3 and handle.timers == {4000 * 1000 + 1}


def test_a_key_judges_all_its_events_at_one_timer():
    n = 3000
    frame = pd.DataFrame({"cell": "a", "at": [10.0 * (i // 2) for i in range(n)], "t": [10.0 * (i // 2) for i in range(n)], "id": range(n), "session": [str(i % 2) for i in range(n)], "lat": 0.0, "lng": 0.0, "confidence": 0.5, "payload": [str(i) for i in range(n)]})
    told, handle = _drain(matching._Duplicates(10.0, 5.0), frame, 10_000_000)
    assert {int(p): d for p, d in zip(told["payload"], told["duplicate"], strict=True)} == {i: i % 2 == 1 for i in range(2000)}
    assert handle.set <= 3 and len(handle.timers) == 1
