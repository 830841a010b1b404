"""Streams: watermarks, windows, keyed state for runs and live values, replay.

Event time must be a TIMESTAMP; ``with_event_time`` casts other types. Windows that are still
open at the last watermark are not emitted in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadlark.config import ABORT_S, OCCLUSION_S
from roadlark.functions.scores import altitude_status
from roadlark.session import ship


def with_event_time(df: DataFrame, delay: str = "60 seconds", ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def live_counters(df: DataFrame, width: str = "1 minute", keys: tuple[str, ...] = ("vtype",), ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_confidence(df: DataFrame, width: str = "30 seconds", step: str = "10 seconds", key: str = "session_id", ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, width, step), key).agg(F.avg("confidence").alias("mean_confidence")).select(F.col("window.start").alias("start"), key, "mean_confidence")


def track_sessions(points: DataFrame, gap: str = f"{OCCLUSION_S} seconds", ts: str = "ts") -> DataFrame:
    """One row when a track is lost: its session window has closed."""
    return points.groupBy(F.session_window(ts, gap), "track_id").agg(F.count("*").alias("n")).select("track_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("lost_at"), "n")


def dedup_stream(events: DataFrame, cell_deg: float = 0.0001, bucket: str = "5 seconds", ts: str = "ts") -> DataFrame:
    """First event of each type, cell and time bucket within the watermark."""
    keyed = events.withColumns({"_a": F.floor(F.col("lat") / cell_deg), "_b": F.floor(F.col("lng") / cell_deg), "_w": F.window(ts, bucket)["start"]})
    return keyed.dropDuplicatesWithinWatermark(["vtype", "_a", "_b", "_w"]).drop("_a", "_b", "_w")


def telemetry_alerts(telemetry: DataFrame) -> DataFrame:
    status = altitude_status(F.col("alt"))
    return telemetry.withColumn("altitude_status", status).where((F.col("altitude_status") != "ok") | (F.col("gps_fix") == 0))


def signal_stream(points: DataFrame, signals: DataFrame, within: str = "60 seconds") -> DataFrame:
    """Crossings with the states the signal took in the ``within`` before them (interval join of two streams)."""
    on = F.expr(f"p.zone_id = s.zone_id and s.ts <= p.ts and s.ts >= p.ts - interval {within}")
    return points.alias("p").join(signals.alias("s"), on)


def sustained_stream(points: DataFrame, seconds: float, occlusion_s: float = OCCLUSION_S) -> DataFrame:
    """One event for each run of ``holds`` longer than ``seconds`` for a (track_id, zone_id).

    State per key is three numbers: the run's start, its last row, and whether it was told.
    Points have track_id, zone_id, t (seconds) and holds; rows of one key may come in any order
    within a batch.
    """
    ship(points.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, last, told = state.get if state.exists else (-1.0, -1.0, False)
        out = []
        for t, holds in sorted((float(t), bool(h)) for f in frames for t, h in zip(f["t"], f["holds"], strict=True)):
            if not holds or (last >= 0 and t - last > occlusion_s):
                start, told = -1.0, False
            if holds:
                start = t if start < 0 else start
                if t - start > seconds and not told:
                    told = True
                    out.append((key[0], key[1], start, t))
            last = t
        state.update((start, last, told))
        state.setTimeoutDuration(600_000)
        yield pd.DataFrame(out, columns=["track_id", "zone_id", "started", "told_at"])

    return points.groupBy("track_id", "zone_id").applyInPandasWithState(step, "track_id long, zone_id long, started double, told_at double", "start double, last double, told boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_state(points: DataFrame, ttl_ms: int, columns: str = "track_id long, t double, lat double, lng double") -> DataFrame:
    """Latest position of each track; a track that is silent for its time to live is told as expired."""
    ship(points.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            t, lat, lng = state.get
            state.remove()
            yield pd.DataFrame([(key[0], t, lat, lng, True)], columns=["track_id", "t", "lat", "lng", "expired"])
            return
        best = state.get if state.exists else (-1.0, 0.0, 0.0)
        for f in frames:
            for t, lat, lng in zip(f["t"], f["lat"], f["lng"], strict=True):
                best = max(best, (float(t), float(lat), float(lng)))
        state.update(best)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], *best, False)], columns=["track_id", "t", "lat", "lng", "expired"])

    return points.groupBy("track_id").applyInPandasWithState(step, columns + ", expired boolean", "t double, lat double, lng double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_monitor(beats: DataFrame, abort_s: int = ABORT_S) -> DataFrame:
    """``active`` at each heartbeat, ``aborted`` after a silence."""
    ship(beats.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "aborted")], columns=["session_id", "status"])
            return
        state.update((sum(len(f) for f in frames),))
        state.setTimeoutDuration(abort_s * 1000)
        yield pd.DataFrame([(key[0], "active")], columns=["session_id", "status"])

    return beats.groupBy("session_id").applyInPandasWithState(step, "session_id string, status string", "beats long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def recurrence_stream(dets: DataFrame, cell_deg: float = 0.00003) -> DataFrame:
    """Detections so far of each type and cell; needs update or complete mode."""
    keys = [F.floor(F.col("lat") / cell_deg).alias("cell_lat"), F.floor(F.col("lng") / cell_deg).alias("cell_lng")]
    return dets.groupBy("anomaly_type", *keys).agg(F.count("*").alias("n_dets"), F.max("severity").alias("worst"))


def replay(stream: DataFrame, sink, checkpoint: str, *, order: tuple[str, ...] = ("t",)):
    """Drains what a source has buffered, in order within each batch; ``sink(batch, number)`` must be idempotent."""
    flush = lambda batch, number: sink(batch.orderBy(*order), number)
    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dynamic_zones(stream: DataFrame, read_zones, handle, checkpoint: str):
    """Joins each batch with the zones as they are then, so that a saved zone counts at once."""
    from roadlark.operators.joins import join_zones

    def each(batch: DataFrame, number: int) -> None:
        handle(join_zones(batch, read_zones()), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(stream: DataFrame, sink: str, checkpoint: str, *, trigger: str = "100 milliseconds", mode: str = "append", **options: str):
    """Starts a stream at the push cadence; micro-batches make it a floor, not a promise."""
    return stream.writeStream.format(sink).options(**options).outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def fan_out(streams: dict[str, DataFrame], handle, checkpoint: str) -> list:
    """One query for each push event; ``handle(batch, number)`` gets JSON payloads."""
    from roadlark.sources.sinks import payloads

    return [payloads(kind, rows).writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/{kind}").trigger(availableNow=True).start() for kind, rows in streams.items()]
