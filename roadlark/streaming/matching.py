"""Streams matched with streams: the state at a crossing, and duplicates between sessions.

Both keep what they have seen in keyed state and answer at the watermark, so that late rows count
as long as the watermark lets them in, and each row is answered once. They need the RocksDB
state store: ``stateful`` sets it. ``ts`` is event time, a timestamp with a watermark; a row that is
not after the watermark is late, and so is one at the epoch, where watermarks begin.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadlark.config import DUPLICATE_M, DUPLICATE_S, EARTH_M
from roadlark.functions import geo
from roadlark.session import shared_folder, ship

#: Seconds from the epoch to time 0 of a replay.
LATER = 86_400
#: Keys that the cells of ``cross_session_stream`` are dealt to, and what a key keeps of an event.
STATE_KEYS = 512
NEAR = ["cell", "at", "t", "id", "session", "lat", "lng", "confidence", "payload"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams started inside use the state store that timers and lists need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _after(t: np.ndarray) -> np.ndarray:
    """The first millisecond after ``t``."""
    return np.floor(np.asarray(t, float) * 1000) + 1


def _packed(frame: pd.DataFrame) -> list[tuple[bytes]]:
    """``frame`` as one value of a list state, none where it is empty: a state of many rows is then one message and not one a row."""
    if frame.empty:
        return []
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return [(sink.getvalue().to_pybytes(),)]


class _Alarm:
    """One timer a key, at the next time that something is due; one a row would read the whole state for each row."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("alarm", "ms long")

    def bring_forward(self, ms: float) -> None:
        known = self.at.get() if self.at.exists() else None
        if known is None or ms < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self._set(ms)

    def rang(self, following: float | None) -> None:
        """The timer has gone off; the ``following`` one, if anything is left."""
        self.at.clear() if following is None else self._set(following)

    def _set(self, ms: float) -> None:
        self.at.update((int(ms),))
        self.handle.registerTimer(int(ms))


class _LastState(StatefulProcessor):
    """Signals of a key by time, and crossings that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.signals, self.waiting, self.alarm = handle.getListState("signals", "rows binary"), handle.getListState("waiting", "rows binary"), _Alarm(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        crossing = frame["side"] == 1
        for state, own in ((self.waiting, frame.loc[crossing, ["t", "payload"]]), (self.signals, frame.loc[~crossing, ["t", "value"]])):
            if packed := _packed(own):
                state.appendList(packed)
        if crossing.any():
            self.alarm.bring_forward(_after(frame.loc[crossing, "t"]).min())
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = _kept(self.waiting, ["t", "payload"])
        due = _after(waiting["t"]) <= now
        signals = _kept(self.signals, ["t", "value"]).sort_values(["t", "value"], kind="stable", ignore_index=True)
        times = signals["t"].to_numpy(float)
        at = np.searchsorted(times, waiting.loc[due, "t"].to_numpy(float), "right") - 1
        # what comes later than the watermark, and the last state before it, are still asked for
        first = max(0, int(np.searchsorted(times, now / 1000.0, "right")) - 1)
        _keep(self.signals, signals.iloc[first:])
        rest = waiting[~due]
        _keep(self.waiting, rest)
        self.alarm.rang(None if rest.empty else _after(rest["t"]).min())
        if due.any():
            value = np.append(signals["value"].to_numpy(object), None)  # place -1: no state yet
            yield pd.DataFrame({"payload": waiting.loc[due, "payload"].to_numpy(object), "value": value[at]})

    def close(self) -> None:
        pass


def _kept(state: Any, columns: list[str]) -> pd.DataFrame:
    """All rows of a list state of packed frames."""
    frames = [pa.ipc.open_stream(bytes(r[0])).read_pandas() for r in state.get()] if state.exists() else []
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in columns})


def _keep(state: Any, frame: pd.DataFrame) -> None:
    state.clear() if frame.empty else state.put(_packed(frame))


def asof_stream(left: DataFrame, right: DataFrame, key: str, value: str = "state") -> DataFrame:
    """Each row of the stream ``left`` with the last ``value`` of ``right`` at or before its ``ts``, once the watermark has passed it.

    Both have ``key`` (a number or text) and ts; the slower one's watermark rules.
    """
    ship(left.sparkSession)
    nothing = F.lit(None).cast("string")
    a = left.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("side"), _event_time().alias("t"), "ts", nothing.alias("value"), F.to_json(F.struct(*left.columns)).alias("payload"))
    b = right.select(F.col(key).cast("string").alias("key"), F.lit(0).alias("side"), _event_time().alias("t"), "ts", F.col(value).cast("string").alias("value"), nothing.alias("payload"))
    found = a.union(b).groupBy("key").transformWithStateInPandas(_LastState(), "payload string, value string", "append", "eventtime")
    return _unpacked(found, left, F.col("value").cast(dict(right.dtypes)[value]).alias(value))


def _event_time() -> Column:
    """Seconds of ts, on the clock of the watermark."""
    return F.unix_micros("ts") / 1e6


def _unpacked(found: DataFrame, stream: DataFrame, *more: Column) -> DataFrame:
    row = F.from_json("payload", stream.schema)
    return found.select(*[row[c].alias(c) for c in stream.columns], *more)


class _Duplicates(StatefulProcessor):
    """Events in and around some cells; each event of a cell is judged when all that may be its double has come."""

    def __init__(self, metres: float, seconds: float):
        self.metres, self.seconds = metres, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near, self.alarm = handle.getListState("near", "rows binary"), _Alarm(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))[NEAR]
        self.near.appendList(_packed(frame))
        self.alarm.bring_forward(self._next(frame))
        yield from ()

    def _next(self, near: pd.DataFrame) -> float:
        """When the first event is due; visitors from cells beside (without payload) and judged ones go when nobody can meet them any more."""
        own = near["payload"].notna()
        return _after(near.loc[own, "at"] + self.seconds).min() if own.any() else _after(near["at"] + 2 * self.seconds).max()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        near = _kept(self.near, NEAR)
        due = near["payload"].notna() & (_after(near["at"] + self.seconds) <= now)
        told = pd.DataFrame({"payload": near["payload"], "duplicate": self._beaten(near)})[due]
        # judged ones stay as visitors for those that are not
        left = near["payload"].notna() & ~due | (_after(near["at"] + 2 * self.seconds) > now)
        near["payload"] = near["payload"].astype(object).where(~due, None)
        rest = near[left]
        _keep(self.near, rest)
        self.alarm.rang(None if rest.empty else self._next(rest))
        if len(told):
            yield told

    def _beaten(self, near: pd.DataFrame) -> np.ndarray:
        """Whether another session's event of the cell within reach has more confidence (ties: the smaller id).

        In the order of (cell, time) each row meets the first, second, ... one behind it, as long as any pair is near in time.
        """
        cell, t = pd.factorize(near["cell"])[0], near["t"].to_numpy(float)
        order = np.lexsort((t, cell))
        cell, t = cell[order], t[order]
        lat, lng, sure = (near[c].to_numpy(float)[order] for c in ("lat", "lng", "confidence"))
        number, session = near["id"].to_numpy(np.int64)[order], pd.factorize(near["session"], use_na_sentinel=False)[0][order]
        beaten, i, step = np.zeros(len(near), bool), np.arange(len(near)), 0
        while len(i):
            step += 1
            i = i[i + step < len(near)]
            i = i[(cell[i] == cell[i + step]) & (t[i + step] - t[i] <= self.seconds)]
            j = i + step
            met = (session[i] != session[j]) & (_metres(lat[i], lng[i], lat[j], lng[j]) <= self.metres)
            a, b = i[met], j[met]
            beaten[a[(sure[b] > sure[a]) | ((sure[b] == sure[a]) & (number[b] < number[a]))]] = True
            beaten[b[(sure[a] > sure[b]) | ((sure[a] == sure[b]) & (number[a] < number[b]))]] = True
        out = np.empty(len(near), bool)
        out[order] = beaten
        return out

    def close(self) -> None:
        pass


def _metres(lat_a: np.ndarray, lng_a: np.ndarray, lat_b: np.ndarray, lng_b: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lng_b - lng_a) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def cross_session_stream(events: DataFrame, metres: float = DUPLICATE_M, seconds: float = DUPLICATE_S, most_lat: float = 89.0) -> DataFrame:
    """``events`` with status ``duplicate`` where another session saw one of the type within reach with more confidence (ties: the smaller id).

    Cells are ten times as wide as the reach. Each event goes to its cell and, as a visitor, to those that its reach touches,
    three at most, so that no pair is split at an edge; it is told ``seconds`` after its time has passed the watermark.
    Cells are dealt to STATE_KEYS keys by hash, since each key costs calls of its own in every batch, however few rows it has.
    """
    ship(events.sparkSession)
    dlat = metres / geo.METRES_PER_DEGREE * 1.0002
    dlng = dlat / max(1e-6, math.cos(math.radians(min(most_lat, 89.9))))
    place = lambda i, j: F.struct(*[c.alias(n) for n, c in zip("ab", geo.cell(F.col("lat") + i * dlat, F.col("lng") + j * dlng, 10 * metres, most_lat), strict=True)])
    home = place(0, 0)
    around = F.array_distinct(F.array(home, *[place(i, j) for i in (-1, 1) for j in (-1, 1)]))
    spread = events.withColumn("_c", F.explode(around))
    payload = F.when(F.col("_c").eqNullSafe(home), F.to_json(F.struct(*events.columns)))
    cell = F.concat_ws("|", "vtype", "_c.a", "_c.b")
    key = F.pmod(F.xxhash64(cell), F.lit(STATE_KEYS)).alias("key")
    slim = spread.select(key, cell.alias("cell"), _event_time().alias("at"), F.col("t").cast("double").alias("t"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("id"), F.col("session_id").cast("string").alias("session"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("confidence").cast("double").alias("confidence"), payload.alias("payload"), "ts")
    found = slim.groupBy("key").transformWithStateInPandas(_Duplicates(metres, seconds), "payload string, duplicate boolean", "append", "eventtime")
    row = F.from_json("payload", events.schema)
    status = F.when(F.col("duplicate"), "duplicate").otherwise(row["status"]).alias("status")
    return found.select(*[status if c == "status" else row[c].alias(c) for c in events.columns])


def replayed(spark: SparkSession, tables: dict[str, DataFrame], build, *, delay: str = "60 seconds", flush_s: float = 86_400.0, keys: Sequence[str] = (), told_by: str | None = "t") -> DataFrame:
    """What the stream that ``build`` makes of the tables' streams has told when all their rows are through.

    Every table (with t, in seconds) is written to the shared folder and read as a stream with a
    watermark on ts, LATER seconds after t, since time 0 counts as late; one row ``flush_s`` after the last one, null but for its time and ``keys`` (-1), lets the watermark pass the others. ``told_by`` is the column by which that row is known among the results;
    None where a window of its own, still open, keeps it back.
    """
    root = f"{shared_folder(spark)}/roadlark-replay-{uuid.uuid4().hex}"
    streams = {}
    last = max((frame.agg(F.max("t")).first()[0] or 0 for frame in tables.values()), default=0) + flush_s
    for name, frame in tables.items():
        end = spark.range(1).select(*[F.lit(last if c == "t" else -1 if c in keys else None).cast(kind).alias(c) for c, kind in frame.dtypes])
        timed = frame.unionByName(end).withColumn("ts", F.timestamp_micros(F.round((F.col("t") + LATER) * 1e6).cast("long")))
        timed.write.parquet(f"{root}/{name}")
        streams[name] = spark.readStream.schema(timed.schema).parquet(f"{root}/{name}").withWatermark("ts", delay)
    told = build(**streams)
    with stateful(spark):
        query = told.writeStream.format("parquet").option("path", f"{root}/told").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema(told.schema).parquet(f"{root}/told")
    return found if told_by is None else found.where(F.col(told_by) < last)
