"""Operators that need imperative logic per track or session; groups are bounded by a session's frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlark.session import ship


def kalman(points: DataFrame, keys: tuple[str, ...] = ("track_id",), t: str = "t", process: float = 1e-10, noise: float = 1e-9) -> DataFrame:
    """Constant-velocity smoothing: keys, t, lat, lng and the predicted next position."""
    ship(points.sparkSession)
    kinds = dict(points.dtypes)

    def smooth(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(t)
        out = frame[[*keys, t]].copy()
        times = frame[t].to_numpy(float)
        for c in ("lat", "lng"):
            x, p = np.array([frame[c].iloc[0], 0.0]), np.eye(2) * noise
            smooth_, ahead = [], []
            for k, z in enumerate(frame[c].to_numpy(float)):
                dt = times[k] - times[k - 1] if k else 0.0
                f = np.array([[1.0, dt], [0.0, 1.0]])
                x, p = f @ x, f @ p @ f.T + process * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
                gain = p[:, 0] / (p[0, 0] + noise)
                x, p = x + gain * (z - x[0]), p - np.outer(gain, p[0])
                smooth_.append(x[0])
                ahead.append(x[0] + x[1])
            out[c], out[f"next_{c}"] = smooth_, ahead
        return out

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, t)) + ", lat double, next_lat double, lng double, next_lng double"
    return points.select(*keys, t, "lat", "lng").groupBy(*keys).applyInPandas(smooth, schema)


def _ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by a monotone chain, counter-clockwise from the leftmost point."""
    pts = sorted(set(points))

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]


def hull(points: DataFrame, key: str = "cluster_id", parts: int = 32) -> DataFrame:
    """Convex hull of each group as array<struct<lng, lat>>.

    Hash parts of a group get their hulls first; the hull of these hulls is the group's, so a
    large group reaches no task whole.
    """
    ship(points.sparkSession)
    kind = dict(points.dtypes)[key]

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        ring = _ring(list(zip(frame["lng"], frame["lat"], strict=True)))
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(ring), "lng": [p[0] for p in ring], "lat": [p[1] for p in ring]})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        ring = _ring(list(zip(frame["lng"], frame["lat"], strict=True)))
        return pd.DataFrame({key: [frame[key].iloc[0]], "hull": [[{"lng": a, "lat": b} for a, b in ring]]})

    salted = points.select(key, "lng", "lat").withColumn("_part", F.pmod(F.xxhash64("lng", "lat"), F.lit(parts)))
    outer = salted.groupBy(key, "_part").applyInPandas(partial, f"{key} {kind}, lng double, lat double")
    return outer.groupBy(key).applyInPandas(whole, f"{key} {kind}, hull array<struct<lng:double,lat:double>>")


def assign_tracks(dets: DataFrame, least_iou: float = 0.3, forget_frames: int = 50) -> DataFrame:
    """Greedy frame-to-frame matching by box overlap: session_id, frame_no, det_id, assigned_track."""
    ship(dets.sparkSession)
    kinds = dict(dets.dtypes)

    def track(frame: pd.DataFrame) -> pd.DataFrame:
        live: dict[int, tuple[int, tuple]] = {}
        rows, fresh = [], 0
        for number, own in frame.sort_values(["frame_no", "det_id"]).groupby("frame_no"):
            boxes = [(d, (x1, y1, x2, y2)) for d, x1, y1, x2, y2 in own[["det_id", "x1", "y1", "x2", "y2"]].itertuples(index=False)]
            live = {k: v for k, v in live.items() if number - v[0] <= forget_frames}
            pairs = []
            for d, a in boxes:
                for k, (_, b) in live.items():
                    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
                    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
                    if union > 0 and w * h / union >= least_iou:
                        pairs.append((-w * h / union, d, k))
            taken_d, taken_k = {}, set()
            for _, d, k in sorted(pairs):
                if d not in taken_d and k not in taken_k:
                    taken_d[d] = k
                    taken_k.add(k)
            for d, a in boxes:
                if d not in taken_d:
                    fresh += 1
                    taken_d[d] = fresh
                live[taken_d[d]] = (number, a)
                rows.append((own["session_id"].iloc[0], number, d, taken_d[d]))
        return pd.DataFrame(rows, columns=["session_id", "frame_no", "det_id", "assigned_track"])

    flat = dets.select("session_id", "frame_no", "det_id", F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"), F.col("box.x2").alias("x2"), F.col("box.y2").alias("y2"))
    return flat.groupBy("session_id").applyInPandas(track, f"session_id {kinds['session_id']}, frame_no {kinds['frame_no']}, det_id {kinds['det_id']}, assigned_track long")


def robust_outliers(features: DataFrame, columns: tuple[str, ...], key: str, threshold: float = 3.5) -> DataFrame:
    """Isolation score without a model: the largest robust z-score of a row's features."""
    medians = features.agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns])
    away = features.crossJoin(F.broadcast(medians))  # one row
    spread = away.agg(*[F.percentile(F.abs(F.col(c) - F.col(f"_m_{c}")), F.lit(0.5)).alias(f"_s_{c}") for c in columns])
    scored = away.crossJoin(F.broadcast(spread))
    z = [F.when(F.col(f"_s_{c}") > 0, 0.6745 * F.abs(F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    return scored.select(key, score.alias("outlier_score")).withColumn("is_outlier", F.col("outlier_score") > threshold)
