"""Tracking by assignment: detections of a frame go to tracks at the least total cost.

A track moves on with its last velocity; the cost of a detection is how little it overlaps the box
that is expected, and how little its appearance resembles the track's, where both have one. Each frame's costs
are assigned optimally, so that two crossing tracks do not swap because one of them chose first. Of two tracks
that cost the same the one seen last is taken: one that was lost waits in the way of others.

A session is cut in chunks of ``chunk_frames`` frames that share ``shared_frames`` with the next one, and each
chunk is tracked by a task of its own. Tracks of neighbouring chunks that hold the same detections in
the shared frames are one: the pairs that share most, each track once, are linked, and chains of links are the tracks.

Defined cases: detections without a box are left out; of repeated det_ids in a frame each is a detection; an
appearance that is null, of another length than the track's or all zeros counts as unknown; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.operators.clustering import connected
from roadlark.session import checkpointed, ship

#: A cost that no allowed pair has.
NEVER = 1e6
#: Cost of each frame for which a track was not seen. It decides ties only, and is far above what sums of NEVER lose in doubles.
UNSEEN = 1e-6


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1 for none) at the least total cost, by shortest augmenting paths; rows may outnumber columns."""
    if cost.shape[0] > cost.shape[1]:
        out = np.full(cost.shape[0], -1)
        back = assign(cost.T)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    rows, columns = cost.shape
    owner, pay, price = np.full(columns, -1), np.zeros(rows), np.zeros(columns)
    for start in range(rows):
        least, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, at, far = start, -1, 0.0
        while True:
            step = far + cost[row] - pay[row] - price
            better = ~done & (step < least)
            least[better], came[better] = step[better], at
            at = int(np.argmin(np.where(done, np.inf, least)))
            far = least[at]
            done[at] = True
            if owner[at] < 0:
                break
            row = owner[at]
        # rows on the way pay what the path is longer than their own step
        taken = done & (owner >= 0)
        pay[owner[taken]] += far - least[taken]
        pay[start] += far
        price[done] += least[done] - far
        while at >= 0:
            before = came[at]
            owner[at] = start if before < 0 else owner[before]
            at = before
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of ``a`` with each of ``b``."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inner = np.clip(high - low, 0, None).prod(2)
    area = lambda x: (x[:, 2:] - x[:, :2]).prod(1)
    union = area(a)[:, None] + area(b)[None] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)


@dataclass
class Track:
    number: int
    frame: int
    box: np.ndarray
    speed: np.ndarray
    look: np.ndarray | None

    def expected(self, frame: int) -> np.ndarray:
        return self.box + np.tile(self.speed, 2) * (frame - self.frame)


def _unit(vec) -> np.ndarray | None:
    if vec is None:
        return None
    x = np.asarray(vec, float)
    size = np.linalg.norm(x) if len(x) and np.isfinite(x).all() else 0.0
    return x / size if size > 0 else None


def track_frames(frames: list[tuple[int, np.ndarray, list]], *, least_iou: float, forget_frames: int, look_share: float) -> list[np.ndarray]:
    """Track number of each detection of the frames (number, boxes, appearances), in order."""
    live: list[Track] = []
    fresh, out = 0, []
    for number, boxes, looks in frames:
        live = [t for t in live if number - t.frame <= forget_frames]
        found = np.full(len(boxes), -1)
        if live and len(boxes):
            near = overlaps(np.array([t.expected(number) for t in live]), boxes)
            cost = np.where(near >= least_iou, 1.0 - near, NEVER)
            for i, t in enumerate(live):
                for j, look in enumerate(looks):
                    if near[i, j] >= least_iou and t.look is not None and look is not None and len(look) == len(t.look):
                        cost[i, j] = (1 - look_share) * cost[i, j] + look_share * (1.0 - float(t.look @ look))
            cost += UNSEEN * (number - np.array([t.frame for t in live]))[:, None]
            for i, j in enumerate(assign(cost)):
                if j >= 0 and cost[i, j] < NEVER:
                    found[j] = i
        for j, i in enumerate(found.tolist()):
            middle = boxes[j].reshape(2, 2).mean(0)
            if i < 0:
                live.append(Track(fresh, number, boxes[j], np.zeros(2), looks[j]))
                found[j], fresh = fresh, fresh + 1
                continue
            t = live[i]
            t.speed = (middle - t.box.reshape(2, 2).mean(0)) / max(1, number - t.frame)
            t.frame, t.box, t.look = number, boxes[j], looks[j] if looks[j] is not None else t.look
            found[j] = t.number
        out.append(found)
    return out


def assign_tracks(dets: DataFrame, *, least_iou: float = 0.1, forget_frames: int = 50, look_share: float = 0.4, chunk_frames: int = 1000, shared_frames: int = 25) -> DataFrame:
    """session_id, frame_no, det_id, assigned_track (a text, the same for all detections of a track).

    ``dets`` has session_id, frame_no, det_id, box and, if there is one, an appearance ``vec``.
    """
    ship(dets.sparkSession)
    kinds = dict(dets.dtypes)
    look = F.col("vec").cast("array<double>") if "vec" in kinds else F.lit(None).cast("array<double>")
    chunk = F.floor(F.col("frame_no") / chunk_frames)
    # the first frames of a chunk are also the last ones of the chunk before
    early = (F.col("frame_no") - chunk * chunk_frames < shared_frames) & (chunk > 0)
    flat = dets.where("box is not null").select("session_id", "frame_no", "det_id", *[F.col(f"box.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], look.alias("vec"))
    flat = flat.withColumn("chunk", F.explode(F.when(early, F.array(chunk - 1, chunk)).otherwise(F.array(chunk))))

    def track(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["frame_no", "det_id", "x1", "y1"], kind="stable")
        boxes, numbers = frame[["x1", "y1", "x2", "y2"]].to_numpy(), frame["frame_no"].to_numpy()
        looks = [_unit(v) for v in frame["vec"]]
        cuts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True])
        own = [(int(numbers[a]), boxes[a:b], looks[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = track_frames(own, least_iou=least_iou, forget_frames=forget_frames, look_share=look_share)
        return frame[["session_id", "frame_no", "det_id", "chunk"]].assign(number=np.concatenate(found))

    local = flat.groupBy("session_id", "chunk").applyInPandas(track, f"session_id {kinds['session_id']}, frame_no {kinds['frame_no']}, det_id {kinds['det_id']}, chunk long, number long")
    local = checkpointed(local.withColumn("track", F.concat_ws("|", "session_id", "chunk", "number")))
    ahead = F.col("chunk") < F.floor(F.col("frame_no") / chunk_frames)
    a = local.where(ahead).select("session_id", "frame_no", "det_id", F.col("track").alias("a"))
    b = local.where(~ahead).select("session_id", "frame_no", "det_id", F.col("track").alias("b"))
    shared = a.join(b, ["session_id", "frame_no", "det_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    rank = lambda c, other: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("n"), other))
    links = shared.withColumns({"_a": rank("a", "b"), "_b": rank("b", "a")}).where("_a = 1 and _b = 1").select("a", "b")
    whole = connected(links)
    named = local.where(~ahead).join(whole.select(F.col("node").alias("track"), "component"), "track", "left")
    return named.select("session_id", "frame_no", "det_id", F.coalesce("component", "track").alias("assigned_track"))
