"""Tracking by assignment, and upserts by bucket."""

import itertools
import os

import numpy as np
import pytest

from roadlark.operators import assignment, tracking
from roadlark.sources import sinks

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_assignments_are_optimal():
    rng = np.random.default_rng(3)
    for rows, columns in itertools.product(range(1, 6), range(1, 7)):
        for _ in range(6):
            cost = rng.integers(0, 9, (rows, columns)).astype(float)
            got = assignment.assign(cost)
            used = [(i, j) for i, j in enumerate(got.tolist()) if j >= 0]
            assert len(used) == len({j for _, j in used}) == min(rows, columns)
            few, many = (cost, columns) if rows <= columns else (cost.T, rows)
            best = min(sum(few[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(many), len(few)))
            assert sum(cost[i, j] for i, j in used) == best


def crossing(frames, looks=False):
    """Two boxes that drive through each other; (frame, det, box, truth)."""
    for f in frames:
        for k, x in ((0, 4.0 * f), (1, 81.0 - 4.0 * f)):
            yield f, 10 * f + k, (x, 0.0, x + 30, 20.0), k


def swaps(rows, truth):
    last, n = {}, 0
    for r in sorted(rows, key=lambda r: r["frame_no"]):
        k = truth[r["det_id"]]
        n += k in last and last[k] != r["assigned_track"]
        last[k] = r["assigned_track"]
    return n


def test_crossing_tracks_do_not_swap(spark):
    own = list(crossing(range(21)))
    truth = {d: k for _, d, _, k in own}
    dets = spark.createDataFrame([("s", f, d, b) for f, d, b, _ in own], f"session_id string, frame_no int, det_id long, box {BOX}")
    assert swaps(assignment.assign_tracks(dets).collect(), truth) == 0
    assert swaps(tracking.assign_tracks(dets).collect(), truth) > 0


def test_appearance_decides_where_boxes_do_not(spark):
    """Two standing boxes exchange places within one step; only their looks tell them apart."""
    rows = [("s", f, 10 * f + k, (6.0 * (k if f < 5 else 1 - k), 0.0, 6.0 * (k if f < 5 else 1 - k) + 20, 20.0), [1.0, 0.0] if k else [0.0, 1.0]) for f in range(10) for k in (0, 1)]
    dets = spark.createDataFrame(rows, f"session_id string, frame_no int, det_id long, box {BOX}, vec array<double>")
    truth = {d: d % 10 for _, _, d, _, _ in rows}
    assert swaps(assignment.assign_tracks(dets, look_share=0.8).collect(), truth) == 0
    assert swaps(assignment.assign_tracks(dets.drop("vec")).collect(), truth) > 0


def test_a_lost_track_does_not_take_a_passing_vehicle(spark):
    """A track seen once waits exactly where another vehicle drives later; that vehicle's own track expects it there too."""
    waits = [(0, 0, (40.0, 0.0, 65.0, 12.0), 0)]
    drives = [(f, 10 + f, (160.0 - 3 * f, 0.0, 185.0 - 3 * f, 12.0), 1) for f in range(48) if f % 5 != 1]
    assert (40, 50, waits[0][2], 1) in drives
    truth = {d: k for _, d, _, k in waits + drives}
    dets = spark.createDataFrame([("s", f, d, b) for f, d, b, _ in waits + drives], f"session_id string, frame_no int, det_id long, box {BOX}")
    got = assignment.assign_tracks(dets).collect()
    assert len(got) == len(truth) and swaps(got, truth) == 0 and len({r["assigned_track"] for r in got}) == 2


@pytest.mark.parametrize("chunk", [10, 1000])
def test_chunks_are_stitched(spark, chunk):
    """Long tracks keep one name over many chunks, through gaps, and two sessions never share one."""
    own = [(s, f, 100000 * s + 10 * f + k, (2.0 * f + 200 * k, 0.0, 2.0 * f + 200 * k + 30, 20.0)) for s in (0, 1) for f in range(95) for k in range(3) if f % 9 != 4]
    dets = spark.createDataFrame([*own, (0, 3, 77, None)], f"session_id long, frame_no int, det_id long, box {BOX}")
    got = {r["det_id"]: r["assigned_track"] for r in assignment.assign_tracks(dets, chunk_frames=chunk, shared_frames=4).collect()}
    assert len(got) == len(own) and len(set(got.values())) == 6
    assert all(len({got[d] for s, _, d, _ in own if (s, d % 10) == key}) == 1 for key in itertools.product((0, 1), range(3)))
    assert assignment.assign_tracks(dets.limit(0)).count() == 0


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    rows = lambda ids, last: spark.createDataFrame([(i, 0.5, 1, 10, last) for i in ids], "anomaly_id long, severity double, n_dets long, first_seen long, last_seen long")
    state = lambda df: {r["anomaly_id"]: (r["n_dets"], r["last_seen"]) for r in df.collect()}
    first = sinks.upsert_table(rows(range(500), 20), path, 1)
    assert state(first) == {i: (1, 20) for i in range(500)}
    before = files(path)
    second = sinks.upsert_table(rows([3, 4, 900], 30), path, 2)
    want = {i: (1, 20) for i in range(500)} | {3: (2, 30), 4: (2, 30), 900: (1, 30)}
    assert state(second) == want
    added = files(path) - before
    assert before <= files(path) and 1 <= len(added) <= 3
    # a reader of the first version still sees all of it, and a replay adds nothing
    assert state(sinks.read_table(spark, path, 1)) == {i: (1, 20) for i in range(500)}
    assert state(sinks.upsert_table(rows([3, 4, 900], 30), path, 2)) == want and files(path) == before | added
    # an attempt that fails before the version appears leaves the table as it was
    real = sinks._text
    def broken(spark, place, write=None):
        if write is not None:
            raise OSError
        return real(spark, place)

    monkeypatch.setattr(sinks, "_text", broken)
    with pytest.raises(OSError):
        sinks.upsert_table(rows([5], 40), path, 3)
    monkeypatch.setattr(sinks, "_text", real)
    assert sinks.table_version(spark, path, 3) is None and state(sinks.read_table(spark, path, 2)) == want
    assert state(sinks.upsert_table(rows([5], 40), path, 3)) == want | {5: (2, 40)}
    assert state(sinks.upsert_table(rows([], 0), path, 4)) == want | {5: (2, 40)}
