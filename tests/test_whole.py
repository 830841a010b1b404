"""Registered queries against brute force over whole tables: no share of the rows may be left out."""

import collections

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from roadlark.plans import catalog


def test_reid_reads_all_vectors(spark, tmp_path):
    ids = [*range(12), *range(195, 215), *range(5000, 5020)]
    vecs = np.random.default_rng(3).normal(size=(len(ids), 6)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": ids, "label": [0] * len(ids), "embedding": vecs.tolist()}), tmp_path / "embeddings.parquet")
    v = vecs.astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i, a in enumerate(ids):
        found = [(-float(unit[i] @ unit[j]), b) for j, b in enumerate(ids) if 1 <= b - a <= 5 and unit[i] @ unit[j] >= 0.1]
        if found:
            want[a] = (min(found)[1], round(-min(found)[0], 6))
    got = {r["track_id"]: (r["track_id_new"], r["similarity"]) for r in catalog.queries()["reid_cosine_match"](spark, str(tmp_path)).collect()}
    assert {k: b for k, (b, _) in got.items()} == {k: b for k, (b, _) in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert max(got) > 5000


def test_severity_trend_reads_all_detections(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 400
    cols = {c: rng.integers(1, m, n).tolist() for c, m in {"l_orderkey": 60, "l_linenumber": 4, "l_partkey": 40, "l_suppkey": 30}.items()}
    pq.write_table(pa.table(cols | {"l_discount": rng.integers(0, 11, n) / 100, "l_quantity": rng.integers(1, 51, n).astype(float)}), tmp_path / "lineitem.parquet")
    most = {}
    for order, line, part, supp, discount in zip(*cols.values(), pq.read_table(tmp_path / "lineitem.parquet")["l_discount"].to_pylist(), strict=True):
        key = (part % 4, supp % 23, order * 60 + line, order * 100 + line * 10 + part % 10)
        most[key] = max(most.get(key, 0), discount)
    frame = catalog.queries()["severity_trend"](spark, str(tmp_path))
    got = collections.Counter((r["det_id"], r["t"], r["zone_id"]) for r in frame.collect())
    assert got == collections.Counter((d, t, z) for _, z, t, d in most)
    # one row of each (type, zone) has no predecessor
    assert sum(r["severity_change"] is None for r in frame.collect()) == len({k[:2] for k in most})
    from roadlark.plans import roads

    severity = {(r["anomaly_type"], r["zone_id"], r["t"], r["det_id"]): r["s"] for r in roads.scored(spark, str(tmp_path)).groupBy("anomaly_type", "zone_id", "t", "det_id").agg({"severity": "max"}).withColumnRenamed("max(severity)", "s").collect()}
    rows = collections.defaultdict(list)
    for (kind, zone, t, det), s in severity.items():
        rows[kind, zone].append((t, s, det))
    want = []
    for (_, zone), own in rows.items():
        own.sort()
        want += [(det, t, zone, round(s - own[i - 1][1], 5) + 0.0 if i else None) for i, (t, s, det) in enumerate(own)]
    told = [(r["det_id"], r["t"], r["zone_id"], None if r["severity_change"] is None else round(r["severity_change"], 5) + 0.0) for r in frame.collect()]
    assert collections.Counter(told) == collections.Counter(want)


def test_zone_versions_read_all_events(spark, tmp_path):
    ids = list(range(600))
    pq.write_table(pa.table({"event_id": ids, "user_id": [i % 9 for i in ids]}), tmp_path / "events.parquet")
    rows = collections.defaultdict(list)
    for i in ids:
        h = i // 2
        rows[h * 7919 % 23].append((h * 60 + i % 2 * (h % 10), i))
    want = collections.Counter()
    for zone, own in rows.items():
        own.sort()
        want.update((zone, t, own[k + 1][0] if k + 1 < len(own) else None) for k, (t, _) in enumerate(own))
    got = collections.Counter(tuple(r) for r in catalog.queries()["zone_version_intervals"](spark, str(tmp_path)).collect())
    assert got == want


def test_rbac_zone_scope_reads_all_customers(spark, tmp_path):
    pq.write_table(pa.table({"event_id": range(100), "user_id": [0] * 100}), tmp_path / "events.parquet")
    pq.write_table(pa.table({"c_custkey": range(1, 101), "c_nationkey": [k % 25 for k in range(1, 101)]}), tmp_path / "customer.parquet")
    frame = catalog.queries()["rbac_zone_scope"](spark, str(tmp_path))
    assert {r["event_id"] for r in frame.collect()} == {i for i in range(100) if i // 2 * 7919 % 23 == 57 % 25 % 23}
    assert "% 50" not in frame._jdf.queryExecution().analyzed().toString()


def test_spearman_orders_in_buckets(spark):
    from roadlark.operators import metrics

    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, 3000)
    y = x * 50 + rng.integers(0, 3000, 3000)
    rank = lambda v: np.array([(np.searchsorted(np.sort(v), a) + np.searchsorted(np.sort(v), a, "right") + 1) / 2 for a in v])
    frame = metrics.spearman(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x long, y long"), "x", "y")
    got = frame.first()
    assert got["n"] == 3000 and abs(got["rho"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-9
    plan = frame._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(_b" in plan and "windowspecdefinition(x" not in plan and "windowspecdefinition(y" not in plan
    none = metrics.spearman(spark.createDataFrame([], "x long, y long"), "x", "y").first()
    assert none["n"] == 0 and none["rho"] is None
