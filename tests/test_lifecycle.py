"""Lifecycles against a plain loop."""

import random

from roadlark.operators import lifecycle


def test_changes_as_the_lifecycle_allows(spark):
    rng = random.Random(2)
    states = ["flagged", "reviewed", "work_order_issued", "repaired", "nonsense", None]
    table = [(i, rng.choice(["flagged", "reviewed", None])) for i in range(60)]
    changes = [(rng.randint(0, 70), rng.randint(0, 5), rng.choice(states)) for _ in range(300)]
    got = {r["anomaly_id"]: (r["status"], r["n_applied"], r["n_refused"]) for r in lifecycle.maintain(spark.createDataFrame(table, "anomaly_id long, status string"), spark.createDataFrame(changes, "anomaly_id long, t long, status string")).collect()}
    for key, status in table:
        now, applied, refused = status or "flagged", 0, 0
        for _, to in sorted((t, to) for k, t, to in changes if k == key and to):
            if (now, to) in lifecycle.ANOMALY:
                now, applied = to, applied + 1
            elif to != now:
                refused += 1
        assert got[key] == (now, applied, refused)


def test_a_recommendation_is_decided_once(spark):
    table = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, None)], "recommendation_id long, status string")
    said = spark.createDataFrame([(1, 5, "rejected"), (1, 3, "accepted"), (2, 1, "reviewed"), (2, 2, "rejected"), (9, 1, "accepted")], "recommendation_id long, t long, status string")
    got = {r["recommendation_id"]: (r["status"], r["n_applied"], r["n_refused"]) for r in lifecycle.decide(table, said).collect()}
    assert got == {1: ("accepted", 1, 1), 2: ("rejected", 2, 0), 3: ("pending", 0, 0)}
    assert lifecycle.decide(table.limit(0), said).count() == 0 and lifecycle.decide(table, said.limit(0)).where("status = 'pending'").count() == 3
