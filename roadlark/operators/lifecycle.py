"""Status changes of events, anomalies and recommendations, as their lifecycles allow them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may follow what. A recommendation is decided once; an anomaly that comes back after repair is flagged anew.
RECOMMENDATION = (("pending", "reviewed"), ("pending", "accepted"), ("pending", "rejected"), ("reviewed", "accepted"), ("reviewed", "rejected"))
ANOMALY = (("flagged", "reviewed"), ("reviewed", "work_order_issued"), ("work_order_issued", "repaired"), ("repaired", "flagged"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str, allowed: Sequence[tuple[str, str]], start: str) -> DataFrame:
    """``table`` (key, status) after ``changes`` (key, t, status, and a role or user if wanted), with n_applied and n_refused.

    The changes of a key come in the order of t, then status; one that the lifecycle does not allow from the status of
    the moment is refused and changes nothing. A null status of the table is ``start``; repeating the
    present status is neither applied nor refused; changes of unknown keys are left out. A key's changes meet
    in one task: they are what people did to one row.
    """
    steps = F.array(*[F.lit(f"{a}>{b}") for a, b in allowed])
    asked = changes.where(F.col("status").isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("t", F.col("status").alias("to")))).alias("_asked"))

    def step(s: Column, c: Column) -> Column:
        same, fine = c["to"] == s["status"], F.array_contains(steps, F.concat_ws(">", s["status"], c["to"]))
        return F.struct(F.when(fine & ~same, c["to"]).otherwise(s["status"]).alias("status"), (s["n"] + F.when(fine & ~same, 1).otherwise(0)).alias("n"), (s["no"] + F.when(~fine & ~same, 1).otherwise(0)).alias("no"))

    zero = F.lit(0).cast("int")
    begin = F.struct(F.coalesce("status", F.lit(start)).alias("status"), zero.alias("n"), zero.alias("no"))
    joined = table.join(asked, key, "left")
    nothing = F.array().cast(asked.schema["_asked"].dataType)
    after = joined.withColumn("_s", F.aggregate(F.coalesce("_asked", nothing), begin, step))
    return after.withColumns({"status": F.col("_s.status"), "n_applied": F.col("_s.n"), "n_refused": F.col("_s.no")}).drop("_asked", "_s")


def decide(recommendations: DataFrame, decisions: DataFrame, key: str = "recommendation_id") -> DataFrame:
    """Recommendations after the planners' reviews, acceptances and rejections."""
    return apply_changes(recommendations, decisions, key, RECOMMENDATION, "pending")


def maintain(anomalies: DataFrame, work: DataFrame, key: str = "anomaly_id") -> DataFrame:
    """Anomalies after reviews, work orders and repairs."""
    return apply_changes(anomalies, work, key, ANOMALY, "flagged")
