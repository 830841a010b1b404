"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation to each node's smallest neighbour and a join; the edge table
never grows, and a hub's edges are split by the join's skew handling. Steps write their edges
to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Here u > v."""
    least = _smallest(edges)
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """Columns ``node`` and ``component`` (the smallest node reachable), for each node with an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; loops and repeats are allowed.
    Steps go on until one changes nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, f"{name}0")
    state = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")]
    after, before, step = tuple(now.agg(*state).first()), None, 0
    while after[0] and after != before:
        # count and checksum, taken while a step is written, tell whether it changed anything
        before, step, seen = after, step + 1, Observation()
        now = scratch.save(_small_star(_large_star(now)).observe(seen, *state), f"{name}{step}")
        after = (seen.get["n"], seen.get["sum"])
        scratch.drop(f"{name}{step - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
