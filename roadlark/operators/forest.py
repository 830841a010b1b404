"""Isolation forest: rows that few random cuts set apart are outliers.

Trees grow on bounded hash samples of the rows, which are all that reaches the driver: at most
``trees * sample`` rows of the lowest hashes. Every row is then walked through all trees in arrays, a
level at a time. A leaf that still holds rows counts as deep as an unsuccessful search in a
tree of so many, c(n).

Rows with a null or non-finite feature have no score and are no outliers; equal rows score alike;
without rows there is no forest and no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlark.session import ship

EULER = 0.5772156649015329


def search_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Tree:
    """Nodes in arrays: the feature cut (-1 in a leaf), the cut, the child below it (the other one follows), the depth told by a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    depth: np.ndarray

    def depths(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while True:
            own = np.flatnonzero(self.feature[at] >= 0)
            if not len(own):
                return self.depth[at]
            node = at[own]
            at[own] = self.child[node] + (rows[own, self.feature[node]] >= self.cut[node])


def grow(rows: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of random cuts, no deeper than a balanced one of so many rows."""
    most = math.ceil(math.log2(max(2, len(rows))))
    feature, cut, child, depth = [-1], [0.0], [0], [0.0]
    open_ = [(0, np.arange(len(rows)), 0)]
    while open_:
        node, own, level = open_.pop()
        low, high = rows[own].min(0), rows[own].max(0)
        wide = np.flatnonzero(high > low)
        if level == most or len(own) <= 1 or not len(wide):
            depth[node] = level + search_depth(len(own))
            continue
        k = int(rng.choice(wide))
        at = float(rng.uniform(low[k], high[k]))
        at = at if at > low[k] else float(high[k])  # both sides keep a row
        feature[node], cut[node], child[node] = k, at, len(feature)
        for side in (own[rows[own, k] < at], own[rows[own, k] >= at]):
            open_.append((len(feature), side, level + 1))
            feature.append(-1)
            cut.append(0.0)
            child.append(0)
            depth.append(0.0)
    return Tree(np.array(feature), np.array(cut), np.array(child), np.array(depth))


@dataclass
class Forest:
    trees: list[Tree]
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Near 1 for outliers, about 0.5 where nothing stands out."""
        depth = sum(t.depths(rows) for t in self.trees) / len(self.trees)
        return 2.0 ** (-depth / self.usual) if self.usual else np.full(len(rows), 0.5)


def fit(rows: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    return Forest([grow(rows[rng.choice(len(rows), size, replace=False)], rng) for _ in range(trees)], search_depth(size))


def isolation_forest(features: DataFrame, columns: tuple[str, ...], key: str, *, trees: int = 100, sample: int = 256, threshold: float = 0.6, seed: int = 17) -> DataFrame:
    """key, outlier_score and is_outlier (a score above ``threshold``) of each row."""
    spark = features.sparkSession
    ship(spark)
    values = features.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names = [f"x{i}" for i in range(len(columns))]
    sound = F.lit(True)
    for c in names:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    # rows in the order of their hashes, whatever the partitions: an unbiased sample of a fixed size
    pool = values.where(sound).select(F.xxhash64("key", *names).alias("h"), *names).orderBy("h", *names).limit(trees * sample).collect()
    forest = fit(np.array([[r[c] for c in names] for r in pool], float), trees, sample, seed) if pool else None
    shared = spark.sparkContext.broadcast(forest)  # 2 * sample nodes a tree

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1)
            own = np.isfinite(rows).all(1)
            found = np.full(len(rows), np.nan)
            if own.any():
                found[own] = shared.value.scores(rows[own])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, mask=~own)], names=["key", "outlier_score"])

    scored = values.mapInArrow(score, f"key {dict(features.dtypes)[key]}, outlier_score double")
    return scored.select(F.col("key").alias(key), "outlier_score", F.coalesce(F.col("outlier_score") > threshold, F.lit(False)).alias("is_outlier"))
