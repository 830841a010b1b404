"""Exact threshold pairs of embeddings by cover-tree dual traversal.

Vectors are scaled to length 1, so cosine >= c is distance <= sqrt(2 - 2c). Equal vectors are
one point with a multiplicity. Points are dealt to cells around pivots and cells are cut into
blocks. A cell's covering radius is the exact distance of its furthest point from its pivot; a point meets
the blocks of another cell only where its distance from that pivot is at most the reach and the
cell's radius, so pairs of blocks that are too far apart are never dealt. Each block gets a
cover tree: nested nets whose radii halve from level to level until they no longer thin the points out (not even the
first, where points are all far apart), each node with the exact radius of what it covers. Every pair of blocks is one task, which walks both trees at
once from the coarsest level, drops node pairs by their covering radii, drops pairs of points by products in single precision
less a bound on their error, and computes the cosines of what is left in double precision. A task returns link counts and a spanning forest, never all pairs.

In high dimensions random vectors are all about as far apart, and no bound can drop their block
pairs: rows sent and work are then quadratic in the number of blocks. Clustered vectors, as real
embeddings are, meet near cells only.

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components, or have no vec_id, link with nothing and are their own component; repeated vectors link
with each other; repeated vec_ids are one vector when equal; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, trim
from roadlark.llm.components import components

#: Radii of the coarsest and the finest net; the last level is the points themselves.
COARSEST, FINEST = 1.0, 1 / 64
SLACK = 1e-9
TILE = 1024
#: What a step of a product of two unit vectors may lose in single precision, its operands' own rounding included.
SINGLE_ERROR = 1.2e-7
#: A net thins its points out if it holds at most one in so many: below that, comparing all points costs less than the nets.
THIN = 8
#: Pairs of nodes are followed one by one if at most this share of them is near; else all nodes go down together.
FEW = 0.02


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


class CoverTree:
    """Nested nets over unit vectors: level by level the centres, whom they cover, and how far."""

    def __init__(self, points: np.ndarray):
        self.points, self.single = points, points.astype(np.float32)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.children: list[list[np.ndarray]] = []
        net, owners = np.empty(0, np.int64), []
        radius = COARSEST
        while radius >= FINEST:
            net = self._extend(net, radius)
            if THIN * len(net) > len(points):  # hardly thinner than the points themselves
                break
            owners.append(self._owner(net))
            radius /= 2
        # a node belongs whole to one parent: a point's centre is that of its centre one level down
        for level in range(len(owners) - 2, -1, -1):
            owners[level] = owners[level][owners[level + 1]]
        for level, owner in enumerate(owners):
            centres = np.unique(owner)
            far = np.zeros(len(points))
            for at in range(0, len(points), TILE):
                rows = slice(at, at + TILE)
                far[rows] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", points[rows], points[owner[rows]])))
            place = np.searchsorted(centres, owner)
            cover = np.zeros(len(centres))
            np.maximum.at(cover, place, far)
            self.levels.append((centres, cover))
            below = np.arange(len(points)) if level + 1 == len(owners) else np.searchsorted(np.unique(owners[level + 1]), owners[level + 1])
            pairs = np.unique(np.stack([place, below], 1), axis=0)
            self.children.append(np.split(pairs[:, 1], np.cumsum(np.bincount(pairs[:, 0], minlength=len(centres)))[:-1]))
        self.levels.append((np.arange(len(points)), np.zeros(len(points))))

    def below(self, level: int, node: int) -> np.ndarray:
        """Nodes of the next level that this one covers; a point covers itself."""
        return self.children[level][node] if level < len(self.children) else np.array([node])

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[min(level, len(self.levels) - 1)]

    def _extend(self, net: np.ndarray, radius: float) -> np.ndarray:
        """Greedy net that contains the given one: every point has a centre within the radius. It is left off once it holds too many of the points."""
        chosen = list(net)
        rest = np.setdiff1d(np.arange(len(self.points)), net)
        for at in range(0, len(rest), 256):
            if THIN * len(chosen) > len(self.points):
                break
            rows = rest[at : at + 256]
            if chosen:
                rows = rows[_distances(self.points[rows], self.points[chosen]).min(1) > radius]
            own = _distances(self.points[rows], self.points[rows])
            free = np.ones(len(rows), bool)
            for k in range(len(rows)):
                if free[k]:
                    chosen.append(int(rows[k]))
                    free &= own[k] > radius
        return np.array(chosen, np.int64)

    def _owner(self, net: np.ndarray) -> np.ndarray:
        """Nearest centre of each point; a centre's is itself."""
        out = np.arange(len(self.points))
        rest = np.setdiff1d(out, net)
        for at in range(0, len(rest), TILE):
            rows = rest[at : at + TILE]
            out[rows] = net[(self.points[rows] @ self.points[net].T).argmax(1)]
        return out


def near_pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of all pairs of points within ``reach``, and maybe some beyond it."""

    def walk(level: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        (centres_a, cover_a), (centres_b, cover_b) = a.at(level), b.at(level)
        last = level + 1 >= max(len(a.levels), len(b.levels))
        least = np.float32(1 - (reach + SLACK) ** 2 / 2 - a.points.shape[1] * SINGLE_ERROR - 4 * SINGLE_ERROR)
        if not last and len(left) * len(right) > TILE * TILE:  # a look at some node pairs: a level that drops few of them is left out
            some, others = left[:: 1 + len(left) // 64], right[:: 1 + len(right) // 64]
            gap = _distances(a.points[centres_a[some]], b.points[centres_b[others]])
            if (gap <= reach + cover_a[some][:, None] + cover_b[others][None, :] + SLACK).mean() > 2 * FEW:
                yield from walk(level + 1, np.concatenate([a.below(level, x) for x in left]), np.concatenate([b.below(level, y) for y in right]))
                return
        for at in range(0, len(left), TILE):
            rows = left[at : at + TILE]
            if last:  # points cover nothing but themselves
                i, j = np.nonzero(a.single[centres_a[rows]] @ b.single[centres_b[right]].T >= least)
                if len(i):
                    yield rows[i], right[j]
                continue
            gap = _distances(a.points[centres_a[rows]], b.points[centres_b[right]])
            i, j = np.nonzero(gap <= reach + cover_a[rows][:, None] + cover_b[right][None, :] + SLACK)
            if len(i) > FEW * gap.size:  # hardly any pair dropped: go down with all of them at once
                if len(i):
                    yield from walk(level + 1, np.concatenate([a.below(level, x) for x in np.unique(rows[i])]), np.concatenate([b.below(level, x) for x in np.unique(right[j])]))
            else:
                for x in np.unique(i):
                    partners = right[j[i == x]]
                    yield from walk(level + 1, a.below(level, rows[x]), np.concatenate([b.below(level, y) for y in partners]))

    if len(a.points) and len(b.points):
        yield from walk(0, np.arange(len(a.levels[0][0])), np.arange(len(b.levels[0][0])))


class Forest:
    """Union-find that keeps the edges that joined something."""

    def __init__(self, n: int):
        self.parent, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.kept.append((x, y))


def links(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, block_points: int = 4096, cell_points: int = 4096, seed: int = 5) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (whether it is its component's smallest)."""
    scratch = Scratch(vectors.sparkSession, "covertree")
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    kind = dict(vectors.dtypes)[embedding]
    kind = kind if kind == "array<float>" else "array<double>"
    v = F.col(embedding).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (squares > 0) & (squares < F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(kind).alias("u"), (F.coalesce(usable, F.lit(False)) & F.col(vec_id).isNotNull()).alias("usable"))
    identity = F.md5(F.concat_ws(",", F.col("u").cast("array<string>")).cast("binary"))
    known = scratch.save(rows.where("usable").withColumn("dim", F.size("u")).withColumn("hash", identity).select("vec_id", "hash", "dim", "u"), "known")
    points = known.groupBy("hash").agg(F.min("vec_id").alias("point"), F.count_distinct("vec_id").alias("times"), F.first("u").alias("u"), F.first("dim").alias("dim"))
    points = scratch.save(points, "points")
    n = points.count()
    with arrow_limits(vectors.sparkSession, rows=4096):
        edges, counts = _block_links(_dealt(points, n, reach, block_points, cell_points, seed, scratch), cosine, reach, scratch)
    joined = points.select(F.col("point").alias("node"), "hash", "times").join(components(edges, scratch), "node", "left").join(counts, "node", "left")
    per_point = joined.select("hash", F.coalesce("component", "node").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"))
    found = known.select("vec_id", "hash").join(per_point, "hash").select("vec_id", "n_links", "component_id")
    lone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _dealt(points: DataFrame, n: int, reach: float, block_points: int, cell_points: int, seed: int, scratch: Scratch) -> DataFrame:
    """(left, right, block, point, times, u): the points that each pair of blocks has to compare."""
    spark = points.sparkSession
    # pivots: a bounded hash sample; they decide where a point is dealt to, and what it can't reach
    wanted = min(1024, max(1, n // cell_points))
    sample = points.orderBy(F.xxhash64("hash", F.lit(seed))).limit(wanted).select("u", "dim").collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in sample}:
        by_dim[dim] = _unit(pd.Series([np.array(r["u"]) for r in sample if r["dim"] == dim]))
    pivots = spark.sparkContext.broadcast(by_dim)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for frame in batches:
            cell, far = np.zeros(len(frame), np.int64), np.full(len(frame), 2.0)
            for dim, own in frame.groupby("dim"):
                near = pivots.value.get(dim)
                if near is not None:
                    at, gap = frame.index.get_indexer(own.index), _distances(_unit(own["u"]), near)
                    cell[at], far[at] = gap.argmin(1), gap.min(1)
            yield frame.assign(cell=cell, far=far)

    kind = dict(points.dtypes)["u"]
    dealt = points.mapInPandas(deal, f"hash string, point long, times long, u {kind}, dim int, cell long, far double")
    dealt = scratch.save(dealt.select("point", "times", "u", "dim", "cell", "far"), "dealt")
    # large cells are cut by hash, so that no block outgrows a task
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # at most the pivots and a cell for each length
    blocks, first = 0, {}
    for r in sorted(cells):
        first[r["dim"], r["cell"]] = (blocks, -(-r["n"] // block_points), r["radius"])
        blocks += first[r["dim"], r["cell"]][1]
    table = spark.createDataFrame([(d, c, a, k) for (d, c), (a, k, _) in first.items()], "dim int, cell long, first int, parts int")
    blocked = dealt.join(F.broadcast(table), ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("point"), F.col("parts"))).cast("int")).select("point", "times", "u", "block", "dim", "cell")
    spans = spark.sparkContext.broadcast(first)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trim()
        for frame in batches:
            others: list[np.ndarray] = [np.empty(0, np.int32)] * len(frame)
            for dim, own in frame.groupby("dim"):
                known = [(c, a, k, r) for (d, c), (a, k, r) in spans.value.items() if d == dim]
                hit = np.ones((len(own), len(known)), bool)
                if dim in pivots.value:
                    cells = np.array([c for c, *_ in known], np.int64)
                    gap = _distances(_unit(own["u"]), pivots.value[dim])
                    hit = (gap[:, cells] <= reach + np.array([r for *_, r in known]) + SLACK) | (cells == own["cell"].to_numpy(np.int64)[:, None])
                blocks_of = [np.arange(a, a + k, dtype=np.int32) for _, a, k, _ in known]
                for place, row in zip(frame.index.get_indexer(own.index).tolist(), hit, strict=True):
                    others[place] = np.concatenate([blocks_of[x] for x in np.flatnonzero(row)])
            yield frame.assign(others=others)[["point", "times", "u", "block", "others"]]

    sent = blocked.mapInPandas(spread, f"point long, times long, u {kind}, block int, others array<int>")
    sent = sent.withColumn("other", F.explode("others"))
    return sent.select(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "point", "times", "u")


def _block_links(dealt_pairs: DataFrame, cosine: float, reach: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    spark = dealt_pairs.sparkSession

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        trim()
        left, right = frame["left"].iloc[0], frame["right"].iloc[0]
        frame = frame.sort_values("point", ignore_index=True)
        sides = [frame[frame["block"] == k] for k in ((left,) if left == right else (left, right))]
        ids = np.concatenate([s["point"].to_numpy() for s in sides])
        times = np.concatenate([s["times"].to_numpy() for s in sides])
        trees = [CoverTree(_unit(s["u"])) if len(s) else None for s in sides]
        if any(t is None for t in trees):
            return pd.DataFrame({"a": [], "b": [], "linked": []}).astype("int64")
        a, b = trees[0], trees[-1]
        shift = 0 if left == right else len(a.points)
        forest, linked = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for i, j in near_pairs(a, b, reach):
            if left == right:
                i, j = i[i < j], j[i < j]
            exact = np.einsum("ij,ij->i", a.points[i], b.points[j]) >= cosine
            i, j = i[exact], j[exact] + shift
            np.add.at(linked, i, times[j])
            np.add.at(linked, j, times[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.join(x, y)
        some = np.flatnonzero(linked)
        edges = pd.DataFrame([(ids[x], ids[y], 0) for x, y in forest.kept], columns=["a", "b", "linked"], dtype="int64")
        return pd.concat([edges, pd.DataFrame({"a": ids[some], "b": ids[some], "linked": linked[some]})], ignore_index=True)

    found = dealt_pairs.groupBy("left", "right").applyInPandas(link, "a long, b long, linked long")
    found = scratch.save(found, "found")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    return found.where("a <> b").select("a", "b"), counts
