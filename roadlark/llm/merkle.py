"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the hash of its fields. Leaves of a group ascend by the row's key, every 16
consecutive nodes become one node of the next level until one is left, the group's root; group
roots, ordered by group, go on in the same way up to the root of the dataset.

Leaves are range-sorted by (group, key, leaf), so that a hot group lies in many partitions.
Partitions report how many rows of their first and last group they hold; the sums over the
partitions before give every partition the place of its first leaf in its group's tree. Each then
builds the complete aligned subtrees of its stretch by itself. What is left over at its two ends,
fewer than 32 nodes a level, is shuffled by coordinate (tree, level, run) and finished level by
level. The runs on the way from a partition's ends to the root are sent back to it, and with
them it gives the proof of each of its rows.

The driver holds five numbers and two digests a partition, never a node or a row. A task holds one
partition's leaves (``part_rows`` of them, about) and the runs above them. Sorted leaves and nodes lie in
the shared folder, so a lost executor costs the partitions it was working on.

Defined cases: a null field is hashed as ``-``; a null group comes first, and so does a null key in
its group; rows of one key in a group follow each other by leaf, and repeated rows, which
share a leaf, have a proof for each of their places; a text of any length is hashed in the JVM
and goes no further; a group of one row has its leaf as root; the only group's root is the
dataset's root; proofs without a sibling are the hash of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, n_tasks
from roadlark.session import checkpointed

ARITY, SHIFT = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the groups' roots.
TOP = -1
PART_ROWS = 16_384
LEAF, NODE, WANT = 0, 1, 2


def leaf(*values: Column) -> Column:
    """Hash of the values: each is ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    spelled = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in spelled]), 256)


def joined(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


@dataclass(frozen=True)
class Place:
    """Where a partition's rows stand: rows of its first group before it, that group's number, rows of its first and of its last group in all."""

    offset: int
    number: int
    first_total: int
    last_total: int


def places(parts: list[tuple[int, int, bytes, int, bytes, int]]) -> tuple[dict[int, Place], int]:
    """(Place of each partition, number of groups) from (partition, groups, first, its rows, last, its rows) of the partitions in order."""
    found, totals, number, before = [], [], -1, None
    for part, groups, first, first_rows, last, last_rows in parts:
        if first != before:  # the first group begins here
            number += 1
            totals.append(0)
        at, offset, own = len(totals) - 1, totals[-1], number
        totals[at] += first_rows
        if groups > 1:
            number += groups - 1
            totals.append(last_rows)
        found.append((part, offset, own, at, len(totals) - 1))
        before = last
    return {part: Place(offset, own, totals[at], totals[to]) for part, offset, own, at, to in found}, number + 1


def subtree(nodes: list[str], start: int, total: int) -> Iterator[tuple[int, int, list[str], dict[int, list[str]]]]:
    """(level, first position, nodes, complete runs) of each level that leaves ``start`` on give by themselves."""
    level = 0
    while nodes and total > 1:
        end = start + len(nodes)
        runs = {r: nodes[max(r * ARITY - start, 0) : (r + 1) * ARITY - start] for r in range(-(-start // ARITY), -(-end // ARITY)) if (r + 1) * ARITY <= end or end == total}
        yield level, start, nodes, runs
        start, nodes, level, total = min(runs, default=0), [joined(x) for x in runs.values()], level + 1, -(-total // ARITY)
    if nodes:
        yield level, start, nodes, {}


class Segment:
    """The rows of one group in one partition."""

    def __init__(self, number: int, start: int, total: int, leaves: list[str]):
        self.number, self.start, self.total = number, start, total
        self.levels = list(subtree(leaves, start, total))
        self.end = start + len(leaves)

    def ragged(self) -> Iterator[tuple[int, int, int, str, int]]:
        """(tree, level, position, node, leaves of the tree) of the nodes whose run is not complete here, or of the group's root."""
        for level, start, nodes, runs in self.levels:
            if not runs and level == height(self.total):
                yield TOP, 0, self.number, nodes[0], 0
                continue
            for k, node in enumerate(nodes, start):
                if k // ARITY not in runs:
                    yield self.number, level, k, node, self.total

    def wanted(self) -> Iterator[tuple[int, int, int]]:
        """(tree, level, run) of the runs above these rows that are not complete here."""
        here = {level: runs for level, _, _, runs in self.levels}
        for level in range(height(self.total)):
            for run in {self.start >> SHIFT * (level + 1), (self.end - 1) >> SHIFT * (level + 1)}:
                if run not in here.get(level, {}):
                    yield self.number, level, run


def segments(groups: list[bytes], leaves: list[str], place: Place) -> Iterator[Segment]:
    """The stretches of equal group of a partition's sorted leaves."""
    bounds = [0, *[k for k in range(1, len(groups)) if groups[k] != groups[k - 1]], len(groups)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        first, last = k == 0, b == len(groups)
        total = place.first_total if first else place.last_total if last else b - a
        yield Segment(place.number + k, place.offset if first else 0, total, leaves[a:b])


def _climb(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of one level: tree, level, run, total and their nodes in order."""
    at = nodes.where(F.col("level") == level)
    run = at.groupBy("tree", "level", F.shiftright("pos", SHIFT).alias("run")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes"))
    return run.select("tree", "level", "run", "total", F.col("nodes.node").alias("nodes"))


def _parents(runs: DataFrame) -> DataFrame:
    """The node above each run; the last one of a group's tree is a leaf of the tree above the groups."""
    last = (F.col("tree") != TOP) & (F.col("total") <= F.expr(f"shiftleft(1L, {SHIFT} * (level + 1))"))
    node = F.sha2(F.array_join("nodes", ""), 256)
    return runs.select(F.when(last, TOP).otherwise(F.col("tree")).alias("tree"), F.when(last, 0).otherwise(F.col("level") + 1).alias("level"), F.when(last, F.col("tree")).otherwise(F.col("run")).alias("pos"), node.alias("node"), F.when(last, 0).otherwise(F.col("total")).alias("total"))


def _finish(nodes: DataFrame, scratch: Scratch, levels: int, groups: int) -> DataFrame | None:
    """All runs that no partition holds complete, for trees of at most ``levels`` levels and the one above ``groups`` groups."""
    found, parents, above = [], nodes, []
    for level in range(levels):
        runs = scratch.save(_climb(parents.where(F.col("tree") != TOP), level), f"runs{level}")
        up = _parents(runs)
        above.append(up.where(F.col("tree") == TOP))
        found.append(runs)
        parents = nodes.where((F.col("tree") != TOP) & (F.col("level") > level)).unionByName(up.where(F.col("tree") != TOP))
    top = nodes.where(F.col("tree") == TOP)
    for more in above:
        top = top.unionByName(more)
    for level in range(height(groups)):
        runs = scratch.save(_climb(top, level), f"top{level}")
        found.append(runs)
        top = _parents(runs)
    out = None
    for runs in found:
        out = runs if out is None else out.unionByName(runs)
    return out


class Proofs:
    """Siblings on the way from a partition's leaves to the root, from what it holds and the runs sent to it."""

    def __init__(self, groups: int, sent: dict[tuple[int, int, int], list[str]]):
        self.groups, self.runs, self.known = groups, sent, {}

    def add(self, segment: Segment) -> None:
        for level, _, _, runs in segment.levels:
            for run, nodes in runs.items():
                self.runs[segment.number, level, run] = nodes

    def way(self, tree: int, total: int, level: int, at: int) -> tuple[tuple[str, str], ...]:
        """What stands left and right of a node in its run, and so on for each level up to the root."""
        key = (tree, level, at)
        if level and key in self.known:
            return self.known[key]
        if level == height(total):
            out = () if tree == TOP else self.way(TOP, self.groups, 0, tree)
        else:
            nodes, k = self.runs[tree, level, at >> SHIFT], at % ARITY
            out = (("".join(nodes[:k]), "".join(nodes[k + 1 :])), *self.way(tree, total, level + 1, at >> SHIFT))
        if level or tree == TOP:
            self.known[key] = out
        return out


def _folded(node: str, way: tuple[tuple[str, str], ...]) -> str:
    for left, right in way:
        node = hashlib.sha256((left + node + right).encode()).hexdigest()
    return node


def prove(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", changed: dict[str, Column] | None = None, part_rows: int = PART_ROWS, siblings: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot (its group's root), root, position in the group, proof_sha256, folded_root, verified.

    ``changed`` has new values of fields; ``folded_root`` is what the changed row's leaf and the
    original siblings give, ``verified`` whether that is the root. ``siblings`` adds the proof itself: an array of
    what stands left and right of the row's node at each level.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    changed = changed or {}
    now = [F.col(f"`{c}`") for c in fields]
    later = [changed.get(c, F.col(f"`{c}`")) for c in fields]
    kind = dict(docs.dtypes)[key]
    slim = docs.select(F.col(f"`{group}`").cast("string").alias("grp"), F.col(f"`{key}`").alias("key"), leaf(*now).alias("leaf"), leaf(*later).alias("changed"))
    # of rows with one leaf only the place in the input tells which partition they go to, so that copies of a row are split too
    slim = scratch.save(slim.withColumn("changed", F.nullif("changed", "leaf")).withColumn("salt", F.monotonically_increasing_id()), "leaves")
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("salt")]
    rows = slim.count()
    ordered = slim.repartitionByRange(n_tasks(spark, rows, part_rows), *order).sortWithinPartitions(*order)
    # two groups are one only if their digests are
    digest = F.coalesce(F.md5(F.col("grp").cast("binary")), F.lit("null"))
    ordered = checkpointed(ordered.select(F.spark_partition_id().alias("part"), digest.alias("grp"), "key", "leaf", "changed"))

    with arrow_limits(spark, rows=8192):
        counts = ordered.select("part", "grp").mapInArrow(_counts, "part int, groups long, first binary, first_rows long, last binary, last_rows long").collect()
        place, groups = places(sorted(tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in counts))
        shared = spark.sparkContext.broadcast(place)  # four numbers a partition
        id_type = ordered.select("key").limit(0).toArrow().schema.field(0).type
        built_type = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("total", pa.int64()), ("key", id_type), ("node", pa.string()), ("changed", pa.string())])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if not table or not len(table):
                return
            part, leaves = table["part"][0].as_py(), table["leaf"].to_pylist()
            own = list(segments(table["grp"].to_pylist(), leaves, shared.value[part]))
            n = [s.end - s.start for s in own]
            yield from _rows(built_type, LEAF, part, tree=[s.number for s, m in zip(own, n, strict=True) for _ in range(m)], pos=[p for s in own for p in range(s.start, s.end)], total=[s.total for s, m in zip(own, n, strict=True) for _ in range(m)], key=table["key"], node=leaves, changed=table["changed"])
            nodes = [x for s in own for x in s.ragged()]
            yield from _rows(built_type, NODE, part, **dict(zip(("tree", "level", "pos", "node", "total"), zip(*nodes, strict=True), strict=True))) if nodes else ()
            wants = [x for s in own for x in s.wanted()]
            for level in range(height(groups)):
                wants += [(TOP, level, run) for run in range(own[0].number >> SHIFT * (level + 1), (own[-1].number >> SHIFT * (level + 1)) + 1)]
            yield from _rows(built_type, WANT, part, **dict(zip(("tree", "level", "pos"), zip(*wants, strict=True), strict=True))) if wants else ()

        built = scratch.save(ordered.mapInArrow(build, f"kind byte, part int, tree long, level int, pos long, total long, key {kind}, node string, changed string"), "built")

        split = max((max(p.first_total, p.last_total) for p in place.values()), default=0)
        runs = _finish(built.where(F.col("kind") == NODE).select("tree", "level", "pos", "node", "total"), scratch, height(split), groups)
        leaves = built.where(F.col("kind") == LEAF).select("part", F.lit(1).alias("late"), "tree", F.lit(None).cast("int").alias("level"), "pos", "total", "key", "node", "changed", F.lit(None).cast("array<string>").alias("nodes"))
        dealt = leaves
        if runs is not None:
            wants = built.where(F.col("kind") == WANT).select("part", "tree", "level", F.col("pos").alias("run"))
            sent = wants.join(runs, ["tree", "level", "run"])
            nothing = F.lit(None).cast("string")
            dealt = leaves.unionByName(sent.select("part", F.lit(0).alias("late"), "tree", "level", F.col("run").alias("pos"), "total", F.lit(None).cast(kind).alias("key"), nothing.alias("node"), nothing.alias("changed"), "nodes"))
        result_type = pa.schema([("key", id_type), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("position", pa.int64()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), *([("siblings", pa.list_(pa.string()))] if siblings else [])])

        def proofs(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            """``rows`` are all of one partition: first the runs sent to it, then its leaves in order."""
            table = pa.concat_tables(rows)
            early = table["late"].to_pylist().count(0)
            runs, own = table.slice(0, early), table.slice(early)
            known = Proofs(groups, dict(zip(zip(*[runs[c].to_pylist() for c in ("tree", "level", "pos")], strict=True), runs["nodes"].to_pylist(), strict=True)))
            tree, pos, total, leaves, later = (own[c].to_pylist() for c in ("tree", "pos", "total", "node", "changed"))
            bounds = [0, *[k for k in range(1, len(tree)) if tree[k] != tree[k - 1]], len(tree)]
            out: dict[str, list] = {f.name: [] for f in result_type if f.name not in ("key", "leaf", "position")}
            for a, b in zip(bounds, bounds[1:], strict=False):
                known.add(Segment(tree[a], pos[a], total[a], leaves[a:b]))
                up = height(total[a])
                for k in range(a, b):
                    way = known.way(tree[k], total[k], 0, pos[k])
                    if k == a:
                        subroot, root = _folded(leaves[k], way[:up]), _folded(leaves[k], way)
                    found = _folded(later[k] or leaves[k], way)
                    out["subroot"].append(subroot)
                    out["root"].append(root)
                    out["proof_sha256"].append(hashlib.sha256("".join([x for pair in way for x in pair]).encode()).hexdigest())
                    out["folded_root"].append(found)
                    out["verified"].append(found == root)
                    if siblings:
                        out["siblings"].append([x for pair in way for x in pair])
            columns = {"key": own["key"].combine_chunks(), "leaf": leaves, "position": pos} | out
            yield from pa.table([columns[f.name] if f.name == "key" else pa.array(columns[f.name], f.type) for f in result_type], schema=result_type).to_batches(4096)

        def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now = [], None
            for batch in batches:
                part = batch.column("part").to_numpy()
                at = 0
                while at < len(part):
                    if now is not None and part[at] != now:
                        yield from proofs(held)
                        held = []
                    now = part[at]
                    to = at + int((part[at:] == now).argmin() or len(part) - at)
                    held.append(pa.Table.from_batches([batch.slice(at, to - at)]))
                    at = to
            if held:
                yield from proofs(held)

        dealt = dealt.repartition(max(1, len(place)), "part").sortWithinPartitions("part", "late", "tree", "pos")
        result = f"key {kind}, leaf string, subroot string, root string, position long, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>" if siblings else "")
        return scratch.save(dealt.mapInArrow(by_part, result), "proofs")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition that holds any: its groups, and the digests and rows of the first and the last of them."""
    part, groups, first, first_rows, last, last_rows = None, 0, None, 0, None, 0
    for batch in batches:
        for own in batch.column("grp").to_pylist():
            if own != last:
                groups, last, last_rows = groups + 1, own, 0
                first = own if first is None else first
            last_rows += 1
            first_rows += groups == 1
        if len(batch):
            part = batch.column("part")[0].as_py()
    if part is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "groups": pa.array([groups], pa.int64()), "first": pa.array([first.encode()], pa.binary()), "first_rows": pa.array([first_rows], pa.int64()), "last": pa.array([last.encode()], pa.binary()), "last_rows": pa.array([last_rows], pa.int64())})


def _rows(schema: pa.Schema, kind: int, part: int, **given) -> Iterator[pa.RecordBatch]:
    size = len(given["pos"])
    given |= {"kind": [kind] * size, "part": [part] * size}
    columns = [pa.nulls(size, f.type) if (x := given.get(f.name)) is None else x if isinstance(x, pa.ChunkedArray) else pa.array(x, f.type) for f in schema]
    yield from pa.table(columns, schema=schema).to_batches(4096)
