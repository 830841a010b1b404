"""N-gram Jaccard join with count-vector R-trees.

A text is its set of distinct 5-word shingles; two texts link when 100 * intersection >= 75 *
union. Equal sets are one node. Shingles belong to one of ``GROUPS`` or more groups by hash, and a
node is the point of its group counts: two sets share at most the sum over groups of the smaller
count, and two boxes of points at most the sum of their smaller upper corners.

1. One pass over the texts. Every shingle is counted over all documents. Only shingles of two
   documents or more can be shared, so a node's recurring shingles are all that it is compared
   by, and its points count these alone.
2. Shingles are ordered by frequency, rare ones first. Two sets that link share one of the first
   n - ceil(3n/4) + 1 in that order; a set whose unique shingles fill that prefix links with
   nothing and goes. The nodes that share a prefix shingle are a cell; a cell within a larger one is
   dropped, and one of a very frequent shingle is dealt in salted parts.
3. An R-tree over the points of each cell yields the pairs that boxes and counts allow. First
   each node tries its partner of the highest bound and its cell's node of the most partners.
   While a cell then still holds several components, its tree yields the pairs of different
   ones; these are tried, best bounds first, until none is left.

Pairs that survive the bound are verified on the recurring shingles. No link between different
texts is lost, and copies are never expanded into all pairs. Words and sets are compared by 64-bit,
shingles by 48-bit hashes.

Defined cases: a null, empty or blank text has no shingles and links with nothing; repeated
rows and equal texts link; a component of rows without doc_id has none; an empty table gives
an empty table. A partition of ``docs`` must yield its rows in one order whenever it is
recomputed, as a scan of files does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.llm.common import Scratch, arrow_limits, n_tasks, packed_columns, release, row_key, trim, unpacked
from roadlark.llm.components import components
from roadlark.llm.hashing import mix, set_id, set_ids, shingle_sets

GROUPS = 64
#: A range of shingles holds those of about so many bytes of text; a task writes its postings in runs of FLUSH.
RANGE_BYTES, FLUSH, FLUSH_DOCS = 8 << 20, 1 << 20, 1 << 16
#: Postings that go to their run itself, by way of any range, in one row.
CARRIED = 1 << 16
#: Documents that a task remembers, to send equal texts once; others are merged later.
REMEMBERED = 1 << 16
#: Cells of shingles in more documents are dealt in parts of about so many.
SALT_NODES = 4096
#: Nodes that meet in one R-tree from one side.
BLOCK = 1024
ALL = 1 << 30


def group_counts(shingles: np.ndarray, n: int) -> bytes:
    """Recurring shingles of a set of ``n`` in each group. Larger sets have more groups, a power of
    two; folding the upper half of the groups onto the lower gives fewer. 255 stands for that many or more."""
    groups = GROUPS
    while groups * 2 < n:
        groups *= 2
    return np.minimum(np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8).tobytes()


def _fold(rows: np.ndarray, groups: int) -> np.ndarray:
    """Rows of counts in so many groups, saturating at 255."""
    return np.minimum(rows.reshape(len(rows), -1, groups).sum(1, dtype=np.int32), 255).astype(np.uint8)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most that sets with these counts (rows) can share; no bound where both sides are saturated."""
    both = np.minimum(a, b)
    return np.where((both == 255).any(-1), np.iinfo(np.int32).max, both.sum(-1, dtype=np.int32)).astype(np.int64)


class Points:
    """Group counts of some sets: ``coarse`` in GROUPS groups, and in the groups that pairs have in common."""

    def __init__(self, counts: list[bytes]):
        self.length = np.array([len(c) for c in counts], np.int64)
        self.coarse = np.empty((len(counts), GROUPS), np.uint8)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = {}
        for length in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == length)
            own[length] = (at, np.frombuffer(b"".join([counts[k] for k in at]), np.uint8).reshape(len(at), length))
            self.coarse[at] = _fold(own[length][1], GROUPS)
        for length, (at, m) in own.items():
            place = np.full(len(counts), -1, np.int64)
            place[at] = np.arange(len(at))
            if 2 * length in own:  # sets of linkable size have at most twice the groups
                more, wide = own[2 * length]
                place[more] = len(at) + np.arange(len(more))
                m = np.concatenate([m, _fold(wide, length)])
            self.rows[length] = (place, m)

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bounds of pairs of positions; 0 where one has over twice the other's groups, since such sets never link."""
        fewer, more = np.minimum(self.length[a], self.length[b]), np.maximum(self.length[a], self.length[b])
        out = np.zeros(len(a), np.int64)
        for length in np.unique(fewer).tolist():
            place, m = self.rows[length]
            pairs = np.flatnonzero((fewer == length) & (more <= 2 * length))
            step = max(1, (1 << 22) // length)
            for at in range(0, len(pairs), step):
                own = pairs[at : at + step]
                out[own] = overlap_bound(m[place[a[own]]], m[place[b[own]]])
        return out


def possible(n_a: np.ndarray, n_b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether so many shared shingles reach 75 %: 100 s >= 75 (a + b - s)."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (4 * low >= 3 * high) & (7 * np.minimum(shared, low).astype(np.int64) >= 3 * (n_a + n_b))


class CountTree:
    """R-tree over group counts, packed by cell, size and counts; boxes keep upper corners, sizes and cells."""

    LEAF, FAN = 16, 8

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, cells: np.ndarray | None = None):
        cells = np.zeros(len(sizes), np.int64) if cells is None else cells
        # sets of one class of sizes are those that may link
        order = np.lexsort((counts[:, 1], counts[:, 0], (np.log(np.maximum(sizes, 1)) / np.log(4 / 3)).astype(np.int64), cells))
        self.order = order
        top, low, high, step = counts[order], sizes[order], sizes[order], self.LEAF
        first = last = cells[order]
        self.levels = [(top, low, high, first, last)]
        while len(top) > 1:
            at = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = first[at], np.maximum.reduceat(last, at)
            self.levels.append((top, low, high, first, last))
            step = self.FAN

    def _step(self, level: int) -> int:
        return self.LEAF if level == 0 else self.FAN

    def pairs(self, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, positions, bound) of pairs of one cell that their boxes and counts allow."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > most:
                stack += [(level, a[k : k + most], b[k : k + most]) for k in range(0, len(a), most)]
                continue
            top, low, high, first, last = self.levels[level]
            fits = (first[a] <= last[b]) & (first[b] <= last[a]) & (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
            a, b = a[fits], b[fits]
            bound = overlap_bound(top[a], top[b])
            fits = 7 * np.minimum(bound, np.minimum(high[a], high[b])).astype(np.int64) >= 3 * (low[a] + low[b])
            a, b, bound = a[fits], b[fits], bound[fits]
            if level == 0:
                fits = (a < b) & possible(low[a], low[b], bound)
                if fits.any():
                    yield self.order[a[fits]], self.order[b[fits]], bound[fits]
                continue
            step, n = self._step(level - 1), len(self.levels[level - 1][1])
            i, j = np.meshgrid(np.arange(step), np.arange(step), indexing="ij")
            x, y = (a[:, None] * step + i.ravel()).ravel(), (b[:, None] * step + j.ravel()).ravel()
            keep = (x < n) & (y < n) & (x <= y)
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def pack(values: np.ndarray) -> bytes:
    """Rising unsigned values: the first one and 32-bit gaps, or all in 64 bits where a gap is wider."""
    gaps = np.diff(values)
    if len(gaps) and int(gaps.max()) >> 32:
        return values.astype("<u8").tobytes()
    return values[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes()


def unpack(raw: bytes, count: int) -> np.ndarray:
    if len(raw) == 8 * count:
        return np.frombuffer(raw, "<u8")
    return np.cumsum(np.concatenate([np.frombuffer(raw[:8], "<u8"), np.frombuffer(raw[8:], "<u4").astype(np.uint64)]), dtype=np.uint64)


def _cuts(rising: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the 48-bit values begins in ``rising``, and the end."""
    edges = np.array([(k << 48) // ranges for k in range(1, ranges)], np.uint64)
    return np.r_[0, np.searchsorted(rising, edges), len(rising)]


def _rows(schema: pa.Schema, size: int, **given) -> pa.RecordBatch:
    """A batch of ``size`` rows with the given columns, nulls in the others."""
    return pa.RecordBatch.from_arrays([x if isinstance(x := given.get(f.name), pa.Array) else pa.nulls(size, f.type) if x is None else pa.array(x, f.type) for f in schema], schema=schema)


#: kind 0: a document; 1: postings of a run in one range, of shingles that it holds once; 2: the nodes of a run;
#: 3: its postings of shingles that it holds more often, whose range gets only (4) how often.
SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *[(c, pa.int64()) for c in ("row_key", "doc_id", "node")], ("n", pa.int32()), ("run", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
COUNTED = pa.schema([SENT.field(k) for k in range(1, len(SENT))])
#: kind 0: a node with its point and recurring shingles; 1: prefix postings in one range.
CHOSEN = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("part", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
MEMBER = pa.schema([(c, pa.int64()) for c in ("cell", "node", "top")])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _posted(docs: DataFrame, ranges: int) -> DataFrame:
    """Documents, runs of nodes, and all postings (shingle, document of the run) by range of shingles."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        seen: set[int] = set()
        part, runs, total = TaskContext.get().partitionId(), 0, 0
        held, nodes, sizes, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal runs
            both = np.sort(np.concatenate(held))  # 48 bits of the shingle, 16 of the document's place
            shingles, places = both >> np.uint64(16), (both & np.uint64(FLUSH_DOCS - 1)).astype("<u2")
            run, spread = (part << 31) + runs, part + 7919 * runs
            runs += 1
            first = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
            times = np.diff(np.r_[first, len(shingles)])
            often, local = times > 1, np.repeat(times > 1, times)
            alone, those, again, times = shingles[~local], places[~local], shingles[first[often]], times[often].astype("<u4")
            cuts, more = _cuts(alone, ranges), _cuts(again, ranges)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(cuts[r], cuts[r + 1])
                yield _rows(SENT, 1, part=[r], kind=[1], run=[run], x=[pack(alone[own])], y=[those[own].tobytes()])
            for r in np.flatnonzero(np.diff(more)).tolist():
                own = slice(more[r], more[r + 1])
                yield _rows(SENT, 1, part=[r], kind=[4], run=[run], x=[pack(again[own])], z=[times[own].tobytes()])
            own_shingles, own_places = shingles[local], places[local]
            for k, at in enumerate(range(0, len(own_shingles), CARRIED)):
                yield _rows(SENT, 1, part=[(spread + k) % ranges], kind=[3], run=[run], x=[pack(own_shingles[at : at + CARRIED])], y=[own_places[at : at + CARRIED].tobytes()])
            yield _rows(SENT, 1, part=[spread % ranges], kind=[2], run=[run], x=[np.array(nodes, "<i8").tobytes()], y=[np.array(sizes, "<u4").tobytes()])
            for own in (held, nodes, sizes):
                own.clear()

        for batch in batches:
            ids, ns = [], []
            for _, own in shingle_sets(batch.column("_text")):
                node = set_id(own)
                ids.append(node)
                ns.append(len(own))
                if not len(own) or node in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(node)
                held.append((own >> np.uint64(16) << np.uint64(16)) + np.uint64(len(nodes)))
                nodes.append(node)
                sizes.append(len(own))
                size += len(own)
                if size >= FLUSH or len(nodes) == FLUSH_DOCS:
                    yield from flush()
                    size = 0
            m = len(ids)
            yield _rows(SENT, m, part=((total + np.arange(m)) * 7919 + part) % ranges, kind=np.zeros(m, np.int32), row_key=batch.column("_key"), doc_id=batch.column("_id"), node=ids, n=ns)
            total += m
        if size:
            yield from flush()
        trim()

    keyed = docs.select(row_key("doc_id", "_text").alias("_key"), F.col("doc_id").cast("long").alias("_id"), "_text")
    return keyed.mapInArrow(post, _ddl(SENT))


def _recurring(posted: DataFrame) -> DataFrame:
    """Of the postings those whose shingle two documents or more have, with its frequency, by run.

    A shingle comes to its range once from each run, however many documents have it.
    """

    def count(table: pa.Table) -> pa.Table:
        counts = pc.is_in(table["kind"], pa.array([1, 4], pa.int32()))
        rest = table.filter(pc.invert(counts)).select(COUNTED.names)
        posts = table.filter(counts).select(["kind", "run", "x", "y", "z"])
        out = [rest.cast(COUNTED)]
        if len(posts):
            runs = np.unique(posts["run"].to_numpy())
            many = [len(y) // 2 if y is not None else len(z) // 4 for y, z in zip(posts["y"].to_pylist(), posts["z"].to_pylist(), strict=True)]
            places = np.concatenate([np.frombuffer(y, "<u2") if y is not None else np.zeros(n, np.uint16) for y, n in zip(posts["y"].to_pylist(), many, strict=True)])
            weight = np.concatenate([np.frombuffer(z, "<u4").astype(np.int64) if z is not None else np.ones(n, np.int64) for z, n in zip(posts["z"].to_pylist(), many, strict=True)])
            shingles = np.concatenate([unpack(x, n) for x, n in zip(posts["x"].to_pylist(), many, strict=True)])
            run = np.repeat(np.searchsorted(runs, posts["run"].to_numpy()).astype(np.int32), many)
            alone = np.repeat(posts["kind"].to_numpy() == 1, many)
            order = np.argsort(shingles)
            shingles = shingles[order]
            first = np.flatnonzero(np.r_[True, shingles[1:] != shingles[:-1]])
            times = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.r_[first, len(shingles)]))
            often = times > 1
            order, shingles, times = order[often], shingles[often], np.minimum(times[often], (1 << 32) - 1).astype("<u4")
            for kind, mine in ((1, alone[order]), (4, ~alone[order])):
                at, own, n = order[mine], shingles[mine], times[mine]
                by_run = np.argsort(run[at], kind="stable")
                place, own, n = places[at][by_run], own[by_run], n[by_run]
                cuts = np.searchsorted(run[at][by_run], np.arange(len(runs) + 1))
                some = np.flatnonzero(np.diff(cuts)).tolist()
                parts = [slice(cuts[k], cuts[k + 1]) for k in some]
                out.append(pa.Table.from_batches([_rows(COUNTED, len(some), kind=np.full(len(some), kind, np.int32), run=runs[some], x=[pack(own[p]) for p in parts], y=[place[p].tobytes() for p in parts] if kind == 1 else None, z=[n[p].tobytes() for p in parts])]))
        trim()
        return pa.concat_tables(out)

    return posted.groupBy("part").applyInArrow(count, _ddl(COUNTED))


def _chosen(counted: DataFrame, ranges: int) -> DataFrame:
    """Nodes whose prefix reaches recurring shingles, and the postings of these prefixes by range."""

    def choose(table: pa.Table) -> pa.Table:
        names = table.filter(pc.equal(table["kind"], 2)).to_pylist()[0]
        posts, local, known = (table.filter(pc.equal(table["kind"], k)).select(["x", "y", "z"]).to_pylist() for k in (1, 3, 4))
        nodes, sizes = np.frombuffer(names["x"], "<i8"), np.frombuffer(names["y"], "<u4").astype(np.int64)
        if not posts and not local:
            return pa.table({f.name: pa.nulls(0, f.type) for f in CHOSEN}, schema=CHOSEN)
        shingles = [unpack(r["x"], len(r["y"]) // 2) for r in posts + local]
        place = np.concatenate([np.frombuffer(r["y"], "<u2") for r in posts + local])
        times = [np.frombuffer(r["z"], "<u4") for r in posts]
        if local:
            asked, told = np.concatenate([unpack(r["x"], len(r["z"]) // 4) for r in known]), np.concatenate([np.frombuffer(r["z"], "<u4") for r in known])
            order = np.argsort(asked)
            times += [told[order[np.searchsorted(asked[order], own)]] for own in shingles[len(posts) :]]
        shingles, times = np.concatenate(shingles), np.concatenate(times)
        order = np.lexsort((shingles, times, place))
        place, times, shingles = place[order], times[order], shingles[order]
        cuts = np.searchsorted(place, np.arange(len(nodes) + 1))
        many = np.diff(cuts)
        wanted = sizes - -(-3 * sizes // 4) + 1 - (sizes - many)  # what the unique shingles leave of the prefix
        kept = np.flatnonzero(wanted > 0)
        sets = [np.sort(shingles[cuts[k] : cuts[k + 1]]) for k in kept]
        out = [_rows(CHOSEN, len(kept), kind=np.zeros(len(kept), np.int32), node=nodes[kept], n=sizes[kept].astype(np.int32), k=many[kept].astype(np.int32), x=[group_counts(s, int(sizes[k])) for s, k in zip(sets, kept, strict=True)], y=[pack(s) for s in sets])]
        if len(kept):
            at = np.repeat(cuts[kept] - np.r_[0, np.cumsum(wanted[kept])[:-1]], wanted[kept]) + np.arange(wanted[kept].sum())
            cell, owner, salts = shingles[at], np.repeat(nodes[kept], wanted[kept]), -(-times[at].astype(np.int64) // SALT_NODES)
            salted = salts > 1
            salt = owner.astype(np.uint64) % np.maximum(salts, 1).astype(np.uint64)
            top = np.where(salted, cell, np.uint64(0))
            cell = np.where(salted, mix(cell * np.uint64(0x9E3779B97F4A7C15) + salt + np.uint64(1)) >> np.uint64(16), cell)
            order = np.argsort(cell)
            cell, owner, top = cell[order], owner[order], top[order]
            edges = _cuts(cell, ranges)
            parts = [(r, slice(edges[r], edges[r + 1])) for r in np.flatnonzero(np.diff(edges)).tolist()]
            out.append(_rows(CHOSEN, len(parts), kind=np.ones(len(parts), np.int32), part=[r for r, _ in parts], x=[pack(cell[p]) for _, p in parts], y=[owner[p].tobytes() for _, p in parts], z=[top[p].tobytes() if top[p].any() else None for _, p in parts]))
        trim()
        return pa.Table.from_batches(out)

    return counted.where("kind > 0").groupBy("run").applyInArrow(choose, _ddl(CHOSEN))


def _members(chosen: DataFrame) -> DataFrame:
    """(cell, node, top) of the cells of two nodes or more; ``top`` is the shingle of a salted cell, else 0.

    Cells of the same nodes have the same name, wherever they came up.
    """

    def meet(table: pa.Table) -> pa.Table:
        cells = np.concatenate([unpack(x.as_py(), len(y.as_py()) // 8) for x, y in zip(table["x"], table["y"], strict=True)])
        nodes = np.concatenate([np.frombuffer(y.as_py(), "<i8") for y in table["y"]])
        tops = np.concatenate([np.frombuffer(z.as_py(), "<u8") if z.is_valid else np.zeros(len(y.as_py()) // 8, np.uint64) for y, z in zip(table["y"], table["z"], strict=True)])
        order = np.lexsort((nodes, cells))
        cells, nodes, tops = cells[order], nodes[order], tops[order]
        new = np.r_[True, (cells[1:] != cells[:-1]) | (nodes[1:] != nodes[:-1])]
        cells, nodes, tops = cells[new], nodes[new], tops[new]
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        sizes = np.diff(np.r_[first, len(cells)])
        sums, names = set_ids(nodes, first, sizes), cells[first]
        names = np.where(tops[first] > 0, names, sums)
        wanted = np.flatnonzero((sizes > 1) | (tops[first] > 0))
        _, some = np.unique(names[wanted], return_index=True)
        wanted = wanted[some]
        sizes = sizes[wanted]
        at = np.repeat(first[wanted] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        trim()
        return pa.table([np.repeat(names[wanted], sizes).astype(np.int64), nodes[at], tops[at].astype(np.int64)], schema=MEMBER)

    return chosen.where("kind = 1").select("part", "x", "y", "z").groupBy("part").applyInArrow(meet, _ddl(MEMBER)).distinct()


def _largest_cells(members: DataFrame) -> DataFrame:
    """``members`` with the cell's size m, but for cells whose nodes all lie in one larger cell, which meets them too.

    A cell is compared with the four largest cells of each of its nodes; what that misses stays,
    and so do salted parts.
    """
    sized = members.join(members.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    largest = F.slice(F.sort_array(F.collect_list(F.struct("m", "cell")), False), 1, 4)  # a node has as many cells as a prefix shingles at most
    larger = sized.where("top = 0").groupBy("node").agg(largest.alias("largest"))
    held = sized.where("top = 0").join(larger, "node").select("cell", "m", F.explode("largest").alias("in")).where("in.m > m or (in.m = m and in.cell > cell)")
    within = held.groupBy("cell", "m", F.col("in.cell").alias("in")).agg(F.count("*").alias("shared")).where("shared = m").select("cell").distinct()
    return sized.join(within, "cell", "left_anti")


def _first_pairs(members: DataFrame, points: DataFrame) -> DataFrame:
    """For each node of a cell its allowed partner of the highest bound, and the cell's node of the most partners if allowed.

    Cells share trees in buckets of about ``BLOCK`` nodes; a larger cell is cut into blocks.
    """
    trees = n_tasks(members.sparkSession, members.count(), BLOCK)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(F.lit(0))
    named = members.select(F.xxhash64("cell", block).alias("cell"), "node")
    dealt = named.withColumn("tree", F.pmod("cell", F.lit(trees))).join(points.select("node", "n", "counts"), "node").select("tree", "cell", "node", "n", "counts")

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, cells, sizes = (frame[c].to_numpy(np.int64) for c in ("node", "cell", "n"))
        points_ = Points(list(frame["counts"]))
        out = [np.empty((0, 3), np.int64)]
        for a, b, _ in CountTree(points_.coarse, sizes, cells).pairs():
            bound = points_.bound(a, b)
            keep = possible(sizes[a], sizes[b], bound)
            out.append(np.stack([a[keep], b[keep], bound[keep]], 1))
        x, y, bound = np.concatenate(out).T
        x, y, bound = np.r_[x, y], np.r_[y, x], np.r_[bound, bound]
        order = np.lexsort((nodes[y], -bound, x))
        best = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(x) else order
        partners = np.bincount(x, minlength=len(nodes))
        by_cell = np.lexsort((nodes, -partners, cells))
        hubs = np.zeros(len(nodes), bool)
        hubs[by_cell[np.r_[True, cells[by_cell][1:] != cells[by_cell][:-1]]]] = True
        chosen = np.r_[best, np.flatnonzero(hubs[x])]
        a, b = nodes[x[chosen]], nodes[y[chosen]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        trim()
        return pd.DataFrame(pairs, columns=["a", "b"])

    return dealt.groupBy("tree").applyInPandas(find, "a long, b long")


def _top(group: np.ndarray, other: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Rank of each pair by falling bound among those of one node and one foreign label."""
    order = np.lexsort((-bound, other, group))
    g, o = group[order], other[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])] if len(g) else np.empty(0, bool)
    index = np.arange(len(order))
    rank = np.empty(len(order), np.int64)
    rank[order] = index - np.maximum.accumulate(np.where(new, index, 0))
    return rank


def _mixed_cells(members: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cell, node, label, major, m, minor) of cells with nodes of several components.

    Salted parts are one cell again, but nothing is grouped by it before its parts are: per part
    and label there is one row, and these make the cell's sums. ``major`` tells the nodes of the
    cell's largest component; ``m`` and ``minor`` count those and the others.
    """
    named = scratch.save(members.join(labels, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("label"), F.when(F.col("top") != 0, F.col("top")).otherwise(F.col("cell")).alias("whole")), f"{name}-named")
    parts = named.groupBy("whole", "cell", "label").agg(F.count("*").alias("k"))
    by_label = parts.groupBy("whole", "label").agg(F.sum("k").alias("k"))
    whole = by_label.groupBy("whole").agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    sums = parts.select("whole", "cell").distinct().join(whole, "whole").select("cell", F.col("most.label").alias("main"), F.col("most.k").alias("m"), (F.col("all") - F.col("most.k")).alias("minor"))
    return scratch.save(named.join(sums, "cell").select(F.col("whole").alias("cell"), "node", "label", (F.col("label") == F.col("main")).alias("major"), "m", "minor"), name)


def _mixed_pairs(mixed: DataFrame, points: DataFrame, each: int) -> DataFrame:
    """(a, b, bound) of pairs of different components that the R-trees of mixed cells allow.

    Small cells share a tree. In larger ones the nodes of the largest component and the others
    are cut into blocks apart; every two blocks have a tree, but for two of the largest component.
    Of the pairs of a node with one foreign component the ``each`` ones of the highest bounds come,
    as long as the other node has as few; a row with a = b tells that others were left.
    """
    trees = n_tasks(mixed.sparkSession, mixed.count(), BLOCK)
    large = F.col("m") + F.col("minor") > BLOCK
    p, q = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("minor") / BLOCK).cast("int")
    hashed = F.xxhash64("node")
    block = F.when(~large, F.lit(0)).when(F.col("major"), F.pmod(hashed, p)).otherwise(p + F.pmod(hashed, q)).cast("int")
    others = F.when(~large, F.array(F.lit(0))).when(F.col("major"), F.sequence(p, p + q - 1)).otherwise(F.sequence(F.lit(0), p + q - 1))
    placed = mixed.select(F.when(large, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(trees))).alias("tree"), large.alias("large"), "cell", "node", "label", block.alias("block"), F.explode(others).alias("other"))
    dealt = placed.join(points.select("node", "n", "counts"), "node").select("large", "tree", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cell", "block", "node", "label", "n", "counts")

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        across = frame["i"].iloc[0] != frame["j"].iloc[0]
        nodes, labels, block, cell = (frame[c].to_numpy(np.int64) for c in ("node", "label", "block", "cell"))
        points_, sizes = Points(list(frame["counts"])), frame["n"].to_numpy(np.int64)
        out = [np.empty((0, 3), np.int64)]
        for a, b, _ in CountTree(points_.coarse, sizes, cell).pairs():
            keep = labels[a] != labels[b]
            if across:
                keep &= block[a] != block[b]
            a, b = a[keep], b[keep]
            bound = points_.bound(a, b)
            keep = possible(sizes[a], sizes[b], bound)
            out.append(np.stack([a[keep], b[keep], bound[keep]], 1))
        a, b, bound = np.concatenate(out).T
        keep = np.maximum(_top(nodes[a], labels[b], bound), _top(nodes[b], labels[a], bound)) < each
        found = pd.DataFrame({"a": np.minimum(nodes[a], nodes[b])[keep], "b": np.maximum(nodes[a], nodes[b])[keep], "bound": bound[keep]}).drop_duplicates()
        if not keep.all():
            found.loc[len(found)] = [0, 0, 0]
        trim()
        return found.astype("int64")

    return dealt.groupBy("large", "tree", "i", "j").applyInPandas(find, "a long, b long, bound long").distinct()


def _best_untested(allowed: DataFrame, tested: DataFrame, labels: DataFrame, each: int) -> DataFrame:
    """For each node and foreign component the ``each`` allowed pairs of the highest bounds not tested yet."""
    fresh = allowed.join(tested, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        named = labels.select(F.col("node").alias(side), F.col("component").alias(f"l{side}"))
        fresh = fresh.join(named, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    fresh = fresh.where("la <> lb")
    order = [F.desc("bound"), "a", "b"]
    rank = F.greatest(F.row_number().over(Window.partitionBy("a", "lb").orderBy(*order)), F.row_number().over(Window.partitionBy("b", "la").orderBy(*order)))
    return fresh.withColumn("r", rank).where(F.col("r") <= each).select("a", "b")


def _verified(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) that link, by their recurring shingles and sizes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, k, m, n_a, n_b in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "k_a", "k_b", "n_a", "n_b")), strict=True):
                shared = len(np.intersect1d(unpack(x, k), unpack(y, m), assume_unique=True))
                keep.append(100 * shared >= 75 * (n_a + n_b - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    side = lambda c, h: points.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("k").alias(f"k_{c}"), F.col("shingles").alias(h))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "k_a", "k_b", "n_a", "n_b").mapInArrow(compare, "a long, b long")


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id, n_copies (documents of its shingle set)."""
    return _joined(docs, Scratch(docs.sparkSession, "jaccard"), text, doc_id)


def _joined(docs: DataFrame, scratch: Scratch, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    with arrow_limits(spark):
        labels, nodes = _components(docs, scratch)
    groups = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    named = groups.join(labels, "node", "left").select("node", "least_id", "copies", F.coalesce("component", "node").alias("label"))
    named = scratch.save(named, "groups")
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    final = scratch.save(named.join(least, "label").select("node", "component_id", "copies"), "final")
    found = nodes.where("n > 0").join(final, "node").select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("copies").alias("n_copies"))
    blank = nodes.where("n = 0").select("doc_id", "row_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return found.unionByName(blank)


def _components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, component) of nodes that link, and the documents: row_key, doc_id, node, n."""
    spark = docs.sparkSession
    ranges = n_tasks(spark, docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0, RANGE_BYTES)
    counted = scratch.save(_recurring(_posted(docs, ranges)), "counted")
    nodes = scratch.save(counted.where("kind = 0").select("row_key", "doc_id", "node", "n"), "nodes")
    chosen = scratch.save(_chosen(counted, ranges), "chosen")
    scratch.drop("counted")
    release(spark)  # the postings' shuffle
    members = scratch.save(_largest_cells(scratch.save(_members(chosen), "cells")), "members")
    # points lie in buckets of their node, so that no later join deals them again
    points = chosen.where("kind = 0").select("node", "n", "k", F.col("x").alias("counts"), F.col("y").alias("shingles")).repartition(ranges, "node")
    points = points.join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    points = scratch.save_bucketed(points, "points", "node", ranges)
    for done in ("chosen", "cells"):
        scratch.drop(done)
    release(spark)
    # the parts of a salted cell meet by their smallest nodes
    tops = members.where("top <> 0").groupBy("top", "cell").agg(F.min("node").alias("node"))
    top_pairs = tops.join(tops.groupBy("top").agg(F.min("node").alias("least")), "top").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    tested = scratch.save(_first_pairs(members, points).unionByName(top_pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tested0")
    links = scratch.save(_verified(tested, points), "links0")
    labels = scratch.save(components(links, scratch, "labels0-"), "labels0")
    step, each = 0, 4
    while True:
        mixed = _mixed_cells(members, labels, scratch, f"mixed{each}")
        if mixed.isEmpty():
            break
        allowed = scratch.save(_mixed_pairs(mixed, points, each), f"allowed{each}")
        for more_each in (each, 256 * each, ALL):
            step += 1
            fresh = scratch.save(_best_untested(allowed.where("a <> b"), tested, labels, more_each), f"fresh{step}")
            if fresh.isEmpty():  # the best of all untested pairs would be first for both its nodes
                break
            tested = scratch.save(tested.unionByName(fresh), f"tested{step}")
            more = scratch.save(_verified(fresh, points), f"links{step}")
            if more.isEmpty():
                continue
            links = scratch.save(links.unionByName(more), f"all{step}")
            labels = scratch.save(components(links, scratch, f"labels{step}-"), f"labels{step}")
        if allowed.where("a = b").isEmpty():
            break
        each = ALL  # pairs were left out: look again at the cells that are still mixed
    scratch.drop_table("points")
    return labels, nodes


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, the one of the smallest doc_id; columns as in ``docs``.

    Documents without shingles or without doc_id all stay, but for repeats of one row (equal
    doc_id and text).
    """
    scratch, own = Scratch(docs.sparkSession, "keep"), Scratch(docs.sparkSession, "jaccard")
    joined = _joined(docs, own, text, doc_id)
    stay = joined.where((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = scratch.save(stay.groupBy("row_key").agg(F.count("*").alias("rows")), "stay")
    own.drop()
    release(docs.sparkSession)
    keyed = packed_columns(docs, doc_id, text, renamed=("doc_id", "body")).select(row_key("doc_id", "body").alias("row_key"), "row").join(stay, "row_key")
    # repeats of one row are few; only they go through a distinct of whole rows
    kept = keyed.where("rows = 1").unionByName(keyed.where("rows > 1").dropDuplicates(["row_key"]))
    return unpacked(kept, docs)
