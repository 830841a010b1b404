"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words that repeats with some smallest period and that no neighbouring
word extends. Squares (two equal halves in a row) of primitive halves are the stones of runs:

1. The LZ blocks of a text are cut. Around each block end, longest common extensions to both
   sides give squares that cover the leftmost occurrence of every square up to rotation.
2. From these, suffix links of the suffix tree lead to the next rotation: the square without its
   first word, continued by that word, if the tree has such a path. Rotations that follow each
   other in one place are taken in one stride. What is reached is the whole vocabulary of squares.
3. The leaves below a square's place in the tree are its occurrences; occurrences of one period at
   consecutive words merge into a run.

The suffix tree is held as a suffix array with minima of its common prefixes, where a place of the tree
is an interval; all steps are numpy passes over many texts at once, which share no symbol, so each text has
a subtree of its own. Before that, words that stand in no 5-word window found twice in their text are cut
out: a run of ``length >= max(6, 4 * period)`` lies in such windows whole, so this loses none. Windows are
compared by 64-bit hashes there (equal ones by chance only keep more words), words by
themselves afterwards.

Texts are independent rows: nothing is shuffled, and a lost executor costs the splits it was
reading. A task holds one Arrow batch of texts and, of the words that are left, about 520 bytes for each of
``GROUP_WORDS`` or of the longest text, whichever is more.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text; equal
rows get equal results; a text that is one word over and over is one run of period 1; further
columns of the input are carried along; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, free_names, trim
from roadlark.llm.hashing import SEGMENT, WORDS_IN_SHINGLE, mix, powers, shingles, texts, word_spans

#: A run has at least so many words and so many times its period. The cut of unrepeated words needs at least these.
MIN_WORDS, MIN_PERIODS = 6, 4
GROUP_WORDS = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_letters = np.random.default_rng(20240612).integers(1, 1 << 63, 256, dtype=np.uint64)


class Index:
    """Suffix array, and common extensions of pairs of positions, of symbols whose first and last occur once."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self.symbols = rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
        self.levels: list[np.ndarray] = []  # level k: equal numbers for equal blocks of 2**k symbols
        step = 1
        while rank.max() < n:
            self.levels.append(rank.astype(np.int32))
            key = rank * (n + 1)
            key[: n - step] += rank[step:]
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
            step *= 2
        self.rank = rank - 1
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        common = np.zeros(n, np.int32)
        common[1:] = self.forward(self.order[:-1], self.order[1:])
        self.least = [common]  # level k: the least common prefix of 2**k neighbours
        while 2 << len(self.least) <= 2 * n:
            half, last = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on; i and j differ."""
        i, j = i.copy(), j.copy()
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += same
            j += same
            out += same
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i (inclusive) equal those up to j; -1 is before the first."""
        i, j = i + 1, j + 1
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (np.minimum(a, b) >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            i -= step
            j -= step
            out += step
        return out

    def first_below(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """First place in the suffix array of those suffixes that share ``size`` symbols with the one at ``at``."""
        at = at.copy()
        for k in range(len(self.least) - 1, -1, -1):
            low = at - (1 << k) + 1
            ok = (low >= 1) & (self.least[k][np.clip(low, 0, len(self.least[k]) - 1)] >= size)
            at -= ok.astype(np.int64) << k
        return at

    def last_below(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = at.copy()
        for k in range(len(self.least) - 1, -1, -1):
            low = at + 1
            ok = (low < len(self.least[k])) & (self.least[k][np.minimum(low, len(self.least[k]) - 1)] >= size)
            at += ok.astype(np.int64) << k
        return at

    def blocks(self) -> np.ndarray:
        """Starts of the LZ blocks: the longest stretches that also begin earlier, or single symbols."""
        n = self.n
        before, after = np.full(n + 1, n), np.full(n + 1, n)
        before[self.order[1:]], after[self.order[:-1]] = self.order[:-1], self.order[1:]
        left, right = before.tolist(), after.tolist()
        for i in range(n - 1, -1, -1):  # what is left of the order then are the earlier positions
            a, b = left[i], right[i]
            right[a], left[b] = b, a
        at, longest = np.arange(n), np.zeros(n, np.int64)
        for side in (left, right):
            near = np.array(side[:n])
            own = np.flatnonzero(near < n)
            longest[own] = np.maximum(longest[own], self.forward(at[own], near[own]))
        steps, i, out = np.maximum(longest, 1).tolist(), 0, []
        while i < n:
            out.append(i)
            i += steps[i]
        return np.array(out)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, ``size`` of them."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def leftmost(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover, up to rotation, the leftmost occurrence of each square."""
    h = index.blocks()
    end = np.r_[h[1:], index.n]
    size = end - h
    near, both = np.where(end < index.n, size, 0), size + np.r_[size[1:], 0]
    # pairs (x, x + k): the block's end and each place in it, the block's start and each place in it and in the next one
    k = np.r_[_ranges(np.ones(len(h), np.int64), near), _ranges(np.ones(len(h), np.int64), both)]
    x = np.r_[np.repeat(end, near), np.repeat(h, both)]
    x[: near.sum()] -= k[: near.sum()]
    ok = (x + k < index.n) & (index.symbols[x] == index.symbols[np.minimum(x + k, index.n - 1)])
    x, k = x[ok], k[ok]
    on, back = index.forward(x, x + k), index.backward(x - 1, x + k - 1)
    ok = on + back >= k
    x, k, back = x[ok], k[ok], back[ok]
    return np.maximum(x - back, x - k + 1), k


def primitive(index: Index, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no repetition itself."""
    top = int(period.max(initial=1)) + 1
    prime = np.arange(top)
    for p in range(2, int(top**0.5) + 1):
        if prime[p] == p:
            own = prime[p * p :: p]
            own[own == np.arange(p * p, top, p)] = p
    out, rest = np.ones(len(start), bool), period.copy()
    while (live := np.flatnonzero(rest > 1)).size:
        p = prime[rest[live]]
        part = period[live] // p
        out[live] &= index.forward(start[live], start[live] + part) < 2 * period[live] - part
        rest[live] //= p
        while (again := rest[live] % p == 0).any():
            rest[live[again]] //= p[again]
    return out


def rotations(index: Index, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of one occurrence of every square that suffix links reach from the given ones."""
    found, left, seen = [], period.copy(), np.empty(0, np.int64)
    while len(start):
        run = np.minimum(index.forward(start, start + period) - period + 1, left)
        found.append((start, period, run))
        left = left - run
        go = left > 0
        start, period, left = (start + run)[go], period[go], left[go]
        # start is now the second word of the last square: is that square's first word found behind the rest of it?
        size, word = 2 * period - 1, index.symbols[start - 1]
        low, high = index.first_below(index.rank[start], size), index.last_below(index.rank[start], size)
        last = high.copy()
        while (open_ := low < high).any():
            half = (low + high) // 2
            less = index.symbols[index.order[half] + size] < word
            low = np.where(open_ & less, half + 1, low)
            high = np.where(open_ & ~less, half, high)
        hit = (low <= last) & (index.symbols[index.order[np.minimum(low, index.n - 1)] + size] == word)
        start, period, left = index.order[low[hit]], period[hit], left[hit]
        # the place in the tree tells whether a walk has been there
        place = index.first_below(index.rank[start], 2 * period) * (index.n + 1) + period
        new = np.unique(place, return_index=True)[1]
        new = new[~np.isin(place[new], seen)]
        seen = np.r_[seen, place[new]]
        start, period, left = start[new], period[new], left[new]
    start, period, run = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in range(3))
    return _ranges(start, run), np.repeat(period, run)


def find_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods or more, by period and start. First and last symbol occur once."""
    index = Index(symbols)
    start, period = leftmost(index)
    ok = primitive(index, start, period)
    start, period = start[ok], period[ok]
    # squares of one run are one walk, from the leftmost of them
    run = start - index.backward(start - 1, start + period - 1)
    order = np.lexsort((start, period, run))
    first = np.r_[True, (np.diff(run[order]) != 0) | (np.diff(period[order]) != 0)] if len(order) else np.empty(0, bool)
    start, period = rotations(index, start[order[first]], period[order[first]])
    low = index.first_below(index.rank[start], 2 * period)
    own = np.unique(low * (index.n + 1) + period, return_index=True)[1]
    low, period = low[own], period[own]
    times = index.last_below(low, 2 * period) - low + 1
    key = np.sort(np.repeat(period, times) * (index.n + 1) + index.order[_ranges(low, times)])
    cut = np.flatnonzero(np.r_[True, np.diff(key) != 1]) if len(key) else np.empty(0, np.int64)
    period, start = key[cut] // (index.n + 1), key[cut] % (index.n + 1)
    return start, np.diff(np.r_[cut, len(key)]) - 1 + 2 * period, period


def _word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first])


def repeating(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words before each text and in all, whether a word stands in a 5-word window found twice in its text)."""
    first, last = word_spans(data, starts[:-1]) if len(data) else (np.empty(0, np.int64),) * 2
    bounds = np.searchsorted(first, starts)
    covered = np.zeros(len(first), bool)
    if len(first) < WORDS_IN_SHINGLE:
        return bounds, covered
    windows = shingles(_word_hashes(data, first, last))
    text = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(bounds))
    inside = text[: len(windows)] == text[WORDS_IN_SHINGLE - 1 :]
    at = np.flatnonzero(inside)
    keys = mix(windows[at] + text[at] * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    depth = np.zeros(len(first) + 1, np.int64)
    depth[at[twice]] += 1
    depth[at[twice] + WORDS_IN_SHINGLE] -= 1
    np.cumsum(depth[:-1], out=depth[:-1])
    return bounds, depth[:-1] > 0


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, mask, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_runs(column: pa.Array, min_words: int, min_periods: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, its runs as rows (start, length, period) by start and period) of every text."""
    data, at = texts(column)
    own, starts = data[at[0] : at[-1]], at - at[0]
    row = 0
    while row < len(starts) - 1:
        to = max(row + 1, int(np.searchsorted(starts, starts[row] + SEGMENT, "right")) - 1)
        part = own[starts[row] : starts[to]]
        bounds, covered = repeating(part, starts[row : to + 1] - starts[row])
        held, size = [], 0
        for k in range(row, to):
            words = own[starts[k] : starts[k + 1]].tobytes().split()
            a, b = _stretches(covered[bounds[k - row] : bounds[k - row + 1]])
            long = b - a >= min_words
            held.append((words, a[long], b[long]))
            size += int((b - a)[long].sum())
            if size >= GROUP_WORDS:
                yield from _found(held, min_words, min_periods)
                held, size = [], 0
        yield from _found(held, min_words, min_periods)
        row = to


def _found(held: list[tuple[list[bytes], np.ndarray, np.ndarray]], min_words: int, min_periods: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    symbols, owner, place, known, single = [], [], [], 0, -1
    for k, (words, first, last) in enumerate(held):
        if not len(first):
            continue
        ids: dict[bytes, int] = {}
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            symbols.append(np.array([single]))
            symbols.append(np.array([known + ids.setdefault(w, len(ids)) for w in words[a:b]]))
            owner += [k, k]
            place += [a - 1, a]
            single -= 1
        known += len(ids)
    none = np.empty((0, 3), np.int64)
    if not symbols:
        for words, _, _ in held:
            yield words, none
        return
    size = np.array([len(x) for x in symbols])
    ends = np.cumsum(size)
    start, length, period = find_runs(np.concatenate([*symbols, [single]]))
    ok = length >= np.maximum(min_words, min_periods * period)
    start, length, period = start[ok], length[ok], period[ok]
    piece = np.searchsorted(ends, start, "right")
    text = np.array(owner)[piece]
    start = np.array(place)[piece] + start - (ends - size)[piece]
    order = np.lexsort((period, start, text))
    rows, text = np.stack([start, length, period], axis=1)[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(held) + 1))
    for k, (words, _, _) in enumerate(held):
        yield words, rows[bounds[k] : bounds[k + 1]]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def runs(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, with_text: bool = False) -> DataFrame:
    """``docs`` and n_words, runs (array of start, length, period by start, then period), strongest (the run of the greatest
    length/period; of equal ones the first, then that of the least period) and collapsed_sha256; ``with_text`` adds collapsed, the text without
    the repetitions."""
    if min_words < MIN_WORDS or min_periods < MIN_PERIODS:
        raise ValueError(f"runs are found from {MIN_WORDS} words and {MIN_PERIODS} periods on")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "runs")
    names = free_names(docs, "n_words", "runs", "strongest", "collapsed_sha256", *(["collapsed"] if with_text else []))
    kept = docs if with_text else docs.drop(text)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    run = "struct<start: long, length: long, period: long>"
    row_kind = dict(source.dtypes)["row"]
    result = f"row {row_kind}, n_words long, runs array<{run}>, strongest {run}, sha string" + (", collapsed string" if with_text else "")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, best, sha, kept_text = [], [], [], [], []
            for words, own in text_runs(batch.column("text"), min_words, min_periods):
                short = collapsed(words, own)
                listed = [{"start": a, "length": b, "period": c} for a, b, c in own.tolist()]
                n.append(len(words))
                found.append(listed)
                best.append(min(listed, key=lambda x: (-Fraction(x["length"], x["period"]), x["start"], x["period"])) if listed else None)
                sha.append(hashlib.sha256(short).hexdigest())
                if with_text:
                    kept_text.append(short.decode())
            columns = [batch.column("row"), pa.array(n, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(best, RUN), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept_text, pa.string())] if with_text else []), ["row", "n_words", "runs", "strongest", "sha"] + (["collapsed"] if with_text else []))
        trim()

    with arrow_limits(spark, rows=1024):
        out = scratch.save(source.mapInArrow(find, result), "runs")
    renamed = zip(("n_words", "runs", "strongest", "sha", "collapsed"), names, strict=False)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept.columns], *[F.col(a).alias(b) for a, b in renamed])


def spelled(found: Column) -> Column:
    """Each run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(found, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
