"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | history) * P(word | class, previous token). Both factors
are log-linear: the class factor has a bias and the hashed features previous token, token
before it (skip) and their pair; the word factor has a bias and the previous token. Classes
are hashed from a word's last two bytes. The most frequent ``MODEL_WORDS`` words are outcomes of
their own, each class has one more outcome for its other words, and these share it by their
smoothed training counts, so all probabilities sum to one over the training vocabulary and
one unknown word.

Counts cover all training texts: word counts, and how often each outcome follows each hashed
history. The gradient of the log-likelihood needs nothing else, so training repeats
distributed gradient steps over these tables, whose size the model fixes and not the corpus.
On top of that every pair of tokens seen twice or more, the second one a head word, is an
n-gram feature of its own. Given the first token and the class, the words' weights meet those
of no other first token, so each hash range takes its gradient steps by itself; this table
grows with the corpus and stays in Spark. Scoring works on arrays of a batch's tokens. Counts of
the ``HEAD_WORDS`` most frequent words are broadcast (a fixed bound); all rarer words and all pairs
are looked up by hash range. Pairs after a frequent token are spread over several ranges,
which hold copies of its weights.

Words are compared by 64-bit hashes. Defined cases: a null or empty text is its end token; a
null doc_id is training text; repeated rows are scored alike; without training tokens base
and model fall back to the smoothing alone; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, n_tasks
from roadlark.llm.hashing import SEGMENT, mix, texts, word_hashes, word_spans

CLASSES, PREVIOUS, SKIPPED, PAIRS = 64, 128, 64, 2048
MODEL_WORDS, HEAD_WORDS = 4096, 1 << 18
OUTCOMES = MODEL_WORDS + CLASSES  # words, then each class's rest
END = np.uint64(0x5EED5EED5EED5EED)
START = np.uint64(0x0DD0BEEF0DD0BEEF)
FLUSH = 1 << 21
RANGE_TOKENS, BLOCK = 1 << 21, 1 << 12  # pairs a range, documents a block of sums
LOG10 = float(np.log(10.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, token hashes, token classes, bounds of the rows) for texts of about a segment; each text ends with END."""
    data, at = texts(column)
    row = 0
    while row < len(at) - 1:
        to = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, "right")) - 1)
        own, starts = data[at[row] : at[to]], at[row : to + 1] - at[row]
        if len(own):
            first, last = word_spans(own, starts[:-1])
        else:
            first = last = np.empty(0, np.int64)
        hashes = word_hashes(own, first, last)
        if len(first):
            lower = np.where((own >= 65) & (own <= 90), own + 32, own).astype(np.uint64)
            before = np.where(last - first > 1, lower[last - 2], np.uint64(0))
            classes = (mix(before * np.uint64(257) + lower[last - 1] + np.uint64(1)) % np.uint64(CLASSES)).astype(np.uint8)
        else:
            classes = np.empty(0, np.uint8)
        bounds = np.searchsorted(first, starts)
        ends = bounds[1:]
        yield row, np.insert(hashes, ends, END), np.insert(classes, ends, 0), bounds + np.arange(len(bounds))
        row = to


def before(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Previous token; START before a text."""
    previous = np.r_[START, hashes[:-1]]
    previous[bounds[:-1]] = START
    return previous


def histories(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed previous token and token before it; START before a text."""
    previous = before(hashes, bounds)
    skipped = np.r_[START, previous[:-1]]
    skipped[bounds[:-1]] = START
    return (mix(previous) % np.uint64(PREVIOUS)).astype(np.int64), (mix(skipped ^ START) % np.uint64(SKIPPED)).astype(np.int64)


def _ranges(values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    own = (mix(values) % np.uint64(n)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(n + 1))
    for r in range(n):
        if cuts[r] < cuts[r + 1]:
            yield r, order[cuts[r] : cuts[r + 1]]


def word_counts(docs: DataFrame, ranges: int, scratch: Scratch) -> DataFrame:
    """One row per hash range: sorted words, counts and classes as arrays of bytes, and sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words, kinds = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words)
            words, kinds = words[order], kinds[order]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            times = np.diff(np.r_[first, len(words)]).astype("<i8")
            words, kinds = words[first], kinds[first]
            for r, own in _ranges(words, ranges):
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "words": pa.array([words[own].tobytes()], pa.binary()), "times": pa.array([times[own].astype("<u4").tobytes()], pa.binary()), "kinds": pa.array([kinds[own].tobytes()], pa.binary())})

        for batch in batches:
            for _, hashes, classes, _ in tokens(batch.column("_text")):
                held.append((hashes, classes))
                size += len(hashes)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        times = np.concatenate([np.frombuffer(r["times"], "<u4") for r in rows]).astype("<i8")
        kinds = np.concatenate([np.frombuffer(r["kinds"], np.uint8) for r in rows])
        order = np.argsort(words, kind="stable")
        words, times, kinds = words[order], times[order], kinds[order]
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        sums = np.add.reduceat(times, first)
        return pa.table({"range": pa.array([rows[0]["range"]], pa.int32()), "words": pa.array([words[first].tobytes()], pa.binary()), "times": pa.array([sums.astype("<i8").tobytes()], pa.binary()), "kinds": pa.array([kinds[first].tobytes()], pa.binary()), "n": [int(sums.sum())], "v": [len(first)]})

    parts = docs.where("not held_out").select("_text").mapInArrow(count, "range int, words binary, times binary, kinds binary")
    return scratch.save(parts.groupBy("range").applyInArrow(total, "range int, words binary, times binary, kinds binary, n long, v long"), "words")


def _head(words: DataFrame, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, counts and classes of the HEAD_WORDS most frequent words, by count and hash; gathers only counts above the cut."""
    sizes = [1 << k for k in range(40)]

    def above(table: pa.Table) -> pa.Table:
        out = np.zeros(len(sizes), np.int64)
        for r in table.to_pylist():
            out += np.array([(np.frombuffer(r["times"], "<i8") >= s).sum() for s in sizes])
        return pa.table({"k": np.arange(len(sizes)), "n": out})

    step = words.select("range", "times").groupBy("range").applyInArrow(above, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n_at = {r["k"]: r["n"] for r in step}
    k = next((k for k in range(len(sizes)) if n_at.get(k, 0) <= HEAD_WORDS), len(sizes) - 1)
    cut = sizes[k]  # at most HEAD_WORDS words are this frequent

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                w, t, c = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["times"], "<i8"), np.frombuffer(r["kinds"], np.uint8)
                keep = t >= cut
                yield pa.RecordBatch.from_pydict({"words": pa.array([w[keep].tobytes()], pa.binary()), "times": pa.array([t[keep].tobytes()], pa.binary()), "kinds": pa.array([c[keep].tobytes()], pa.binary())})

    rows = words.select("words", "times", "kinds").mapInArrow(frequent, "words binary, times binary, kinds binary").collect()
    parts = [np.concatenate([np.frombuffer(r[c], t) for r in rows] or [np.empty(0, t)]) for c, t in (("words", np.uint64), ("times", "<i8"), ("kinds", np.uint8))]
    order = np.lexsort((parts[0], -parts[1]))
    return tuple(p[order] for p in parts)


class Tables:
    """What scoring and counting need of the vocabulary: the head, sorted by hash, and which of it are model words."""

    def __init__(self, head: tuple[np.ndarray, np.ndarray, np.ndarray]):
        words, times, kinds = head
        index = np.full(len(words), -1, np.int32)
        index[:MODEL_WORDS] = np.arange(min(MODEL_WORDS, len(words)))
        order = np.argsort(words)
        self.words, self.times, self.index, self.kinds = words[order], times[order], index[order], kinds[order]
        self.model_classes = np.zeros(MODEL_WORDS, np.uint8)
        self.model_classes[: min(MODEL_WORDS, len(kinds))] = kinds[:MODEL_WORDS]
        self.n_model = min(MODEL_WORDS, len(words))

    def find(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or 0 where it isn't in the head, outcome) of each token."""
        rest = MODEL_WORDS + classes.astype(np.int64)
        if not len(self.words):
            return np.zeros(len(hashes), np.int64), rest
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = self.words[at] == hashes
        index = self.index[at]
        return np.where(hit, self.times[at], 0), np.where(hit & (index >= 0), index, rest)


    def codes(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Place of each token in the head; -1 - class outside it."""
        outside = -1 - classes.astype(np.int32)
        if not len(self.words):
            return outside
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1).astype(np.int32)
        return np.where(self.words[at] == hashes, at, outside)

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes >= 0, self.kinds[np.maximum(codes, 0)], -1 - codes).astype(np.int64) if len(self.kinds) else (-1 - codes).astype(np.int64)


def pair_keys(previous: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return mix(previous + mix(codes.astype(np.int64).view(np.uint64)))


class Spread:
    """Ranges of (previous token, class); a previous token of several ranges' tokens has copies in as many."""

    def __init__(self, tables: Tables, n_tokens: int, ranges: int, per_range: int = RANGE_TOKENS):
        self.tables, self.ranges, self.per_range = tables, max(ranges, -(-n_tokens // per_range)), per_range

    def copies(self, previous: np.ndarray) -> np.ndarray:
        own = np.where(previous == START, END, previous)  # as many starts as ends
        times, _ = self.tables.find(own, np.zeros(len(previous), np.uint8))
        return np.minimum(1 + times // self.per_range * 2, self.ranges)

    def range_of(self, previous: np.ndarray, classes: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        first = (pair_keys(previous, -1 - classes) % np.uint64(self.ranges)).astype(np.int64)
        return (first + salt) % self.ranges


def _cut(own: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The values of each range that ``own`` names, in their order."""
    if not len(own):
        return
    order = np.argsort(own, kind="stable")
    own = own[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    for a, b in zip(first, np.r_[first[1:], len(own)], strict=True):
        yield int(own[a]), tuple(x[order[a:b]] for x in values)


def squeeze(x: np.ndarray) -> bytes:
    """32-bit numbers as compressed planes of their bytes."""
    planes = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def squeeze_words(words: np.ndarray, x: np.ndarray) -> bytes:
    """Ascending hashes: the places of those in the sorted ``words``, the hashes of the others, and how often each comes."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)
    own, runs = x[first], np.diff(np.r_[first, len(x)])
    at = np.minimum(np.searchsorted(words, own), max(len(words) - 1, 0))
    hit = words[at] == own if len(words) else np.zeros(len(own), bool)
    parts = [squeeze(np.diff(at[hit], prepend=0)), own[~hit].astype("<u8").tobytes(), squeeze(hit), squeeze(runs)]
    return np.array([len(y) for y in parts], "<u4").tobytes() + b"".join(parts)


def expand_words(words: np.ndarray, data: bytes) -> np.ndarray:
    cuts = 16 + np.cumsum(np.frombuffer(data[:16], "<u4").astype(np.int64))
    places, others, hit, runs = (data[a:b] for a, b in zip((16, *cuts[:-1]), cuts, strict=True))
    hit = expand(hit) == 1
    out = np.empty(len(hit), np.uint64)
    out[hit] = words[np.cumsum(expand(places))] if hit.any() else 0
    out[~hit] = np.frombuffer(others, "<u8")
    return np.repeat(out, expand(runs))


def distinct(previous: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pairs, where each distinct one starts in it)."""
    order = np.lexsort((codes, previous))
    previous, codes = previous[order], codes[order]
    return order, np.flatnonzero(np.r_[True, (previous[1:] != previous[:-1]) | (codes[1:] != codes[:-1])]) if len(order) else np.empty(0, np.int64)


def _packed(own: Tables, r: int, previous: np.ndarray, codes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Pairs in ascending order of the previous token; ``values`` are counts below 2^31 or floats of 32 bits."""
    if values.dtype.kind == "f":
        values = values.astype("<f4").view("<i4")
    return pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "previous": pa.array([squeeze_words(own.words, previous)], pa.binary()), "codes": pa.array([squeeze(codes)], pa.binary()), "amounts": pa.array([squeeze(values)], pa.binary())})


def _unpacked(own: Tables, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate([f(x) for x in table[c].to_pylist()]) for c, f in (("previous", lambda x: expand_words(own.words, x)), ("codes", expand), ("amounts", expand)))


def pair_weights(docs: DataFrame, tables: Tables, word_logs: np.ndarray, spread: Spread, scratch: Scratch, steps: int = 12, rate: float = 0.7, decay: float = 1.0) -> DataFrame:
    """Weights of the pairs seen twice or more, as packed rows by range: (previous, code, weight), and for each
    (previous, class) of such a pair (previous, -1 - class, minus the log of its norm), all in log10.

    ``word_logs`` are log10 probabilities of the outcomes within their classes, before the words'
    shares in their class's rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tables, word_logs, spread))
    schema = "range int, previous binary, codes binary, amounts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _, to = shared.value
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            previous, codes = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = distinct(previous, codes)
            times, at = np.diff(np.r_[first, len(order)]), order[first]
            previous, codes = previous[at], codes[at]
            for r, (p, c, n) in _cut((mix(pair_keys(previous, codes)) % np.uint64(to.ranges)).astype(np.int64), previous, codes, times):
                yield _packed(own, r, p, c, n)

        for batch in batches:
            for _, hashes, classes, bounds in tokens(batch.column("_text")):
                held.append((before(hashes, bounds), own.codes(hashes, classes)))
                size += len(hashes)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def whole(batches_table: pa.Table) -> pa.Table:
        own, _, to = shared.value
        previous, codes, times = _unpacked(own, batches_table)
        order, first = distinct(previous, codes)
        n = np.add.reduceat(times[order].astype(np.int64), first)
        previous, codes = previous[order[first]], codes[order[first]]
        # a pair seen once is no feature, and counts for its class only
        codes = np.where((codes >= 0) & (n >= 2), codes, -1 - own.class_of(codes)).astype("<i4")
        place = to.range_of(previous, own.class_of(codes))
        # counts beyond 31 bits come in several rows
        parts = [(r, x[0], x[1], x[2]) for r, x in _cut(place, previous, codes, n)]
        rows = []
        for r, p, c, m in parts:
            while len(m):
                rows.append(_packed(own, r, p, c, np.minimum(m, (1 << 31) - 1)))
                more = m >= 1 << 31
                p, c, m = p[more], c[more], m[more] - ((1 << 31) - 1)
        return pa.Table.from_batches(rows)

    def fit(table: pa.Table) -> pa.Table:
        own, logs, to = shared.value
        previous, codes, times = _unpacked(own, table)
        order, first = distinct(previous, codes)
        times = np.add.reduceat(times[order].astype(np.int64), first)
        previous, codes = previous[order[first]], codes[order[first]]
        classes = own.class_of(codes)
        group, at, back = np.unique(pair_keys(previous, -1 - classes), return_index=True, return_inverse=True)
        total = np.bincount(back, times, len(group))
        real = np.flatnonzero(codes >= 0)
        p, c, n, g = previous[real], codes[real], times[real].astype(float), back[real]
        outcome = np.where(own.index[c] >= 0, own.index[c], MODEL_WORDS + own.kinds[c].astype(np.int64))
        base = 10.0 ** (logs[(mix(p) % np.uint64(PREVIOUS)).astype(np.int64), outcome] + np.where(own.index[c] >= 0, 0.0, np.log10(own.times[c] + 0.5)))
        unseen = np.maximum(1.0 - np.bincount(g, base, len(group)), 1e-9)
        w = np.zeros(len(real))
        for _ in range(steps):
            each = base * np.exp(w)
            expected = total[g] * each / (unseen + np.bincount(g, each, len(group)))[g]
            w += rate * np.clip((n - expected - decay * w) / (expected + decay), -2.0, 2.0)
        w = w.astype("<f4").astype(float)
        norm = unseen + np.bincount(g, base * np.exp(w), len(group))
        used = np.flatnonzero(np.bincount(g, minlength=len(group)))
        p, c, w, kind = np.r_[p, previous[at][used]], np.r_[c, -1 - classes[at][used]], np.r_[w, -np.log(norm[used])] / LOG10, np.r_[classes[real], classes[at][used]]
        order = np.argsort(p, kind="stable")
        p, c, w, kind = p[order], c[order], w[order], kind[order]
        copies = to.copies(p)
        each = np.repeat(np.arange(len(p)), copies)
        salt = np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)
        rows = [_packed(own, r, *x) for r, x in _cut(to.range_of(p[each], kind[each], salt), p[each], c[each], w[each])]
        return pa.Table.from_batches(rows or [_packed(own, 0, np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0))])

    pairs = docs.where("not held_out").select("_text").mapInArrow(count, schema)
    return scratch.save(pairs.groupBy("range").applyInArrow(whole, schema).groupBy("range").applyInArrow(fit, schema), "pairs")


def history_counts(docs: DataFrame, tables: Tables, scratch: Scratch, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(class counts per pair of hashed histories, outcome counts per previous token), as bytes of int64 arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    n_class, n_word = PREVIOUS * SKIPPED * CLASSES, PREVIOUS * OUTCOMES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_class, by_word = np.zeros(n_class, np.int64), np.zeros(n_word, np.int64)
        for batch in batches:
            for _, hashes, classes, bounds in tokens(batch.column("_text")):
                one, two = histories(hashes, bounds)
                _, outcome = shared.value.find(hashes, classes)
                by_class += np.bincount((one * SKIPPED + two) * CLASSES + classes, minlength=n_class)
                by_word += np.bincount(one * OUTCOMES + outcome, minlength=n_word)
        for kind, (cells, width) in enumerate(((by_class, SKIPPED * CLASSES), (by_word, OUTCOMES))):
            rows = cells.reshape(-1, width)
            for part in range(parts):
                own = rows[part::parts]
                at = np.flatnonzero(own)
                if len(at):
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "cells": pa.array([at.astype("<u4").tobytes()], pa.binary()), "times": pa.array([own.ravel()[at].astype("<i8").tobytes()], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kind, part = rows[0]["kind"], rows[0]["part"]
        width = (SKIPPED * CLASSES, OUTCOMES)[kind]
        out = np.zeros(PREVIOUS // parts * width, np.int64)
        for r in rows:
            out[np.frombuffer(r["cells"], "<u4")] += np.frombuffer(r["times"], "<i8")
        out = out.reshape(-1, width)
        return pa.table({"kind": pa.array([kind] * len(out), pa.int32()), "previous": pa.array([part + parts * k for k in range(len(out))], pa.int32()), "times": pa.array([x.tobytes() for x in out], pa.binary())})

    found = docs.where("not held_out").select("_text").mapInArrow(count, "kind int, part int, cells binary, times binary")
    found = scratch.save(found.groupBy("kind", "part").applyInArrow(total, "kind int, previous int, times binary"), "histories")
    return found.where("kind = 0"), found.where("kind = 1")


class Model:
    """Weights of both factors, and their gradient over rows of history counts."""

    def __init__(self, tables: Tables):
        self.class_bias, self.class_previous = np.zeros(CLASSES), np.zeros((PREVIOUS, CLASSES))
        self.class_skipped, self.class_pair = np.zeros((SKIPPED, CLASSES)), np.zeros((PAIRS, CLASSES))
        self.word_bias, self.word_previous = np.zeros(OUTCOMES), np.zeros((PREVIOUS, OUTCOMES))
        self.outcome_class = np.r_[tables.model_classes, np.arange(CLASSES, dtype=np.uint8)].astype(np.int64)
        self.open = np.r_[np.arange(MODEL_WORDS) < tables.n_model, np.ones(CLASSES, bool)]
        pair = np.arange(PREVIOUS * SKIPPED, dtype=np.uint64)
        self.pair_of = (mix(pair + np.uint64(1)) % np.uint64(PAIRS)).astype(np.int64).reshape(PREVIOUS, SKIPPED)

    def class_logs(self, previous: np.ndarray | int) -> np.ndarray:
        """Natural-log probabilities, SKIPPED x CLASSES, after one hashed token."""
        x = self.class_bias + self.class_previous[previous] + self.class_skipped + self.class_pair[self.pair_of[previous]]
        x = x - x.max(-1, keepdims=True)
        return x - np.log(np.exp(x).sum(-1, keepdims=True))

    def word_logs(self, previous: int) -> np.ndarray:
        """Natural-log probabilities of the outcomes within their classes."""
        x = np.where(self.open, self.word_bias + self.word_previous[previous], -np.inf)
        top = np.full(CLASSES, -np.inf)
        np.maximum.at(top, self.outcome_class, x)
        x = x - top[self.outcome_class]
        sums = np.bincount(self.outcome_class, np.exp(x), CLASSES)
        return x - np.log(sums)[self.outcome_class]

    def gradient(self, kind: int, previous: int, times: np.ndarray) -> dict[str, np.ndarray]:
        """Observed and expected feature counts (stacked) of one row of counts; what only one
        hashed token has is named with it."""
        if kind == 0:
            seen = times.reshape(SKIPPED, CLASSES).astype(float)
            both = np.stack([seen, np.exp(self.class_logs(previous)) * seen.sum(1, keepdims=True)])
            pair = np.zeros((2, PAIRS, CLASSES))
            for k in (0, 1):
                np.add.at(pair[k], self.pair_of[previous], both[k])
            return {"class_bias": both.sum(1), f"class_previous:{previous}": both.sum(1), "class_skipped": both, "class_pair": pair}
        seen = times.astype(float)
        expected = np.exp(self.word_logs(previous)) * np.bincount(self.outcome_class, seen, CLASSES)[self.outcome_class]
        both = np.stack([seen, expected])
        return {"word_bias": both, f"word_previous:{previous}": both}

    def step(self, sums: dict[str, np.ndarray], rate: dict[str, float], decay: float = 2.0) -> None:
        for name, (seen, expected) in sums.items():
            name, _, row = name.partition(":")
            w = getattr(self, name)
            w = w[int(row)] if row else w
            w += rate[name] * np.clip((seen - expected - decay * w) / (expected + decay), -2.0, 2.0)


RATE = {"class_bias": 0.3, "class_previous": 0.3, "class_skipped": 0.3, "class_pair": 0.3, "word_bias": 0.5, "word_previous": 0.5}


def train(tables: Tables, counts: tuple[DataFrame, DataFrame], steps: int = 12) -> Model:
    """Full-batch gradient steps, each one distributed job over the history counts."""
    model = Model(tables)
    rows = counts[0].unionByName(counts[1])
    sc = rows.sparkSession.sparkContext
    for _ in range(steps):
        shared = sc.broadcast(model)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    for name, x in shared.value.gradient(r["kind"], r["previous"], np.frombuffer(r["times"], "<i8")).items():
                        sums[name] = sums[name] + x if name in sums else x
            for name, x in sums.items():
                yield pa.RecordBatch.from_pydict({"name": pa.array([name]), "sums": pa.array([x.astype("<f4").tobytes()], pa.binary())})

        # model-sized sums of a few tasks, whatever the corpus
        total: dict[str, np.ndarray] = {}
        for r in rows.coalesce(4).mapInArrow(gradient, "name string, sums binary").collect():
            name, _, row = r["name"].partition(":")
            shape = getattr(model, name).shape[1:] if row else getattr(model, name).shape
            x = np.frombuffer(r["sums"], "<f4").reshape(2, *shape).astype(np.float64)
            if r["name"] in total:
                total[r["name"]] += x
            else:
                total[r["name"]] = x
        model.step(total, RATE)
        shared.destroy()
    return model


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = Scratch(docs.sparkSession, "maxent")
    with arrow_limits(docs.sparkSession):
        return scratch.save(_score(docs, scratch, text, doc_id, range_tokens), "scored")


def _score(docs: DataFrame, scratch: Scratch, text: str, doc_id: str, range_tokens: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("held_out", held_out(F.col("doc_id")))
    ranges = n_tasks(spark, docs.count(), 8192)
    words = word_counts(docs, ranges, scratch)
    n, v = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v")).first())
    tables = Tables(_head(words, v))
    model = train(tables, history_counts(docs, tables, scratch))

    # the other words of each class share its last outcome by (c + 0.5), one unknown word included
    model_words = np.sort(tables.words[tables.index >= 0])
    shared_words = spark.sparkContext.broadcast(model_words)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = np.zeros(CLASSES)
        for batch in batches:
            for r in batch.to_pylist():
                w, t, c = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["times"], "<i8"), np.frombuffer(r["kinds"], np.uint8)
                other = ~np.isin(w, shared_words.value)
                mass += np.bincount(c[other], t[other] + 0.5, CLASSES)
        yield pa.RecordBatch.from_pydict({"class": np.arange(CLASSES), "mass": mass})

    rest_mass = np.full(CLASSES, 0.5)
    for r in words.select("words", "times", "kinds").mapInArrow(rest, "class long, mass double").groupBy("class").agg(F.sum("mass").alias("mass")).collect():
        rest_mass[r["class"]] += r["mass"]
    class_logs = np.stack([model.class_logs(p) for p in range(PREVIOUS)]) / LOG10
    word_logs = np.stack([model.word_logs(p) for p in range(PREVIOUS)]) / LOG10
    word_logs[:, MODEL_WORDS:] -= np.log10(rest_mass)  # plus log10(c + 0.5) of the word itself
    word_logs = np.where(np.isfinite(word_logs), word_logs, 0).astype(np.float32)
    spread = Spread(tables, n, int(spark.conf.get("spark.sql.shuffle.partitions")), range_tokens)
    pairs = pair_weights(docs, tables, word_logs, spread, scratch)
    shared = spark.sparkContext.broadcast((tables, class_logs.astype(np.float32), word_logs))
    norm = float(np.log10(n + 0.5 * (v + 1)))

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_class, log_word = shared.value
        task = TaskContext.get().partitionId()
        uid, held, followed, size, n_pairs, turn = task << 40, [], [], 0, 0, task

        def flush_pairs() -> Iterator[pa.RecordBatch]:
            previous, codes, owners = (np.concatenate(x) for x in zip(*followed, strict=True))
            order, first = distinct(previous, codes)
            times, owners, at = np.diff(np.r_[first, len(order)]), owners[order], order[first]
            previous, codes = previous[at], codes[at]
            low = int(owners.min())
            place = spread.range_of(previous, own.class_of(codes), turn % spread.copies(previous))
            for r, (p, c, n_, f) in _cut(place, previous, codes, times, first):
                who = owners[np.repeat(f - np.cumsum(n_) + n_, n_) + np.arange(n_.sum())] - low
                yield _rows(3, range=[ranges + r], uid=[low], words=[squeeze_words(own.words, p)], codes=[squeeze(c)], times=[squeeze(n_)], owners=[squeeze(who)])

        def flush() -> Iterator[pa.RecordBatch]:
            asked, owners = (np.concatenate(x) for x in zip(*held, strict=True))
            for r, at in _ranges(asked, ranges):
                order = at[np.argsort(owners[at], kind="stable")]
                yield _rows(1, range=[r], words=[asked[order].tobytes()], owners=[owners[order].tobytes()])

        for batch in batches:
            for row, hashes, classes, bounds in tokens(batch.column("_text")):
                one, two = histories(hashes, bounds)
                times, outcome = own.find(hashes, classes)
                logs = np.log10(times + 0.5)
                known = times > 0
                model_log = log_class[one, two, classes].astype(float) + log_word[one, outcome] + np.where(outcome >= MODEL_WORDS, np.where(known, logs, 0.0), 0.0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (np.where(known, logs, 0.0), model_log, known.astype(np.int64))]
                count = len(bounds) - 1
                ids = uid + np.arange(count)
                uid += count
                followed.append((before(hashes, bounds), own.codes(hashes, classes), np.repeat(ids, np.diff(bounds))))
                n_pairs += len(hashes)
                if n_pairs >= FLUSH:
                    yield from flush_pairs()
                    followed, n_pairs, turn = [], 0, turn + 1
                part = [batch.column(c).slice(row, count) for c in ("doc_id", "held_out")]
                # a document's row goes to any range; its lookups are spread by word
                yield _rows(0, range=(ids % ranges).tolist(), uid=ids, doc_id=part[0], held_out=part[1], n_tokens=np.diff(bounds), known=sums[2], base=sums[0], score=sums[1])
                rare = np.flatnonzero(~known)
                held.append((hashes[rare], ids[np.searchsorted(bounds, rare, "right") - 1]))
                size += len(rare)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
        if n_pairs:
            yield from flush_pairs()

    def follow(table: pa.Table) -> pa.Table:
        """Sums of the weights of a range's pairs by document, packed by block of documents."""
        asked, known = table.filter(pc.equal(table["kind"], 3)).to_pylist(), table.filter(pc.equal(table["kind"], 4)).to_pylist()
        own = shared.value[0]
        known = [(expand_words(own.words, r["words"]), expand(r["codes"]), expand(r["times"]).view("<f4")) for r in known]
        if not asked or not known:
            return LOOKED.empty_table()
        p, c, w = (np.concatenate(x) for x in zip(*known, strict=True))
        keys = pair_keys(p, c)
        order = np.argsort(keys)
        keys, w = keys[order], w[order].astype(float)

        def weight(wanted: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(wanted))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, w[at], 0.0)

        out = []
        for r in asked:  # each of at most a flush's pairs
            p, c, n_ = expand_words(own.words, r["words"]), expand(r["codes"]), expand(r["times"])
            each = weight(pair_keys(p, -1 - own.class_of(c))) + np.where(c >= 0, weight(pair_keys(p, c)), 0.0)
            who, back = np.unique(expand(r["owners"]), return_inverse=True)
            sums = np.bincount(back, np.repeat(each, n_), len(who))
            who = who[sums != 0].astype(np.int64) + r["uid"]
            for block, (a, b) in _cut(who // BLOCK, who % BLOCK, sums[sums != 0]):
                out.append((block, a.astype("<u2").tobytes(), b.astype("<f4").tobytes()))
        columns = [pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())]
        return pa.table([pa.nulls(len(out), f.type) for f in RESULT] + columns, schema=LOOKED)

    def gather(table: pa.Table) -> pa.Table:
        """One row per document of a block: what its pairs add to its score."""
        sums, seen = np.zeros(BLOCK), np.zeros(BLOCK, bool)
        for who, x in zip(table["who"].to_pylist(), table["sums"].to_pylist(), strict=True):
            who = np.frombuffer(who, "<u2")  # each document once
            sums[who] += np.frombuffer(x, "<f4")
            seen[who] = True
        who = np.flatnonzero(seen)
        return pa.table({"uid": table["block"][0].as_py() * BLOCK + who, "score": sums[who]})

    def look_up(table: pa.Table) -> pa.Table:
        if len(table) and table["range"][0].as_py() >= ranges:
            return follow(table)
        found = counted(table)
        return pa.table([*found.columns, *[pa.nulls(len(found), f.type) for f in LOOKED if f.name not in RESULT.names]], schema=LOOKED)

    def counted(table: pa.Table) -> pa.Table:
        counts = [r for r in table.filter(pc.equal(table["kind"], 2)).to_pylist()]
        asked = table.filter(pc.equal(table["kind"], 1)).select(["words", "owners"]).to_pylist()
        out = [table.filter(pc.equal(table["kind"], 0)).select(RESULT.names).cast(RESULT)]
        if asked:
            w = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in asked])
            owner = np.concatenate([np.frombuffer(r["owners"], np.int64) for r in asked])
            times = np.zeros(len(w), np.int64)
            if counts:
                vocab, c = np.frombuffer(counts[0]["words"], np.uint64), np.frombuffer(counts[0]["owners"], "<i8")
                at = np.minimum(np.searchsorted(vocab, w), len(vocab) - 1)
                times = np.where(vocab[at] == w, c[at], 0)
            order = np.argsort(owner, kind="stable")
            owner, times = owner[order], times[order]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums = np.add.reduceat(np.log10(times + 0.5), first)
            known = np.add.reduceat((times > 0).astype(np.int64), first)
            m = len(first)
            out.append(pa.table({"uid": owner[first], "doc_id": pa.nulls(m, RESULT.field("doc_id").type), "held_out": pa.nulls(m, pa.bool_()), "n_tokens": np.zeros(m, np.int64), "known": known, "base": sums, "score": sums}, schema=RESULT))
        return pa.concat_tables(out)

    kind = dict(docs.dtypes)["doc_id"]
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    RESULT = pa.schema([("uid", pa.int64()), ("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    LOOKED = pa.schema([*RESULT, ("block", pa.int64()), ("who", pa.binary()), ("sums", pa.binary())])
    SENT = pa.schema([("kind", pa.int32()), ("range", pa.int32()), *RESULT, *[(c, pa.binary()) for c in ("words", "owners", "codes", "times")]])

    def _rows(kind: int, **given) -> pa.RecordBatch:
        size = len(given["range"])
        given["kind"] = [kind] * size
        return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if f.name not in given else x if isinstance(x := given[f.name], pa.Array) else pa.array(x, f.type) for f in SENT], schema=SENT)

    result = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double"
    sent = docs.mapInArrow(head, f"kind int, range int, {result}, words binary, owners binary, codes binary, times binary")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in result.split(", "))]
    nothing = F.lit(None).cast("binary")
    vocab = words.select(F.lit(2).alias("kind"), "range", *empty, "words", F.col("times").alias("owners"), nothing.alias("codes"), nothing.alias("times"))
    weights = pairs.select(F.lit(4).alias("kind"), (F.col("range") + ranges).alias("range"), *empty, F.col("previous").alias("words"), nothing.alias("owners"), "codes", F.col("amounts").alias("times"))
    looked = scratch.save(sent.unionByName(vocab).unionByName(weights).groupBy("range").applyInArrow(look_up, f"{result}, block long, who binary, sums binary"), "looked")
    followed = looked.where("block is not null").select("block", "who", "sums").groupBy("block").applyInArrow(gather, "uid long, score double")
    found = looked.where("block is null").select(*RESULT.names).unionByName(followed, allowMissingColumns=True)
    total = found.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")
