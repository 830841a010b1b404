"""Toxicity by averaged subword bags.

Every word is its hashed n-grams of 3 to 5 bytes with its boundaries, and itself. A window of
``WINDOW`` words is the average of the embeddings of its subwords, and a linear softmax over the two
labels reads it; embeddings and softmax are trained jointly. Misspellings keep most of a
word's n-grams, so they are recognised unseen. A long text is as toxic as its ``TOP`` most toxic
windows together; training takes, for each text, its highest windows of the moment.

For one softmax direction an embedding acts through one number, so scoring sums one number
per subword, with arrays over whole batches.

The classifier is fitted on a bounded hash sample of labelled rows: at most ``MAX_TRAIN`` of
labels 0 and 1, of texts up to ``MAX_CHARS`` characters. Scoring reads every whole text.

Defined cases: texts without a word (null, empty, marks only) get the prior, the training
share of label 1; without labelled rows of both labels every text gets the prior (0 without any);
repeated rows are scored alike; several labels of one document count as their highest; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, trim
from roadlark.llm.hashing import SEGMENT, mix, powers, texts

WINDOW, TOP, DIMENSIONS, BUCKETS = 3, 3, 8, 1 << 17
LENGTHS = (3, 4, 5)
#: Most training texts of label 0 and 1, and of what length.
MAX_TRAIN, MAX_CHARS, STEPS = (2000, 1000), 50_000, 80
GAP = 32
#: ASCII letters fold to lower case, other ASCII characters but digits part words.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else GAP for b in range(256)], np.uint8)
_codes = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Words:
    """Words of adjoining texts and the buckets of their subwords."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        """``starts`` also has the end of the last text."""
        self.buffer = np.insert(FOLD[data], starts, GAP)  # one gap before each text and one after the last
        word = self.buffer != GAP
        self.first = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        self.last = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        self.bounds = np.searchsorted(self.first, starts + np.arange(len(starts)))
        self.up, self.down = powers(len(self.buffer) + 1)
        self.sums = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum(_codes[self.buffer] * self.up[: len(self.buffer)], out=self.sums[1:])

    def grams(self, length: int) -> np.ndarray:
        """Bucket of the n-gram at each byte."""
        n = max(0, len(self.buffer) - length + 1)
        run = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        return (mix(run + np.uint64(length)) % np.uint64(BUCKETS)).astype(np.int32)

    def whole(self) -> np.ndarray:
        run = (self.sums[self.last] - self.sums[self.first]) * self.down[self.first]
        return (mix(run + np.uint64(99)) % np.uint64(BUCKETS)).astype(np.int32)

    def spans(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First gram and end of the grams of each word, boundaries included."""
        low = self.first - 1
        return low, np.maximum(low, self.last + 2 - length)

    def totals(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of subword weights and number of subwords of each word."""
        total, count = weights[self.whole()].astype(np.float64), np.ones(len(self.first), np.int64)
        for length in LENGTHS:
            run = np.r_[0.0, np.cumsum(weights[self.grams(length)], dtype=np.float64)]
            low, high = self.spans(length)
            total += run[np.minimum(high, len(run) - 1)] - run[np.minimum(low, len(run) - 1)]
            count += high - low
        return total, count

    def subwords(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, word of each), sorted by word."""
        buckets, owner = [self.whole()], [np.arange(len(self.first))]
        for length in LENGTHS:
            grams = self.grams(length)
            low, high = self.spans(length)
            size = high - low
            ends = np.cumsum(size)
            if len(ends) and ends[-1]:
                buckets.append(grams[np.repeat(low - (ends - size), size) + np.arange(ends[-1])])
                owner.append(np.repeat(np.arange(len(self.first)), size))
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        return np.concatenate(buckets)[order], owner_all[order]


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, text of each window): WINDOW words from a text's start on, the last one shorter."""
    many = -(-np.diff(bounds) // WINDOW)
    text = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return bounds[:-1][text] + WINDOW * place, text


def highest(mean: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): the TOP windows of the highest means of each text."""
    order = np.lexsort((-mean, text))
    own = text[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < TOP], own[rank < TOP]


class Classifier:
    """Subword weights (embedding times softmax direction), bias and prior."""

    def __init__(self, weights: np.ndarray | None, bias: float, prior: float):
        self.weights, self.bias, self.prior = weights, bias, prior

    def scores(self, column: pa.Array) -> np.ndarray:
        data, at = texts(column)
        out, row = np.full(len(at) - 1, self.prior), 0
        if self.weights is None:
            return out
        while row < len(at) - 1:
            to = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, "right")) - 1)
            if at[to] > at[row]:
                words = Words(data[at[row] : at[to]], at[row : to + 1] - at[row])
                if len(words.first):
                    total, count = words.totals(self.weights)
                    start, text = windows(words.bounds)
                    mean = np.add.reduceat(total, start) / np.add.reduceat(count, start)
                    top, own = highest(mean, text)
                    some = np.flatnonzero(np.diff(words.bounds))
                    logit = (np.bincount(own, mean[top], len(words.bounds) - 1) / np.maximum(1, np.bincount(own, minlength=len(words.bounds) - 1)))[some]
                    out[row + some] = 1.0 / (1.0 + np.exp(-np.clip(logit + self.bias, -30, 30)))
            row = to
        return out


def fit(given: list[str], labels: list[int], seed: int = 3) -> Classifier:
    """Trains embeddings and softmax jointly on a bounded list of texts."""
    y = np.array(labels, np.float64)
    prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Classifier(None, 0.0, prior)
    # windows of all texts, one after the other, with the subwords of each
    begin, of_text, parts, at = [], [], [], 0
    seen = np.zeros((2, BUCKETS))
    for k, (text, label) in enumerate(zip(given, labels, strict=True)):
        raw = text.encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        buckets, owner = words.subwords()
        start, _ = windows(words.bounds)
        begin.append(at + np.searchsorted(owner, start))
        of_text.append(np.full(len(start), k))
        parts.append(buckets)
        at += len(buckets)
        seen[label, np.unique(buckets)] += 1
    begin, of_text, flat_all = np.concatenate(begin), np.concatenate(of_text), np.concatenate(parts)
    del parts
    sizes_all = np.diff(np.r_[begin, len(flat_all)])
    # start: how much more often a subword stands in texts of label 1, smoothed
    n = np.array([len(y) - y.sum(), y.sum()])
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS))
    embed[:, 0] = odds
    soft = np.zeros((DIMENSIONS, 2))
    soft[0] = (-0.5, 0.5)
    soft[1:] = rng.normal(0, 0.05, (DIMENSIONS - 1, 2))
    bias = np.array([0.5, -0.5])
    square_e, square_s, square_b = np.full(embed.shape, 1e-6), np.full(soft.shape, 1e-6), np.full(2, 1e-6)
    weight = np.where(y > 0, 0.5 / n[1], 0.5 / n[0])
    for _ in range(STEPS):
        s = (embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        mean = np.add.reduceat(s[flat_all], begin) / sizes_all
        top, text = highest(mean, of_text)
        sizes = sizes_all[top]
        ends = np.cumsum(sizes)
        flat = flat_all[np.repeat(begin[top] - (ends - sizes), sizes) + np.arange(ends[-1])]
        owner = np.repeat(np.arange(len(top)), sizes)
        some, place_of = np.unique(text, return_inverse=True)
        share = 1.0 / np.bincount(place_of)[place_of]  # a text's highest windows are averaged
        bag = np.zeros((len(some), DIMENSIONS))
        part = share / sizes
        np.add.at(bag, place_of[owner], embed[flat] * part[owner][:, None])
        logits = bag @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        delta = (p - np.stack([1 - y[some], y[some]], 1)) * weight[some][:, None]
        grad_soft, grad_bias = bag.T @ delta, delta.sum(0)
        rows, place = np.unique(flat, return_inverse=True)
        grad = np.zeros((len(rows), DIMENSIONS))
        np.add.at(grad, place, (delta @ soft.T)[place_of[owner]] * part[owner][:, None])
        square_e[rows] += grad**2
        embed[rows] -= 0.3 * grad / np.sqrt(square_e[rows])
        square_s += grad_soft**2
        soft -= 0.1 * grad_soft / np.sqrt(square_s)
        square_b += grad_bias**2
        bias -= 0.1 * grad_bias / np.sqrt(square_b)
    s = embed @ (soft[:, 1] - soft[:, 0])
    return Classifier(s.astype(np.float32), float(bias[1] - bias[0]), prior)


def training_sample(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, label: str) -> tuple[list[str], list[int]]:
    """At most MAX_TRAIN texts of the labels from rows that are not held out, by hash of doc_id."""
    given = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y")).where(~held_out(F.col("_id"))).withColumn("_h", F.xxhash64("_id"))
    counts = {r["_y"]: r["n"] for r in given.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("_y") == y) & (F.pmod("_h", F.lit(max(1, n // MAX_TRAIN[y]))) == 0))
    chosen = given.where(keep)  # under twice MAX_TRAIN of each label: small enough to broadcast
    rows = docs.join(F.broadcast(chosen), docs[doc_id] == F.col("_id")).where(F.length(text) <= MAX_CHARS).dropDuplicates(["_id"]).select("_h", "_y", F.col(text).alias("_t")).collect()
    rows.sort(key=lambda r: (r["_h"], r["_t"]))
    out = [r for y in (0, 1) for r in [r for r in rows if r["_y"] == y][: MAX_TRAIN[y]]]
    return [r["_t"] for r in out], [r["_y"] for r in out]


def score(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(*training_sample(docs, labels, text=text, doc_id=doc_id, label=label)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(shared.value.scores(batch.column("_text")))], names=["doc_id", "held_out", "score"])

    keyed = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("_text"))
    with arrow_limits(spark):
        scored = Scratch(spark, "toxicity").save(keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, score double"), "scored")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
