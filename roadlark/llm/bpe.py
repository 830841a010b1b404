"""BPE encoding and decoding by a pair occurrence index.

Texts are cut into pretokens; the distinct ones of a block of texts become one array of
symbols with links to the next and previous symbol. The index lists, for each rank of a
mergeable pair, all positions where the pair stands. Ranks are taken in ascending order, in
spans of ``SPAN`` of them: every pretoken applies its lowest rank of the span, which removes the merged symbols
and lists the two pairs that came up beside each merge under their own ranks. A pair made by
a merge always ranks after it (``Merges`` refuses a file in which one could belong to an
earlier span), so this is the order in which single texts would merge.

Defined cases: a null or empty text has no ids and decodes to the empty text; the
end-of-text marker inside a text becomes its own id; repeated rows get equal results; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadlark.llm.common import Scratch, arrow_limits, trim
from roadlark.llm.pretokens import END_OF_TEXT, pretokens

SPAN = 1024
NONE = np.int32(np.iinfo(np.int32).max)
BLOCK_CHARS = 1 << 20
#: Bytes of new pretokens that are indexed at once: the index takes some 70 bytes for each.
LEARN_BYTES = 1 << 17
#: Pretokens that a task remembers; after it has forgotten them, the next block brings the frequent ones back.
CACHE_WORDS = 100_000
#: Bytes of ids in a row group. Who reads the table takes up to 4,096 rows of a row group at once, in arrays on the heap.
ROW_GROUP = 2 << 20


def byte_letters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file as arrays."""

    def __init__(self, text: str):
        file = json.loads(text)
        vocab = dict(file["model"]["vocab"])
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        maker = np.full(max(vocab.values()) + 1, -1, np.int64)  # the last rank that makes each symbol
        np.maximum.at(maker, self.made, np.arange(len(pairs)))
        if (np.maximum(maker[keys >> 32], maker[keys & 0xFFFFFFFF]) // SPAN > np.arange(len(pairs)) // SPAN).any():
            raise ValueError("a merge makes a pair of an earlier span of ranks")
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.pieces = [b""] * (max(*vocab.values(), *self.special.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def _distinct(positions: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own hashes integers, which is slower here."""
    positions = np.sort(positions)
    return positions[np.r_[True, positions[1:] != positions[:-1]]] if len(positions) else positions


class PairIndex:
    """Symbols of many pretokens, and the positions of each mergeable pair by rank span."""

    def __init__(self, merges: Merges, words: list[bytes]):
        self.merges = merges
        lengths = np.array([len(w) for w in words], np.int64)
        self.symbols = merges.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(self.symbols)
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lengths)
        self.next[ends[lengths > 0] - 1] = -1
        self.prev[(ends - lengths)[lengths > 0]] = -1
        self.alive = np.ones(n, bool)
        self.rank = np.full(n, NONE, np.int32)
        self.spans: list[list[np.ndarray]] = [[] for _ in range(len(merges.keys) // SPAN + 1)]
        self._list(np.flatnonzero(self.next >= 0))

    def _list(self, positions: np.ndarray) -> None:
        """Looks up the pairs at these positions and lists those that can merge."""
        after = self.next[positions]
        whole = after >= 0
        self.rank[positions[~whole]] = NONE
        positions = positions[whole]
        found = self.merges.rank(self.symbols[positions], self.symbols[after[whole]])
        self.rank[positions] = found
        positions, found = positions[found != NONE], found[found != NONE] // SPAN
        if len(positions):
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for own in np.split(np.arange(len(found)), cuts):
                self.spans[found[own[0]]].append(positions[own])

    def _apply(self, span: int) -> None:
        while self.spans[span]:
            at = _distinct(np.concatenate(self.spans[span]))
            self.spans[span] = []
            at = at[self.alive[at] & (self.rank[at] // SPAN == span)]
            if not len(at):
                continue
            word, rank = self.word[at], self.rank[at]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(at)]))
            now = rank == lowest
            if not now.all():
                self.spans[span].append(at[~now])
            at, rank = at[now], rank[now]
            # in a run of one symbol, occurrences overlap; every other one counts, from the left
            tied = np.r_[False, (self.next[at[:-1]] == at[1:]) & (rank[:-1] == rank[1:])]
            if tied.any():
                index = np.arange(len(at))
                start = np.maximum.accumulate(np.where(tied, 0, index))
                keep = (index - start) % 2 == 0
                at, rank = at[keep], rank[keep]
            gone = self.next[at]
            after = self.next[gone]
            self.symbols[at] = self.merges.made[rank]
            self.alive[gone] = False
            self.rank[gone] = NONE
            self.next[at] = after
            inside = after >= 0
            self.prev[after[inside]] = at[inside]
            before = self.prev[at]
            self._list(_distinct(np.concatenate([at, before[before >= 0]])))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        for span in range(len(self.spans)):
            self._apply(span)
        return self.symbols[self.alive], np.bincount(self.word[self.alive], minlength=self.word[-1] + 1 if len(self.word) else 0)


class Encoder:
    """Encodes blocks of texts; remembers a bounded number of pretokens between blocks."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {END_OF_TEXT: 0}
        self.ids = np.array([self.merges.special.get(END_OF_TEXT, 0)], np.int32)
        self.lengths = np.array([1], np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, lengths, part, size = [self.ids], [self.lengths], [], 0
        for k, word in enumerate(words):
            part.append(word.encode())
            size += len(part[-1])
            if size >= LEARN_BYTES or k + 1 == len(words):
                for found, own in zip((ids, lengths), PairIndex(self.merges, part).run(), strict=True):
                    found.append(own)
                part, size = [], 0
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        known, fresh, of_text = self.known, [], []
        for text in texts:
            own = []
            for part in pretokens(text):
                for w in set(part).difference(known):
                    known[w] = len(known)
                    fresh.append(w)
                own.append(np.fromiter(map(known.__getitem__, part), np.int64, len(part)))
            of_text.append(own)
        if fresh:
            self._learn(fresh)
        starts = np.cumsum(self.lengths) - self.lengths
        return [self._join(own, starts) for own in of_text]

    def _join(self, own: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        if not own:
            return np.empty(0, np.int32)
        words = own[0] if len(own) == 1 else np.concatenate(own)
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(starts[words] - (ends - lengths), lengths) + np.arange(ends[-1])]


@functools.lru_cache(1)
def worker_merges(text: str) -> Merges:
    """The merges of this Python worker, which its tasks share."""
    return Merges(text)


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.Table, list[str]]]:
    """Batches gathered to blocks of about BLOCK_CHARS."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= BLOCK_CHARS:
            table = pa.Table.from_batches(held)
            yield table, [x or "" for x in table.column(text).to_pylist()]
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, [x or "" for x in table.column(text).to_pylist()]


def decode(merges: Merges, ids: np.ndarray) -> str:
    return b"".join(map(merges.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def round_trip(docs: DataFrame, vocab_file: str, *, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, is_lossless; ``with_ids`` adds ids (array of int)."""
    spark = docs.sparkSession
    with open(vocab_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a tokenizer file: 2 MB, whatever the corpus
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "is_lossless", *["ids"] * with_ids]
    step = 256  # rows of a batch that goes back

    def answers(merges: Merges, table: pa.Table, texts: list[str], encoded: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = table.column(doc_id).combine_chunks()
        for at in range(0, len(texts), step):
            part, out = encoded[at : at + step], []
            for given, ids in zip(texts[at : at + step], part, strict=True):
                again = decode(merges, ids)
                out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(again.encode()).hexdigest(), again == given))
            columns = [pa.array(x) for x in zip(*out, strict=True)]
            if with_ids:
                offsets = np.r_[0, np.cumsum([len(x) for x in part])].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part))))
            own = keys.slice(at, len(part))
            yield pa.RecordBatch.from_arrays([own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own, *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        merges = worker_merges(shared.value)
        encoder = Encoder(merges)
        for table, texts in blocks(batches, text):
            yield from answers(merges, table, texts, encoder.encode(texts))
            del table, texts
            trim()
        del encoder  # else the worker keeps its pretokens while it waits for the next task
        trim()

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string, is_lossless boolean" + ", ids array<int>" * with_ids
    with arrow_limits(spark, size="2m"):
        return Scratch(spark, "bpe").save(docs.select(doc_id, text).mapInArrow(run, schema), "round-trip", row_group=ROW_GROUP)
