"""Token ids in compressed shard records with random access to single documents.

Documents are range-sorted by id; each partition encodes its texts with the tokenizers
library, appends the end id, serialises every document's ids as little-endian unsigned 32-bit
integers and compresses each document on its own against one shared zstandard dictionary,
which is trained on serialised id arrays. Up to ``SHARD_DOCS`` documents, or ``SHARD_BYTES`` of
frames, make one shard record, a row of a Parquet dataset:

    part, number      place in the global order
    docs, ids         how many documents and ids it holds
    first_id          ids before it in its part
    dictionary        sha256 of the dictionary it needs
    doc_ids           int64 array, ascending
    lengths           ids of each document, uint32 array
    offsets           where each document's frame starts in the payload; one more for the end
    payload           the frames

Spark's committer writes the records, so a lost executor's attempt leaves nothing behind. The
dictionary is a table beside them. A reader checks the hash, so a wrong dictionary is an
error and not garbage.

Defined cases: a null or empty text is a document of the end id alone; rows of equal doc_id
follow each other; null doc_ids come first and are kept as such; an empty table gives an
empty dataset.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, trim
from roadlark.llm.hashing import IS_BLANK, distinct, mix, powers, texts

SHARD_DOCS = 512
SHARD_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).min
#: The dictionary is fitted on whole documents of the lowest hashes: at most so many, of so many bytes of text together.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16 << 20, 64 << 10
CACHE_PIECES = 400_000
#: Pieces that the library gets in a call; each token that it returns takes some hundred bytes until its ids are read.
CALL_PIECES = 4096
#: Bytes of adjoining texts that are cut into pieces at once: the tables that go with them are many times as large.
SEGMENT = 1 << 17
#: How byte-level vocabularies write the space.
SPACE_LETTER = "\u0120"
RECORD = "part int, number int, docs int, ids long, first_id long, dictionary string, doc_ids binary, null_ids binary, lengths binary, offsets binary, payload binary"


class Pieces:
    """Where the ids of known pieces start and how many they are, sorted by key."""

    def __init__(self, keys=(), starts=(), lengths=()):
        self.keys, self.starts, self.lengths = np.array(keys, np.uint64), np.array(starts, np.int64), np.array(lengths, np.int64)

    def plus(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Pieces:
        both = np.r_[self.keys, keys]
        order = np.argsort(both, kind="stable")
        return Pieces(both[order], np.r_[self.starts, starts][order], np.r_[self.lengths, lengths][order])

    def find(self, keys: np.ndarray, rows: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Fills in what is known of ``rows``; the other rows."""
        if not len(self.keys) or not len(rows):
            return rows
        own = keys[rows]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hit = self.keys[at] == own
        start[rows[hit]], length[rows[hit]] = self.starts[at[hit]], self.lengths[at[hit]]
        return rows[~hit]


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct piece of a bounded memory.

    A space between two characters that are no blanks always begins a pretoken. Texts are cut
    there, on their bytes; pieces are recognised by a 64-bit hash and their length. The library gets
    the distinct unknown pieces, many to a call: a piece's ids begin at the only token that
    starts with the space. Pieces with other spaces, and those that open a text, go alone.
    """

    def __init__(self, vocab_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocab_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith(SPACE_LETTER)]] = True
        self._forget()

    def _forget(self) -> None:
        self.old, self.new = Pieces(), Pieces()  # the new ones join the old ones once a batch
        self.flat = np.empty(0, np.uint32)

    def _ids(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray, plain: np.ndarray) -> None:
        """Pieces data[first:last] under their keys; ``plain`` ones hold one space, at their start."""
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        many, flat, lengths = int(plain.sum()), [], []
        for at in range(0, many, CALL_PIECES):
            own = order[at : min(at + CALL_PIECES, many)]
            size = last[own] - first[own]
            ends = np.cumsum(size)
            text = data[np.repeat(first[own] - (ends - size), size) + np.arange(ends[-1])].tobytes().decode()
            ids = self._ids([text])[0]
            flat.append(ids)
            lengths.append(np.diff(np.r_[np.flatnonzero(self.spaced[ids]), len(ids)]))
        alone: list[np.ndarray] = []
        for at in range(many, len(order), CALL_PIECES):
            alone += self._ids([data[first[k] : last[k]].tobytes().decode() for k in order[at : at + CALL_PIECES]])
        flat += alone
        lengths.append(np.array([len(x) for x in alone], np.int64))
        new = np.concatenate(lengths).astype(np.int64)
        starts = len(self.flat) + np.cumsum(new) - new
        self.flat = np.concatenate([self.flat, *flat])
        self.new = self.new.plus(keys[order], starts, new)

    def _group(self, data: np.ndarray, bounds: np.ndarray, end: int | None) -> Iterator[bytes]:
        """Ids of adjoining texts; ``bounds`` are their starts and the last end."""
        is_space = data == 32
        at = np.flatnonzero(is_space)
        at = at[(at > 0) & (at < len(data) - 1)]
        before, after = data[at - 1], data[at + 1]
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        # no cut beside a blank, nor where a wide character might be one
        wide_before = (before >= 128) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
        wide_after = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
        at = at[~(IS_BLANK[before] | IS_BLANK[after] | wide_before | wide_after)]
        full = bounds[:-1][np.diff(bounds) > 0]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        at = at[~np.isin(at, inner) & ~np.isin(at + 1, inner)]  # an outermost space of a text is no cut
        # a mark between a letter and such a cut is a pretoken too
        mark = at[at > 1] - 1
        mark = mark[IS_MARK[data[mark]] & IS_LETTER[data[mark - 1]]]
        first = distinct(np.r_[full, at, mark])
        last = np.r_[first[1:], len(data)]
        spaces = np.r_[0, np.cumsum(is_space)]
        plain = (spaces[last] - spaces[first] == 1) & is_space[first] & ~np.isin(first, full)
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
        keys = mix(mix((sums[last] - sums[first]) * down[first]) + (last - first).astype(np.uint64) * np.uint64(2) + plain)
        start, length = np.empty(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        missing = np.arange(len(keys))
        for table in (self.old, self.new):
            missing = table.find(keys, missing, start, length)
        if len(missing):
            fresh, some = np.unique(keys[missing], return_index=True)
            k = missing[some]
            self._learn(fresh, data, first[k], last[k], plain[k])
            self.new.find(keys, missing, start, length)
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
        pieces = np.searchsorted(first, bounds)
        cuts = np.r_[0, ends][pieces]
        last_id = b"" if end is None else int(end).to_bytes(4, "little")
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield ids[x:y].astype("<u4").tobytes() + last_id

    def encode_column(self, column: pa.Array, end: int | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; nulls are empty."""
        self.old, self.new = self.old.plus(self.new.keys, self.new.starts, self.new.lengths), Pieces()
        if len(self.old.keys) > CACHE_PIECES:
            self._forget()
        data, at = texts(column)
        out, row = [], 0
        empty = b"" if end is None else int(end).to_bytes(4, "little")
        while row < len(at) - 1:
            to = max(row + 1, int(np.searchsorted(at, at[row] + SEGMENT, "right")) - 1)
            if at[to] > at[row]:
                out += self._group(data[at[row] : at[to]], at[row : to + 1] - at[row], end)
            else:
                out += [empty] * (to - row)
            row = to
        return out

    def encode(self, given: list[str], end: int | None = None) -> list[bytes]:
        return self.encode_column(pa.array(given, pa.string()), end)


@functools.lru_cache(1)
def worker_encoder(vocab_json: str) -> LibraryEncoder:
    """The encoder of this Python worker: its tasks share the vocabulary and the pieces that are known."""
    return LibraryEncoder(vocab_json)


IS_MARK, IS_LETTER = (np.isin(np.arange(256), list(x)) for x in (b".,", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_CODES = np.random.default_rng(4711).integers(1, 1 << 63, 256, dtype=np.uint64)


def train_dictionary(docs: DataFrame, vocab_json: str, *, text: str, doc_id: str) -> bytes:
    """Shared dictionary from a bounded sample of whole documents; empty where they are too few to train on.

    The sample is the SAMPLE_DOCS non-null texts of the lowest hashes, as far as they fit in
    SAMPLE_BYTES together, so it depends on no order of tasks.
    """
    slim = docs.where(F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("h"), F.octet_length(text).alias("size"))
    lowest = slim.orderBy("h", "size").limit(SAMPLE_DOCS).collect()  # a bounded top-k: each task sends its own SAMPLE_DOCS
    total, wanted = 0, set()
    for r in lowest:
        if r["h"] not in wanted and total + r["size"] <= SAMPLE_BYTES:
            total += r["size"]
            wanted.add(r["h"])
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t"))
    rows = hashed.where(F.col("h").isin(*wanted)).dropDuplicates(["h"]).collect() if wanted else []
    rows.sort(key=lambda r: (r["h"], r["t"]))
    arrays = LibraryEncoder(vocab_json).encode([r["t"] for r in rows])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary, digested once for compression at a level."""
    found = zstandard.ZstdCompressionDict(raw) if raw else None
    if found and level is not None:
        found.precompute_compress(level=level)
    return found


def write(docs: DataFrame, path: str, vocab_file: str, *, text: str = "text", doc_id: str = "doc_id", end: int = 2, level: int = 1, part_bytes: int = 56 << 20) -> None:
    """Writes ``path/shards`` and ``path/dictionary``."""
    spark = docs.sparkSession
    with open(vocab_file, encoding="utf-8") as f:
        vocab_json = f.read()
    raw = train_dictionary(docs, vocab_json, text=text, doc_id=doc_id)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "dictionary string, bytes binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast((vocab_json, raw))  # bounded: a tokenizer file and 64 KiB

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        vocab, dictionary = shared.value
        encoder = worker_encoder(vocab)
        press = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary, level))
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def record() -> pa.RecordBatch:
            nonlocal number, first
            ids = sum(n for _, n, _ in held)
            row = {
                "part": part, "number": number, "docs": len(held), "ids": ids, "first_id": first, "dictionary": name,
                "doc_ids": np.array([NULL_ID if d is None else d for d, _, _ in held], "<i8").tobytes(),
                "null_ids": np.packbits([d is None for d, _, _ in held]).tobytes(),
                "lengths": np.array([n for _, n, _ in held], "<u4").tobytes(),
                "offsets": np.cumsum([0, *(len(b) for _, _, b in held)]).astype("<u8").tobytes(),
                "payload": b"".join(b for _, _, b in held),
            }
            number, first = number + 1, first + ids
            held.clear()
            trim()
            return pa.RecordBatch.from_pylist([row], schema=RECORD_SCHEMA)

        for batch in batches:
            keys = batch.column(doc_id).to_pylist()
            for key, ids in zip(keys, encoder.encode_column(batch.column(text), end), strict=True):
                held.append((key, len(ids) // 4, press.compress(ids)))
                size += len(held[-1][2])
                if len(held) == SHARD_DOCS or size >= SHARD_BYTES:
                    yield record()
                    size = 0
        if held:
            yield record()

    # large parts: a task asks the library once for each piece, and words repeat
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    parts = max(-(-(size or 0) // part_bytes), min(8, -(-n // 1024)), 1)
    # rows of one doc_id, or without one, are dealt by their text
    order = [F.col(doc_id).asc_nulls_first(), F.col("text_hash")]
    ordered = docs.select(F.col(doc_id).cast("long").alias(doc_id), text, F.xxhash64(text).alias("text_hash")).repartitionByRange(parts, *order)
    ordered = ordered.sortWithinPartitions(*order).select(doc_id, text)
    # frames are compressed already; Parquet's codec would hold each payload twice more, off the heap, until a collection
    with arrow_limits(spark, rows=1024, size="4m"):
        ordered.mapInArrow(records, RECORD).write.mode("overwrite").option("compression", "none").parquet(f"{path}/shards")


RECORD_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int32()), ("ids", pa.int64()), ("first_id", pa.int64()), ("dictionary", pa.string()), *[(c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "offsets", "payload")]])


class Shard:
    """One record: single documents by position, without decompressing the others."""

    def __init__(self, record: dict, raw: bytes):
        if hashlib.sha256(raw).hexdigest() != record["dictionary"]:
            raise ValueError(f"this shard needs dictionary {record['dictionary']}")
        self.nulls = np.unpackbits(np.frombuffer(record["null_ids"], np.uint8), count=record["docs"]).astype(bool)
        self.doc_ids, self.lengths, self.offsets = (np.frombuffer(record[c], t) for c, t in (("doc_ids", "<i8"), ("lengths", "<u4"), ("offsets", "<u8")))
        self.payload, self._open = record["payload"], zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def bytes_at(self, k: int) -> bytes:
        frame = memoryview(self.payload)[int(self.offsets[k]) : int(self.offsets[k + 1])]
        return self._open.decompress(frame, max_output_size=4 * int(self.lengths[k]))

    def ids_at(self, k: int) -> np.ndarray:
        return np.frombuffer(self.bytes_at(k), "<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of a document of this shard, by binary search in the index."""
        known = int(self.nulls.sum())
        k = known + int(np.searchsorted(self.doc_ids[known:], doc_id))
        return self.ids_at(k) if k < len(self.doc_ids) and self.doc_ids[k] == doc_id else None


def _read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    raw = spark.sparkContext.broadcast(_read_dictionary(spark, path))
    shards = spark.read.parquet(f"{path}/shards")
    # one number per part, of which there are as many as write tasks
    sums = shards.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    before = dict(zip([r["part"] for r in sums], np.cumsum([0, *(r["ids"] for r in sums)]).tolist(), strict=False))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                shard = Shard(record, raw.value)
                starts = before[record["part"]] + record["first_id"] + np.cumsum(shard.lengths, dtype=np.int64) - shard.lengths
                sums = [zlib.crc32(shard.bytes_at(k)) for k in range(record["docs"])]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls), pa.array(starts), pa.array(shard.lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    with arrow_limits(spark, rows=8):
        return Scratch(spark, "tokens").save(shards.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long"), "read")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the named documents; reads their shards and opens their frames only."""
    raw = spark.sparkContext.broadcast(_read_dictionary(spark, path))
    wanted = sorted(set(doc_ids))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.to_pylist():
                shard = Shard(record, raw.value)
                hits = np.flatnonzero(np.isin(shard.doc_ids, wanted) & ~shard.nulls)
                if len(hits):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[hits]), pa.array([shard.ids_at(k).astype(np.int64) for k in hits], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    with arrow_limits(spark, rows=8):
        return Scratch(spark, "tokens").save(spark.read.parquet(f"{path}/shards").mapInArrow(rows, "doc_id long, ids array<long>"), "lookup")
