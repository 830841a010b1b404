"""Information-theoretic sanitisation of personal data.

Entities are the e-mail addresses, IP addresses, card and phone numbers that fixed patterns
find. Corpus co-occurrence then estimates how much a term in an entity's neighbourhood tells
about it: with P(e) the share of distinct texts around entity e and P(e|t) the share of the
distinct texts with term t in which t stands near e, the disclosed share of the entity's
information is PMI(e; t) / IC(e) = log(P(e|t) / P(e)) / -log P(e). Terms that disclose at
least ``generalise_at`` of some entity are generalised, from ``remove_at`` on removed, wherever they
stand. Near are the ``NEAR`` terms on either side, of any length, numbers included. Support is
counted in distinct contexts, the ``CONTEXT`` terms on either side, so copies of one text prove nothing;
fewer than ``min_contexts`` of them are no evidence, and such terms stay.

A term also discloses itself: PMI(t; t) is its own information. That is estimated from the
letter pairs of all texts, -sum log2 P(byte | byte before). Long mixtures of letters and digits
of at least ``secret_bits``, and SECRET_RATE bits a byte, are keys and tokens rather than words, and
are removed.

Defined cases: a null text counts as empty; repeated rows get equal results; an empty table
gives an empty table. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import Scratch, arrow_limits, free_names, row_key, trim
from roadlark.llm.hashing import _hash_segment, texts

#: Kinds in their order, and the patterns with possessive quantifiers, so that long runs stay linear.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

FILTER_BITS = 23
#: Bytes that belong to a term: ASCII letters and digits and all of other scripts.
IS_TERM = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)
NEAR, CONTEXT = 32, 4
SECRET_BYTES, SECRET_RATE = 16, 5.0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            # a part's length is bounded before it is read as a number
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the terms of adjoining texts."""
    term = IS_TERM[data]
    first, last = term.copy(), term.copy()
    first[1:] &= ~term[:-1]
    last[:-1] &= ~term[1:]
    inner = starts[(starts > 0) & (starts < len(data))]
    first[inner], last[inner - 1] = term[inner], term[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, _hash_segment(data, a, b) if len(a) else np.empty(0, np.uint64)


def _near_terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, term, context) of the terms near each entity and outside all base spans, each pair once a context."""
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]  # byte of each code point
    a, b, h = _terms(data, np.zeros(1, np.int64))
    starts, ends = place[[s for s, _, _ in spans]], np.maximum.accumulate(place[[e for _, e, _ in spans]])
    at = np.searchsorted(ends, a, "right")  # the first span that ends behind the term's start
    free = np.r_[starts, len(data)][at] >= b
    a, h = a[free], h[free]
    k = np.searchsorted(a, starts)
    context = np.zeros(len(spans), np.uint64)
    for off in range(-CONTEXT, CONTEXT):
        inside = (k + off >= 0) & (k + off < len(h))
        context[inside] ^= h[(k + off)[inside]] * np.uint64(2 * (off + CONTEXT) + 3)
    entity = np.array([int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{text[s:e].lower()}".encode(), digest_size=8).digest(), "little") for s, e, kind in spans], np.uint64)
    low, high = np.maximum(k - NEAR, 0), np.minimum(k + NEAR, len(h))
    size = np.maximum(high - low, 0)
    upto = np.cumsum(size)
    owner = np.repeat(np.arange(len(spans)), size)
    term = h[np.repeat(low - (upto - size), size) + np.arange(upto[-1])]
    order = np.lexsort((term, context[owner], entity[owner]))
    rows = np.stack([entity[owner], term, context[owner]])[:, order]
    new = np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(0)] if len(order) else np.empty(0, bool)
    return tuple(rows[:, new].view(np.int64))


NEAR_TYPE = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _near_column(given: list[str | None], spans: list[list]) -> pa.Array:
    parts = [_near_terms(t, own) if own else (np.empty(0, np.int64),) * 3 for t, own in zip(given, spans, strict=True)]
    offsets = np.r_[0, np.cumsum([len(p[0]) for p in parts])].astype(np.int32)
    flat = [pa.array(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64)) for k in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, names=["entity", "term", "context"])).cast(NEAR_TYPE)


def find_base(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry``, row_key, text_key, the four counts, base_sha256, base (spans) and near (terms beside entities)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            given = batch.column("_text").to_pylist()
            spans = [base_spans(t) if t else [] for t in given]
            counts = [pa.array([sum(s[2] == k for s in own) for own in spans], pa.int64()) for k in range(4)]
            shas = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in own).encode()).hexdigest() for own in spans]
            base = pa.array([[{"start": a, "kind": k, "end": b} for a, b, k in own] for own in spans], SPAN_TYPE)
            near = _near_column(given, spans)
            carried = [batch.column(c) for c in [*carry, "row_key", "text_key"]]
            yield pa.RecordBatch.from_arrays([*carried, *counts, pa.array(shas), base, near], names=[*carry, "row_key", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"])

    kinds = dict(docs.dtypes)
    keyed = docs.select(*carry, row_key(*carry, text).alias("row_key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", row_key long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:long,term:long,context:long>>"
    return keyed.mapInArrow(find, schema)


def letter_pairs(docs: DataFrame, *, text: str) -> np.ndarray:
    """Bits of each byte after each other one inside terms, 256 x 256, from all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, at = texts(batch.column(0))
            for row in range(int(at[0]), int(at[-1]), 1 << 22):
                own = data[row : min(row + (1 << 22), int(at[-1]))]
                inside = IS_TERM[own[:-1]] & IS_TERM[own[1:]]
                times += np.bincount(own[:-1][inside].astype(np.int64) * 256 + own[1:][inside], minlength=1 << 16)
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_pydict({"pair": some.astype(np.int64), "times": times[some]})

    found = docs.select(text).mapInArrow(count, "pair long, times long").groupBy("pair").agg(F.sum("times").alias("times")).collect()  # 65,536 rows at most
    times = np.full(1 << 16, 0.5)
    for r in found:
        times[r["pair"]] += r["times"]
    times = times.reshape(256, 256)
    return np.log2(times.sum(1, keepdims=True)) - np.log2(times)


def _is_secret(word: bytes, bits: np.ndarray, secret_bits: float) -> bool:
    """Whether a term of letters and digits holds that much information."""
    w = np.frombuffer(word, np.uint8)
    digit = (w >= 48) & (w <= 57)
    own = float(bits[w[:-1], w[1:]].sum())
    return bool(digit.any() and not digit.all() and own >= secret_bits and own >= SECRET_RATE * len(w))


def disclosing_spans(docs: DataFrame, base: DataFrame, scratch: Scratch, *, text: str, carry: tuple[str, ...], min_contexts: int, generalise_at: float, remove_at: float, secret_bits: float) -> DataFrame:
    """row_key and array ``terms`` of (start, kind, end, removed), for texts with disclosing terms or secrets."""
    spark = docs.sparkSession
    n = base.select("text_key").distinct().count()
    near = base.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*")
    entities = near.groupBy("entity").agg(F.count_distinct("context").alias("n_e")).withColumn("p_e", F.col("n_e") / F.lit(float(max(n, 1))))
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_te")).where(F.col("n_te") >= min_contexts)
    # P(e|t) is at most n_te over the texts that hold t near any entity; terms that this bound
    # already keeps below the threshold (common words beside many entities) need no corpus count
    beside = near.groupBy("term").agg(F.count_distinct("text_key").alias("n_beside"))
    least = F.pow("p_e", F.lit(1.0 - generalise_at))
    pairs = pairs.join(entities, "entity").join(beside, "term").where(F.col("n_te") / F.col("n_beside") >= 0.999 * least)
    pairs = scratch.save(pairs, "pairs")
    bits = pairs.select(F.pmod("term", F.lit(1 << FILTER_BITS)).alias("h")).groupBy(F.shiftright("h", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    # a filter of fixed size, before exact joins, and the bits of letter pairs
    shared = spark.sparkContext.broadcast((table.view(np.uint64), letter_pairs(docs, text=text)))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        wanted, pair_bits = shared.value
        for batch in batches:
            data, at = texts(batch.column("_text"))
            row = 0
            while row < len(at) - 1:
                to = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 20), "right")) - 1)
                own, starts = data[at[row] : at[to]], at[row:to] - at[row]
                a, b, h = _terms(own, starts) if len(own) else (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
                slot = h & np.uint64((1 << FILTER_BITS) - 1)
                hit = (wanted[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                secret = np.zeros(len(a), bool)
                for k in np.flatnonzero(b - a >= SECRET_BYTES).tolist():
                    secret[k] = _is_secret(own[a[k] : b[k]].tobytes(), pair_bits, secret_bits)
                hit = np.flatnonzero(hit | secret)
                if len(hit):
                    points = np.r_[0, np.cumsum((own & 0xC0) != 0x80)]
                    doc = np.searchsorted(starts, a[hit], "right") - 1
                    shift = points[starts[doc]]
                    columns = [batch.column(c).take(pa.array(doc + row)) for c in ("row_key", "text_key")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(h[hit].astype(np.int64)), pa.array((points[a[hit]] - shift).astype(np.int32)), pa.array((points[b[hit]] - shift).astype(np.int32)), pa.array(secret[hit])], names=["row_key", "text_key", "term", "start", "end", "secret"])
                row = to

    keyed = docs.select(row_key(*carry, text).alias("row_key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("_text"))
    found = scratch.save(keyed.mapInArrow(hits, "row_key long, text_key long, term long, start int, end int, secret boolean"), "hits")
    n_t = found.groupBy("term").agg(F.count_distinct("text_key").alias("n_t"))
    told = pairs.join(n_t, "term").withColumn("p_et", F.least(F.lit(1.0), F.col("n_te") / F.col("n_t")))
    share = told.withColumn("share", F.log(F.col("p_et") / F.col("p_e")) / -F.log("p_e")).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= generalise_at)
    spans = found.join(share, "term", "left").where(F.col("secret") | F.col("share").isNotNull())
    removed = F.col("secret") | (F.col("share") >= remove_at)
    spans = spans.select("row_key", F.struct("start", F.lit(4).alias("kind"), "end", removed.alias("removed")).alias("span")).distinct()
    return spans.groupBy("row_key").agg(F.sort_array(F.collect_list("span")).alias("terms"))


def spans(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), min_contexts: int = 3, generalise_at: float = 0.9, remove_at: float = 0.97, secret_bits: float = 100.0) -> DataFrame:
    """``carry``, row_key, the four counts, base_sha256 and ``found``: all spans by start, then kind.

    A term span that overlaps a base span is left out; the base span covers it.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    with arrow_limits(docs.sparkSession):
        base = scratch.save(find_base(docs, text=text, carry=carry), "base")
        terms = disclosing_spans(docs, base, scratch, text=text, carry=carry, min_contexts=min_contexts, generalise_at=generalise_at, remove_at=remove_at, secret_bits=secret_bits)
    joined = base.join(terms, "row_key", "left")
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("removed")))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])))
    found = F.when(F.col("terms").isNull(), own).otherwise(F.sort_array(F.concat(own, apart)))
    return joined.withColumn("found", found).drop("base", "near", "terms", "text_key")


def spelled(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: str, found: list[dict]) -> str:
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:  # inside or across a span already replaced: what is left of it goes too
            at = max(at, s["end"])
            continue
        word = text[s["start"] : s["end"]]
        if s["kind"] < 4:
            mask = f"<{KINDS[s['kind']].upper()}>"
        elif s["removed"]:
            mask = ""
        else:
            mask = "<NUMBER>" if any(c.isdigit() for c in word) else "<NAME>" if word[:1].isupper() else "<WORD>"
        out += [text[at : s["start"]], mask]
        at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with base spans masked and disclosing terms generalised or removed; other columns stay, ``n_chars`` follows the text."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    key, found = free_names(docs, "row_key", "found")
    marked = spans(slim, text="body", **options).where(F.size("found") > 0).select(F.col("row_key").alias(key), F.col("found").alias(found)).dropDuplicates([key])
    rest = [c for c in docs.columns if c != text]

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            given, own = batch.column(text).to_pylist(), batch.column(found).to_pylist()
            made = [_masked(t, f) if t and f else t for t, f in zip(given, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(made, pa.string())], names=[*rest, text])

    joined = docs.withColumn(key, row_key(doc_id, text)).join(marked, key, "left").select(*rest, text, found)
    kinds = dict(docs.dtypes)
    with arrow_limits(docs.sparkSession):
        out = Scratch(docs.sparkSession, "pii").save(joined.mapInArrow(mask, ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, text])), "masked")
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.coalesce(F.length(text).cast(kinds["n_chars"]), F.col("n_chars")))
    return out.select(*docs.columns)
