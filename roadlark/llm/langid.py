"""Language identification in two levels: the family first, then the language within it.

A text is the square roots of the relative frequencies of its hashed letter n-grams (1 to 4
characters within a word and its boundaries), so every text has length 1. Linear support vector machines tell
each family from all others; within the family of the highest margin, one machine for each pair of its languages
votes, and the language of the most votes wins (of equal ones, that of the greater sum of margins). The score is the
softmax of the family margins times the mean probability with which the winner beats its relatives.

Families are a parameter: a table of language code to family. A code that it lacks is a family by
itself, so it meets no pairwise machine.

The machines are fitted on a bounded hash sample: at most ``PER_LANGUAGE`` distinct texts of each
language, and of a family's languages together for the family machines; each text counts as a whole, by its first words and by
some from within, so that short texts are known too. Each machine is fitted in a task of its own.
Rows sent to the driver are one weight vector a machine: families plus pairs within families, under
``MAX_LANGUAGES`` squared, of 32 kB each. Scoring reads every whole text, in segments of bounded length that end
between words (a word of over a million letters is cut).

Defined cases: a null text or one without a letter is ``und`` with score 0; a null lang teaches
nothing; without a learned language every text is ``und``; with a single one every text with a
letter is that, with score 1; a null doc_id is not held out; repeated rows are scored alike; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadlark.llm.common import Scratch, arrow_limits, trim

ORDERS, BITS = (1, 2, 3, 4), 13
BUCKETS = 1 << BITS
#: Texts of each language that the machines are fitted on, and languages that a table may name.
PER_LANGUAGE, MAX_LANGUAGES = 400, 256
UNKNOWN = "und"
#: Words of a text's short forms in training.
FEW, SOME = 3, 9
SEGMENT_CHARS, GROUP_TEXTS = 1 << 20, 128
#: ISO 639 codes by family.
FAMILIES = {
    "Germanic": "en de nl sv da no nb nn is af fy lb yi",
    "Romance": "fr es it pt ro ca gl oc la",
    "Slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "Baltic": "lt lv",
    "Uralic": "fi et hu",
    "Celtic": "ga gd cy br",
    "Turkic": "tr az kk uz ky tk",
    "Semitic": "ar he mt am",
    "Iranian": "fa ku ps tg",
    "Indic": "hi bn mr ur pa gu ne si",
    "Dravidian": "ta te kn ml",
    "Austronesian": "id ms jv su tl",
    "Sinitic": "zh yue wuu",
}
_odd = (np.random.default_rng(4).integers(1, 1 << 31, 8, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_letters: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def family_of(lang: str, families: dict[str, str]) -> str:
    """The family of a language code, with or without a region; the code itself where the table lacks it."""
    code = lang.lower().replace("_", "-").partition("-")[0]
    return next((f for f, codes in families.items() if code in codes.split(" ")), lang)


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _segments(texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """(joined texts, text of each character), for texts of about SEGMENT_CHARS together; long ones in parts."""
    held, owners, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            to = min(at + SEGMENT_CHARS, len(text))
            if to < len(text):  # back to the last character that is no letter
                cut = to
                while cut > at and text[cut - 1].isalpha():
                    cut -= 1
                to = cut if cut > at else to
            held.append(text[at:to])
            owners.append((k, to - at + 1))
            size += to - at
            at = to
            if size >= SEGMENT_CHARS:
                yield " ".join(held) + " ", np.repeat(*np.array(owners, np.int64).T)
                held, owners, size = [], [], 0
    if held:
        yield " ".join(held) + " ", np.repeat(*np.array(owners, np.int64).T)


def counts(texts: list[str]) -> np.ndarray:
    """n-grams of each text by bucket; a row of zeros for a text without a letter."""
    out = np.zeros((len(texts), BUCKETS), np.int64)
    letter = is_letter()
    for text, owner in _segments([t.lower() for t in texts]):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        word = letter[codes]
        used = word | np.r_[True, word[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
        gap = ~word[used]
        codes, owner = np.where(gap, np.uint32(32), codes[used]), owner[used]
        # a gap before the first character bounds its word too
        codes, owner, gap = np.r_[np.uint32(32), codes], np.r_[owner[:1], owner], np.r_[True, gap]
        run, whole = codes * _odd[0], ~gap
        for n in ORDERS:
            if n > 1:
                run = run[:-1] * _odd[1] + codes[n - 1 :]
                # gaps only at the ends, and not at both of a pair
                whole = ~(gap[:-1] & gap[1:]) if n == 2 else whole[:-1] & ~gap[n - 2 : -1] if n > 3 else ~gap[1:-1]
            bucket = (run * _odd[1 + n]) >> np.uint32(32 - BITS)
            at = np.flatnonzero(whole)
            # the n-gram of a word belongs to the text of its last letter, not of the gap before it
            of = owner[at + (1 if n > 1 else 0)]
            out += np.bincount(of * BUCKETS + bucket[at], minlength=out.size).reshape(out.shape)
    return out


def profiles(texts: list[str]) -> np.ndarray:
    found = counts(texts)
    return np.sqrt(found / np.maximum(found.sum(1, keepdims=True), 1)).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights, and the bias last, of a linear machine of squared hinge loss, by dual coordinate descent.

    ``rows`` are (buckets, values) of length 1; both signs weigh the same.
    """
    weights = np.zeros(BUCKETS + 1)
    each = cost * len(signs) / (2 * np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum())))
    slack, dual, rng = 0.5 / each, np.zeros(len(signs)), np.random.default_rng(1)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(signs)):
            at, x = rows[i]
            grad = signs[i] * (weights[at] @ x + weights[-1]) - 1 + slack[i] * dual[i]
            if (step := max(-dual[i], -grad / (2.0 + slack[i]))) != 0:
                dual[i] += step
                weights[at] += step * signs[i] * x
                weights[-1] += step * signs[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights


@dataclass
class Model:
    """Machines in the columns of ``weights`` (bias in the last row): one a family (none for a single one), then one a pair."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        given = ["" if t is None else t for t in texts]
        found = counts(given)
        total = found.sum(1)
        names, scores = [UNKNOWN] * len(given), [0.0] * len(given)
        if not self.families:
            return names, scores
        margins = np.sqrt(found / np.maximum(total[:, None], 1)).astype(np.float32) @ self.weights[:-1] + self.weights[-1]
        many = len(self.families) if len(self.families) > 1 else 0
        if many:
            own = np.exp(4.0 * (margins[:, :many] - margins[:, :many].max(1, keepdims=True)))
            share = own / own.sum(1, keepdims=True)
        else:
            share = np.ones((len(given), 1))
        best = share.argmax(1)
        place = {p: many + k for k, p in enumerate(self.pairs)}
        for f, langs in enumerate(self.families):
            rows = np.flatnonzero((best == f) & (total > 0))
            votes, sums, odds = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for a in range(len(langs)):
                for b in range(a + 1, len(langs)):
                    m = margins[rows, place[langs[a], langs[b]]]
                    p = 1 / (1 + np.exp(-np.clip(4.0 * m, -30, 30)))
                    for lang, v, s, q in ((a, m >= 0, m, p), (b, m < 0, -m, 1 - p)):
                        votes[:, lang] += v
                        sums[:, lang] += s
                        odds[:, lang] += q
            for r, v, s, q in zip(rows.tolist(), votes, sums, odds, strict=True):
                won = max(range(len(langs)), key=lambda k: (v[k], s[k], -k))
                names[r], scores[r] = langs[won], float(np.clip(share[r, f] * (q[won] / (len(langs) - 1) if len(langs) > 1 else 1.0), 0.0, 1.0))
        return names, scores


def _forms(text: str) -> list[str]:
    """The text, its first words, and some from its middle."""
    words = text.split()
    if len(words) <= FEW:
        return [text]
    middle = len(words) // 2
    return [text, " ".join(words[:FEW]), " ".join(words[middle : middle + SOME])]


def learn(docs: DataFrame, scratch: Scratch, *, text: str, lang: str, families: dict[str, str], per_language: int) -> Model:
    """Machines of the languages of ``docs``, whose rows are all for training."""
    given = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang}")
    spark, unit = docs.sparkSession, 1 << 30
    shares = spark.createDataFrame([(c, int(min(1.0, 1.5 * per_language / n) * unit)) for c, n in sizes.items()], "lang string, share long")
    few = given.withColumn("hash", F.xxhash64("text")).join(F.broadcast(shares), "lang").where(F.pmod("hash", F.lit(unit)) < F.col("share")).dropDuplicates(["lang", "hash"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))  # of about 1.5 * per_language rows a language
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ranks, texts = (batch.column(c).to_pylist() for c in ("lang", "rank", "text"))
            for at in range(0, len(texts), GROUP_TEXTS // 4):
                forms = [(k, form) for k in range(at, min(at + GROUP_TEXTS // 4, len(texts))) for form in _forms(texts[k])]
                rows = [(langs[k], ranks[k], x) for (k, _), x in zip(forms, profiles([f for _, f in forms]), strict=True) if x.any()]
                kept = [np.flatnonzero(x) for _, _, x in rows]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "rank": pa.array([r[1] for r in rows], pa.int32()), "at": pa.array([i.astype("<u2").tobytes() for i in kept], pa.binary()), "x": pa.array([r[2][i].astype("<f4").tobytes() for r, i in zip(rows, kept, strict=True)], pa.binary())})

    sample = scratch.save(chosen.select("lang", "rank", "text").mapInArrow(features, "lang string, rank int, at binary, x binary"), "sample")
    known = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # languages with a letter
    groups: dict[str, list[str]] = {}
    for c in known:
        groups.setdefault(family_of(c, families), []).append(c)
    kin = [groups[f] for f in sorted(groups)]
    pairs = [(a, b) for langs in kin for k, a in enumerate(langs) for b in langs[k + 1 :]]
    many = len(kin) if len(kin) > 1 else 0
    most = {c: max(1, per_language // len(langs)) for langs in kin for c in langs}
    jobs = [(f, c, 1 if c in kin[f] else -1, most[c]) for f in range(many) for c in known]
    jobs += [(many + k, c, s, per_language) for k, pair in enumerate(pairs) for c, s in zip(pair, (1, -1), strict=True)]
    weights = np.zeros((BUCKETS + 1, many + len(pairs)), np.float32)
    if jobs:

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("lang", "ascending"), ("rank", "ascending"), ("at", "ascending")])
            rows = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for a, x in zip(table["at"].to_pylist(), table["x"].to_pylist(), strict=True)]
            found = fit(rows, table["sign"].to_numpy().astype(float))
            return pa.table({"job": table["job"].slice(0, 1), "weights": pa.array([found.astype("<f4").tobytes()], pa.binary())})

        # at most MAX_LANGUAGES squared short rows
        each = sample.join(F.broadcast(spark.createDataFrame(jobs, "job int, lang string, sign int, most int")), "lang").where("rank <= most")
        for r in each.select("job", "lang", "rank", "sign", "at", "x").groupBy("job").applyInArrow(train, "job int, weights binary").collect():
            weights[:, r["job"]] = np.frombuffer(r["weights"], "<f4")
    return Model(kin, pairs, weights)


def identify(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", families: dict[str, str] = FAMILIES, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Rows that are held out are not learned from."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "langid")
    with arrow_limits(spark):
        model = learn(docs.where(~held_out(F.col(f"`{doc_id}`"))), scratch, text=text, lang=lang, families=families, per_language=per_language)
        shared = spark.sparkContext.broadcast(model)  # 32 kB a machine

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, scores = [], []
                for at in range(0, len(batch), GROUP_TEXTS):
                    found = shared.value.predict(batch.column("text").slice(at, GROUP_TEXTS).to_pylist())
                    names += found[0]
                    scores += found[1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
            trim()

        keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out(F.col(f"`{doc_id}`")).alias("held_out"), F.col(f"`{text}`").alias("text"))
        return scratch.save(keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, lang_pred string, score double"), "predicted")
