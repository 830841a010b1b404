"""Quality rules by cross-document line frequency. DataFrame functions only.

Lines that many documents of a host share are navigation, notices or other
boilerplate. Lines are normalised and hashed, the distinct documents of each
(host, line) are counted, lines above the limit are removed, and documents
that lose nearly all of their words that way are rejected. The limit is a number of
documents, the same for each host: that many texts which differ elsewhere and agree in
a whole line show a template, and further texts of the host without it prove nothing against that.

Defined cases: a null text counts as empty (all counts 0, rejected for having few
words); a null host is a host of its own; equal texts of a host count as one
document, so that copies do not make their own lines frequent; repeated rows get
equal results; an empty table gives an empty table; further columns of the input
are carried along unless ``score`` is told otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlark.llm.common import BLANKS, Scratch, free_names, let, words

SYMBOLS = "#*$%&|<>"
#: Bits of a packed window that hold its position; texts with more words take the slower form.
POSITION_BITS = 24


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), _has_word)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(tokens: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text.

    Windows are sorted by hash with their position packed into the low bits. Neighbours of equal
    hash are compared word by word; if two of them differ, the text's windows are sorted by
    their words instead, so a hash collision neither adds nor hides a repetition.
    """
    mask = (1 << POSITION_BITS) - 1
    zero = F.lit(0).cast("long")

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), zero.alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(positions), start, step, lambda a: a["n"])

    def repeated(s: Column, same_as_next: Column, at: Callable[[Column], Column]) -> Column:
        """Of the sorted windows those that equal a neighbour; ``same_as_next`` is 1 where one equals the next."""
        hit = lambda x, k: (F.get(same_as_next, k) == 1) | (F.coalesce(F.get(same_as_next, k - 1), F.lit(0)) == 1)
        return covered(F.transform(F.filter(s, hit), at))

    def by_words(w: Column) -> Column:
        window = lambda i: F.struct(F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.alias("i"))
        like = lambda a, b: F.coalesce((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.lit(False)).cast("int")
        both = lambda s: let(F.transform(s, lambda x, k: like(x, F.get(s, k + 1))), lambda e: repeated(s, e, lambda x: x["i"]))
        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), both)

    def by_hash(w: Column) -> Column:
        pack = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long"))
        at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
        same = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def compared(s: Column) -> Column:
            # against the next window: 0 another hash, 1 the same words, 2 a collision
            like = lambda x, y: F.when(F.shiftright(x, POSITION_BITS) != F.shiftright(y, POSITION_BITS), 0).when(same(at(x), at(y)), 1).otherwise(2)
            beside = F.transform(s, lambda x, k: F.when(k + 1 < F.size(s), like(x, F.get(s, k + 1))).otherwise(0))
            return let(beside, lambda e: F.when(F.array_contains(e, 2), by_words(w)).otherwise(repeated(s, e, at)))

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), pack)), compared)

    return let(tokens, lambda w: F.when(F.size(w) < 4, zero).when(F.size(w) <= mask, by_hash(w)).otherwise(by_words(w)))


def normal_lines(text: Column) -> Column:
    """Lines with a word, lower-cased, blanks collapsed, as structs of hash and number of words."""
    tidy = F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " ")
    lines = F.filter(F.transform(F.split(tidy, "\n"), lambda x: F.btrim(x, F.lit(" "))), lambda x: x != "")
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), count(x).cast("long").alias("line_words")))


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit("\x00null"))


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def removed_lines(docs: DataFrame, scratch: Scratch, *, text: str, host: str, least: int) -> DataFrame:
    """For each text of a host with lines above the limit: host, th, lost (words in them), gone (their hashes), in_texts.

    A line is above the limit when more than ``least`` distinct texts of its host hold it,
    however many texts the host has. Lines are taken from the texts once and stored; a row
    without line counts a text's copies, among which its words are shared out.
    """
    lines = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("line_words"))), normal_lines(F.coalesce(F.col(text), F.lit(""))))
    each = docs.select(_host(host).alias("host"), _text_hash(text).alias("th"), F.explode(lines).alias("x")).groupBy("host", "th", "x.line").agg(F.sum("x.line_words").alias("line_words"), F.count("*").alias("n"))
    each = scratch.save(each, "lines")
    held = each.where("line is not null")
    above = scratch.save(held.groupBy("host", "line").agg(F.count("*").alias("in_texts")).where(F.col("in_texts") > least), "above")
    gone = held.join(above, ["host", "line"]).groupBy("host", "th").agg(F.sum("line_words").alias("words"), F.collect_set("line").alias("gone"), F.max("in_texts").alias("in_texts"))
    copies = each.where("line is null").select("host", "th", F.col("n").alias("copies"))
    found = gone.join(copies, ["host", "th"]).select("host", "th", F.round(F.col("words") / F.col("copies")).cast("long").alias("lost"), "gone", "in_texts")
    return scratch.save(found, "removed")


def _base(text: str) -> dict[str, Column]:
    body, tokens = F.coalesce(F.col(text), F.lit("")), words(F.col(text))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": n_dup_lines(body),
        "n_repeat_words": n_repeat_words(tokens),
    }


def score(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    least: int = 20,
    min_left: float = 0.3,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words, max_line_texts, base_failed and kept.

    Columns of ``docs`` with these names are replaced, unless one is ``text`` or ``host``. A document is
    depleted, and not kept, when less than ``min_left`` of its words stand outside removed lines.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    removed = removed_lines(docs, scratch, text=text, host=host, least=least)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "max_line_texts", "base_failed", "kept"]
    docs = docs.drop(*[c for c in made if c in docs.columns and c not in (text, host)])
    own_host, own_th, lost, in_texts = free_names(docs, "host", "th", "lost", "in_texts")
    removed = removed.select(F.col("host").alias(own_host), F.col("th").alias(own_th), F.col("lost").alias(lost), F.col("in_texts").alias(in_texts))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    base = docs.select("*", _host(host).alias(own_host), _text_hash(text).alias(own_th), *[c.alias(n) for n, c in _base(text).items()])
    return (
        base.join(removed, [own_host, own_th], "left")
        .withColumn("n_removed_words", F.coalesce(lost, F.lit(0).cast("long")))
        .withColumn("max_line_texts", F.col(in_texts))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))
        .drop(own_host, own_th, lost, in_texts)
    )


def clean(docs: DataFrame, *, text: str = "text", host: str = "source", least: int = 20, min_left: float = 0.3, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The documents that ``score`` keeps, without the lines above the limits; columns as in ``docs``.

    Texts without such a line stay as they are; ``n_chars`` follows a changed text. Verdicts are made
    without carrying texts along; one join brings them to the documents.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    removed = removed_lines(docs, scratch, text=text, host=host, least=least)
    base = _base(text)
    slim = docs.select(_host(host).alias("host"), _text_hash(text).alias("th"), base["n_words"].alias("n_words"), base["n_repeat_words"].alias("n_repeat_words"))
    passed = slim.where(~((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))).select("host", "th", "n_words").distinct()
    kept = passed.join(removed, ["host", "th"], "left").where(F.col("n_words") - F.coalesce("lost", F.lit(0)) >= min_left * F.col("n_words"))
    own_host, own_th, gone = free_names(docs, "host", "th", "gone")
    kept = scratch.save(kept.select(F.col("host").alias(own_host), F.col("th").alias(own_th), F.col("gone").alias(gone)), "kept")
    tidy = lambda x: F.btrim(F.regexp_replace(F.lower(x), r"[ \t\x0B\f\r]+", " "), F.lit(" "))
    stay = lambda x: (tidy(x) == "") | ~F.array_contains(F.col(gone), F.xxhash64(tidy(x)))
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"), stay), "\n")
    out = docs.withColumns({own_host: _host(host), own_th: _text_hash(text)}).join(kept, [own_host, own_th])
    out = out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)
