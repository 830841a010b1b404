"""Queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlark.llm import bpe, covertree, jaccard, langid, maxent, merkle, mixing, pii, quality, sharding, tandem, tokenfiles, toxicity
from roadlark.llm.common import Scratch, documents, let, lower_ascii, words
from roadlark.llm.sql import ORACLE


def byte_bpe_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.join(documents(spark, sf_dir).select("doc_id", "text"))
    return joined.select("doc_id", "n_shingles", "component_id", "n_copies")


def op3_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", pii.spelled(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))


def op4_maxent_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir).select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    tokenfiles.write(documents(spark, sf_dir).select("doc_id", "text"), path, byte_bpe_file(), end=2)
    return tokenfiles.read(spark, path)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), byte_bpe_file())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*merkle.FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    proofs = merkle.prove(docs, changed={"text": tampered})
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")


def _repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth document with its words from one on repeating in a period; both follow from the id's checksum."""
    mark = F.crc32(doc_id.cast("string"))
    g = F.floor(mark / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(text)

    return F.when(mark % 10 == 0, let(words(text), repeat)).otherwise(text)


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", _repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.col("strongest")
    return tandem.runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")], F.floor(F.try_divide(1000 * best["length"], best["period"])).alias("exponent_milli"), F.sha2(tandem.spelled(F.col("runs")), 256).alias("runs_sha256"), "collapsed_sha256", "n_words"
    )


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict:
    """SQL twins of those queries that SQL can express; tests compare the others with brute force."""
    return dict(ORACLE)
