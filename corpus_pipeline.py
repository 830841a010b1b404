"""Corpus pipeline: quality rules, near-duplicate removal, sanitisation, mixing, encoding.

Every stage takes all that its predecessor kept and returns the columns of ``documents``, the
last one the encoded documents. An empty ``documents`` table gives an empty result.

A stage's result is written before the next stage reads it, so each stage deletes what the stages before it in
this run left in the shared folder, but for tables that its own input still reads.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadlark.llm import bpe, jaccard, mixing, pii, quality
from roadlark.llm.common import Scratch, documents, recorded
from roadlark.llm.queries import byte_bpe_file


_left: list[Scratch] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame], first: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``work``, after what the stages before it left is deleted; the first one begins a new run and deletes nothing."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = [] if first or not _left else docs.inputFiles()
        for scratch in [] if first else _left:
            if scratch.spark is spark and not any(scratch.root.removeprefix("file://") in file for file in read):
                scratch.drop()
        _left.clear()
        with recorded() as made:
            out = work(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject, and lines that too many of a host's documents share."""
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that 5-word shingles link at 75 %."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms that disclose it."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; documents taken twice come twice."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, is_lossless and ids (what a trainer reads) of each document of the mix."""
    return bpe.round_trip(docs, byte_bpe_file(), with_ids=True)


STAGES = [
    ("quality rules", _stage(quality_rules, first=True)),
    ("near duplicates", _stage(near_duplicates)),
    ("personal data", _stage(personal_data)),
    ("mixture", _stage(mixture)),
    ("encoding", _stage(encoding)),
]

#: SQL expresses neither the shingle join's components nor BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
