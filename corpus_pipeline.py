"""Corpus preparation: language ID, line dedup, near-duplicates, decontamination, encoding.

Each stage reads what its predecessor wrote and takes (spark, docs, sf_dir). All but the
last return the columns they were given, so a text that a stage changes is the next one's
text. `documents` is read whole; nulls, empty texts, repeated rows and further columns
pass as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairsift.llm import bpe, decontam, langid, lines, minhash
from pairsift.llm.common import held_out, stage_path
from pairsift.llm.queries import BPE_RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter, without a text, or no better
    predicted by any language than by none go."""
    model = langid.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return langid.keep_language(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that resemble an earlier line; n_chars follows."""
    clean = lines.deduplicate(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.decontaminate(docs, items)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to."""
    return bpe.digests(bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learnt models, components and merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = stage_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
