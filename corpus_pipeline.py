"""Corpus preparation as one chain of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but
the last return the columns of ``documents``, and any others that ``docs`` has, under any names.  An empty
table goes through every stage and gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmafold.llm import exact_dedup, language_id, mixing, near_duplicates, packing
from sigmafold.runtime import materialise

#: Passes over the source that is seen most; every document is used at least once.
MAX_REPEATS = 1.25
#: Distinct pieces of text that a worker remembers while packing: fewer than alone, as workers of all stages stay alive.
REMEMBERED = 250_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts and those without a letter go; every other row stays, repeated ones too.  Rows
    without ``lang`` teach nothing but are judged; without any label no language can be told and all go.
    """
    model = language_id.train(docs)
    lang, score = language_id.free_name(docs, "__lang"), language_id.free_name(docs, "__score")
    judged = language_id.identify(docs, model, _columns(docs), (lang, score))
    return judged.where(F.col(lang) != language_id.UNDETERMINED).select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id.

    Null and empty texts are one group; of rows that repeat whole one stays; a row without doc_id stays
    only where its group has no other.
    """
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the largest doc_id.

    Texts without words are near nothing and stay; rows that repeat a doc_id are told apart by their
    place, and a row without doc_id stays only where its class has no other.
    """
    return near_duplicates.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document once, documents of small sources again.

    Null sources are one source, null texts cost one token, repeated rows are placed one by one.
    """
    return mixing.mix_rows(docs, mixing.Target(max_repeats=MAX_REPEATS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; a null text is its end alone, every row is packed, repeated ones too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [("language", language), ("exact_dedup", exact), ("near_duplicates", near), ("mixing", mixture), ("packing", packed)]
#: Language models, tokenizers and packing have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
