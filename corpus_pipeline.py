"""A corpus in five stages: language ID, exact dedup, near-duplicate join, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the
columns of ``docs``, whatever else there is beside doc_id, text, lang and source, under any names; the last
one returns doc_id, n_tokens, ids_sha256 and decoded_sha256. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogflow.llm import bpe, exact_dedup, language, mixing, ngram_join
from catalogflow.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or close to no language's profile, go. Profiles
    are learned from the rows with a lang outside the held-out fold; without any, all documents go. Repeated
    rows stay or go together; long texts are judged whole."""
    return language.accept(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, after white space runs became one blank, the row with the smallest doc_id stays (a
    null text equals the empty one, a null id is the largest; of repeated rows the first by a hash of the row)."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays; texts without words are in no
    class, and rows of a null doc_id stay."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; a null source is a source, a null doc_id draws
    by its text."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text (null as empty), and what they decode to; copies give equal rows."""
    return bpe.encode_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mixing", mixed), ("bpe", encoded)]

#: SQL expresses neither the language profiles nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
