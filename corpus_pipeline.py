"""Documents to packed training sequences, as stages that each read what the one before wrote.

Stages but the last return the columns of documents. How each treats nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns is in the docstring of its operator's module; a table of documents may have any columns besides
doc_id, text and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracegraph.llm import language_id, ngram_join, packing, pii, quality
from tracegraph.llm.common import read, settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose character classes and common words don't diverge from those of their language."""
    return quality.keep_good(docs)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, fitted on these documents, is sure enough of."""
    return language_id.keep_identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kind."""
    return pii.mask_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: (seq_id, doc_id, piece, tokens, cost)."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good),
    ("language_id", identified),
    ("ngram_jaccard_join", without_near_copies),
    ("pii", masked),
    ("packing", packed),
]

#: The classifier's fit, belief propagation and greedy packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; what a stage keeps is settled before the next reads it, as it is read more than once."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
