"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_join, html_consensus, language_id, ngram_join, packing, pii, quality, sentencepiece_bpe, sharding, token_counts
from .common import read


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": _over("documents", language_id.identify),
    "op2_quality_divergence": _over("documents", quality.judge),
    "op3_pii_skip_chain": _over("documents", pii.redact),
    "op4_ngram_jaccard_join": _over("documents", ngram_join.ngram_jaccard_join),
    "op5_html_consensus": _over("pages", html_consensus.extract),
    "op6_sharding_table": _over("documents", sharding.assign),
    "op7_packing_balanced": _over("documents", packing.pack),
    "op8_sentencepiece_bpe": _over("documents", sentencepiece_bpe.encode_documents),
    "op9_embedding_grid_join": _over("embeddings", embedding_join.near_duplicates),
    "op10_token_counts": _over("documents", token_counts.count_tokens),
}

ORACLE: dict[str, str] = {
    "op2_quality_divergence": quality.ORACLE,
    "op4_ngram_jaccard_join": ngram_join.ORACLE,
    "op6_sharding_table": sharding.oracle(),
    "op9_embedding_grid_join": embedding_join.ORACLE,
}
