"""The queries of this folder: each applies one operator with its production parameters to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from diffsieve.llm import (
    decontaminate,
    embeddings,
    html_text,
    language_spans,
    line_chunks,
    minhash,
    secret_scan,
    sentence_pieces,
    token_alignment,
    token_counts,
    toxicity,
    url_filter,
    vector_codes,
)
from diffsieve.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_embedding_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), path)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.deduplicated(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment_digest(table(spark, sf_dir, "documents"), *paths)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.languages(table(spark, sf_dir, "documents"))


_ALL = (
    op1_html_text, op2_embedding_grid, op3_secret_scan, op4_minhash, op5_merge_dropout, op6_decontaminate, op7_url_filter,
    op8_token_counts, op9_toxicity, op10_line_chunks, op11_token_alignment, op12_vector_codes, op13_language_spans,
)
QUERIES: dict[str, Query] = {q.__name__: q for q in _ALL}
ORACLES: dict[str, str] = {"op12_vector_codes": vector_codes.oracle_sql()}
