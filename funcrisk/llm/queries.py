"""The named queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from funcrisk.llm import exact, lexical, mixing, packing, pii, quality, scoring, simhash, sql, suffixes, tokens, trie, urls, warc
from funcrisk.llm.common import documents

VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_texts(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), mixing.Target(entropy=0.9))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OPERATORS = (
    op1_token_counts, op2_exact_dedup, op3_suffix_dedup, op4_personal_data, op5_lm_scores, op6_quality_rules,
    op7_source_mixing, op8_best_fit_packing, op9_simhash, op10_url_filters, op11_prefix_trie, op12_lexical_search,
    op13_warc,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
SQL: dict[str, str] = {"op2_exact_dedup": sql.OP2, "op6_quality_rules": sql.OP6, "op10_url_filters": sql.OP10, "op11_prefix_trie": sql.OP11, "op12_lexical_search": sql.OP12, "op13_warc": sql.OP13}
