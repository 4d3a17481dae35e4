"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, language_id, minmax_dedup, page_diff, pfair_mix, secret_scan, spaced_seed, sstable, substring_dedup, token_counts
from plumbline.session import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizers keep a vocabulary file; PLUMBLINE_TOKENIZERS names another folder."""
    if folder := os.environ.get("PLUMBLINE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, share=85).drop("text_hash")


def op5_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sstable.token_shards(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(), limit=1024)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), "all")


def op9_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seed.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_nearest_url_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


#: Target weights of the sources of the synthetic corpus.
TARGETS = {f"src{k}": 1.0 + k % 4 for k in range(20)}


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix(table(spark, sf_dir, "documents"), TARGETS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minmax_near_dedup": op2_minmax_near_dedup,
    "op3_hierarchical_language_id": op3_hierarchical_language_id,
    "op4_sstable_tokens": op4_sstable_tokens,
    "op5_bloom_exact_dedup": op5_bloom_exact_dedup,
    "op6_trigram_secret_scan": op6_trigram_secret_scan,
    "op7_nearest_url_page_diff": op7_nearest_url_page_diff,
    "op8_prefix_token_counts": op8_prefix_token_counts,
    "op9_spaced_seed_decontamination": op9_spaced_seed_decontamination,
    "op10_pfair_mix": op10_pfair_mix,
}

ORACLES: dict[str, str] = {
    "op2_minmax_near_dedup": minmax_dedup.SQL,
    "op5_bloom_exact_dedup": exact_dedup.SQL,
    "op6_trigram_secret_scan": secret_scan.sql(),
}
