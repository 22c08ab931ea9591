"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_format, decontamination, language_id, mixing, near_dedup, perplexity, quality_rules, tokens, url_filter, warc
from tessera.llm.common import load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"), spark)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(load(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(load(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


_ALL = (
    op1_decontamination, op2_perplexity, op3_minhash_near_dedup, op4_url_filters, op5_warc, op6_token_counts, op7_quality_rules, op8_chat_format, op9_language_id, op10_mixing,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {"op4_url_filters": url_filter.ORACLE, "op5_warc": warc.ORACLE, "op8_chat_format": chat_format.ORACLE}
