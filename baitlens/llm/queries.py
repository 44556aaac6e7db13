"""The numbered queries of this package and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import (
    byte_bpe,
    embedding_whitening,
    grid_order_join,
    line_templates,
    merkle_manifest,
    metric_tree_search,
    quality_rules,
    repeated_windows,
    source_mix,
    suffix_tree_lm,
    url_filter,
    warc_archive,
    weighted_minhash,
)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_host_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf, "documents"), carry=["doc_id"])


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as vocabularies

    return byte_bpe.token_digests(read_table(spark, sf, "documents"), vocabularies.path(VOCABULARY), vocabularies.PATTERN)


def op3_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return source_mix.mix_report(read_table(spark, sf, "documents"))


def op4_grid_order_join(spark: SparkSession, sf: str) -> DataFrame:
    return grid_order_join.near_duplicate_vectors(read_table(spark, sf, "embeddings"))


def op5_suffix_tree_lm(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_tree_lm.score_documents(read_table(spark, sf, "documents"))


def op6_weighted_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_minhash.class_report(read_table(spark, sf, "documents"))


def op7_repeated_windows(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_windows.removal_report(read_table(spark, sf, "documents"))


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(read_table(spark, sf, "pages"))


def op9_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    return line_templates.line_report(read_table(spark, sf, "documents"))


def op10_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    return warc_archive.archive_report(read_table(spark, sf, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_manifest.tampered_report(read_table(spark, sf, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_whitening.whiten(read_table(spark, sf, "embeddings"))


def op13_metric_tree_search(spark: SparkSession, sf: str) -> DataFrame:
    return metric_tree_search.top_k(read_table(spark, sf, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_host_quality_rules, op2_byte_bpe, op3_pareto_mix, op4_grid_order_join, op5_suffix_tree_lm, op6_weighted_minhash,
    op7_repeated_windows, op8_url_filter, op9_line_templates, op10_warc_archive, op11_merkle_manifest, op12_embedding_whitening,
    op13_metric_tree_search)}
ORACLES = {"op1_host_quality_rules": quality_rules.ORACLE, "op3_pareto_mix": source_mix.ORACLE,
           "op10_warc_archive": warc_archive.ORACLE, "op11_merkle_manifest": merkle_manifest.ORACLE,
           "op13_metric_tree_search": metric_tree_search.ORACLE}
