"""A corpus from documents in five stages; each stage's rows are written as Parquet and read again for the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. Nulls, empty and long texts,
repeated rows and empty tables are treated as the operators say; columns other than ``doc_id text source n_chars`` pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitlens.llm import byte_bpe, line_templates, quality_rules, queries, source_mix, weighted_minhash
from baitlens.session import materialise, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a rule nor their host's verdict refuses."""
    return quality_rules.kept_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; ``n_chars``, where there is one, counts what is left."""
    cleaned = line_templates.drop_recurring_lines(docs).select(*[F.col(f"`{c}`") for c in [*docs.columns]])
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return weighted_minhash.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    import public_tokenizers as vocabularies

    return byte_bpe.token_digests(docs, vocabularies.path(queries.VOCABULARY), vocabularies.PATTERN)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("source_mix", mix_stage), ("byte_bpe", encode_stage)]

#: Templates, draws and merges cannot be written in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
