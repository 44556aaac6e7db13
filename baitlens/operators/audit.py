"""Audit of three splits: which urls, domains and texts they share, and how bad that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import audit_columns

SPLITS = ("train", "val", "test")
PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def _holds(name: str) -> Column:
    return F.max(F.col("split") == name).alias(f"in_{name}")


def fingerprints(df: DataFrame, split: str = "split") -> DataFrame:
    """One row per kind and fingerprint with the splits that hold it (one shuffle for all three kinds)."""
    cols = audit_columns(df)
    hashed = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.sha1(F.coalesce(F.col(c), F.lit("")).cast("binary")).alias("fp"))
        for kind, c in (("url", "url_canon"), ("domain", "domain"), ("text", "_text_joined"))
    ])
    return (
        cols.select(F.col(split).alias("split"), F.explode(hashed).alias("_f"))
        .groupBy(F.col("_f.kind").alias("kind"), F.col("_f.fp").alias("fp"))
        .agg(*[_holds(s) for s in SPLITS])
    )


def overlap_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """One row: distinct shared fingerprints for every pair of splits and kind."""
    fp = fingerprints(df, split)
    return fp.agg(*[
        F.count_if((F.col("kind") == kind) & F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"{kind}_{a}_{b}")
        for a, b in PAIRS for kind in ("url", "domain", "text")
    ])


def audit(df: DataFrame, split: str = "split") -> DataFrame:
    """One row per pair of splits with overlaps, severity, and the verdict code 0, 1 or 2 of the whole audit."""
    row = overlap_counts(df, split)
    any_overlap = F.lit(False)
    for a, b in PAIRS:
        for kind in ("url", "domain", "text"):
            any_overlap = any_overlap | (F.col(f"{kind}_{a}_{b}") > 0)
    critical = (F.col("domain_train_test") > 100) | (F.col("url_train_test") > 50)
    code = F.when(~any_overlap, 0).when(critical, 2).otherwise(1)
    pairs = F.array(*[
        F.struct(
            F.lit(f"{a}_{b}").alias("pair"),
            *[F.col(f"{kind}_{a}_{b}").alias(f"{kind}_overlap") for kind in ("url", "domain", "text")],
        )
        for a, b in PAIRS
    ])
    exploded = row.select(code.alias("audit_code"), F.explode(pairs).alias("_p")).select("_p.*", "audit_code")
    touched = (F.col("url_overlap") > 0) | (F.col("domain_overlap") > 0) | (F.col("text_overlap") > 0)
    severity = (
        F.when(~touched, "NONE").when(F.col("domain_overlap") > 50, "HIGH")
        .when(F.col("domain_overlap") > 10, "MEDIUM").otherwise("LOW")
    )
    return exploded.withColumn("severity", severity)


def shared_domains(df: DataFrame, first: str = "train", second: str = "test", split: str = "split",
                   label: str | None = None, top: int = 10) -> DataFrame:
    """The most frequent domains two splits share, with rows per split and distinct labels."""
    cols = audit_columns(df)
    aggregates = [
        F.count_if(F.col(split) == first).alias(f"n_{first}"),
        F.count_if(F.col(split) == second).alias(f"n_{second}"),
    ]
    if label:
        aggregates.append(F.count_distinct(F.when(F.col(split) == first, F.col(label))).alias("n_labels"))
    return (
        cols.groupBy(F.coalesce("domain", F.lit("")).alias("domain")).agg(*aggregates)
        .where((F.col(f"n_{first}") > 0) & (F.col(f"n_{second}") > 0))
        .withColumn("n_total", F.col(f"n_{first}") + F.col(f"n_{second}"))
        .orderBy(F.desc("n_total"), "domain").limit(top)
    )
