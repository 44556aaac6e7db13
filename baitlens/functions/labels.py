"""The three label vocabularies: ingest, training and cross-validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from . import fixed_values as fv
from .regex import SPACE


def _normal(col: Column) -> Column:
    return F.lower(F.regexp_replace(col.cast("string"), rf"^[{SPACE}]+|[{SPACE}]+\z", ""))


def ingest_label(col: Column) -> Column:
    """Direct table, then the positive pattern, then the negative one; otherwise null."""
    word = _normal(col)
    positive = [k for k, v in fv.INGEST_LABELS.items() if v == 1]
    negative = [k for k, v in fv.INGEST_LABELS.items() if v == 0]
    return (
        F.when(word.isin(positive), 1).when(word.isin(negative), 0)
        .when(word.rlike(fv.INGEST_POSITIVE_PATTERN), 1)
        .when(word.rlike(fv.INGEST_NEGATIVE_PATTERN), 0)
    )


def training_label(df: DataFrame, column: str) -> Column:
    """Numbers: positive means 1. Words: two fixed sets, anything unknown is 0."""
    kind = df.schema[column].dataType
    if isinstance(kind, BooleanType):
        return F.coalesce(F.col(column).cast("int"), F.lit(0))
    if isinstance(kind, NumericType):
        return F.coalesce((F.col(column) > 0).cast("int"), F.lit(0))
    return F.when(_normal(F.col(column)).isin(fv.TRAINING_POSITIVE), 1).otherwise(0)


def unknown_training_labels(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Report of the first distinct label words the training vocabulary does not know."""
    word = _normal(F.col(column))
    known = fv.TRAINING_POSITIVE + fv.TRAINING_NEGATIVE
    return (
        df.select(word.alias("unknown_label")).where(~F.col("unknown_label").isin(known))
        .distinct().orderBy("unknown_label").limit(limit)
    )


def cv_label(col: Column) -> Column:
    """Cross-validation words; null where unknown."""
    word = _normal(col)
    return F.when(word.isin(fv.CV_POSITIVE), 1).when(word.isin(fv.CV_NEGATIVE), 0)


def cv_binary(df: DataFrame, column: str, output: str = "y", report_limit: int = 20) -> DataFrame:
    """Map by words; if any row is unknown read all rows as numbers, and fail if that is impossible too."""
    word = _normal(F.col(column))
    mapped = cv_label(F.col(column))
    number = F.try_cast(word, "double") if hasattr(F, "try_cast") else word.try_cast("double")
    check = df.agg(
        F.count_if(mapped.isNull()).alias("unmapped"),
        F.count_if(number.isNull() | F.isnan(number)).alias("not_numeric"),
    ).first()
    if check["unmapped"] == 0:
        return df.withColumn(output, mapped)
    if check["not_numeric"] == 0:
        return df.withColumn(output, number.cast("int"))
    rows = (
        df.where(mapped.isNull()).select(word.alias("w")).distinct().orderBy("w").limit(report_limit).collect()
    )
    raise ValueError(f"label column not convertible to 0/1; unmapped values: {[r['w'] for r in rows]}")


def corpus_label(col: Column) -> Column:
    """The two words of the header-less message corpus."""
    return F.when(col == "ham", 0).when(col == "spam", 1)


def pick_label_column(columns: list[str]) -> str:
    for name in fv.CV_LABEL_COLUMNS:
        if name in columns:
            return name
    raise ValueError("no label column found")
