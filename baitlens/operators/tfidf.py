"""TF-IDF in long form: one row per document and term, smooth idf, unit rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.regex import SPACE, WORD
from ..session import broadcast_if_small, materialise

NARROW_ROW_LIMIT = 1_000_000  # rows of a short term and two numbers
#: Bytes of text whose n-grams one task counts and weighs.
TASK_BYTES = 4 << 20


class _Plain(dict):
    """Code point to its compatibility decomposition without combining marks, made when first met."""

    def __missing__(self, code: int) -> str:
        # marks are dropped, so their canonical order doesn't matter and characters can be decomposed one by one
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        self[code] = plain
        return plain


_PLAIN = _Plain()
NOT_ASCII = r"[^\x00-\x7F]"


@pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t.translate(_PLAIN), na_action="ignore")


def strip_accents(col: Column) -> Column:
    """Compatibility-decompose and drop combining marks: every code point as the standard form has it.

    Only texts with a character beyond ASCII leave the JVM.
    """
    foreign = col.rlike(NOT_ASCII)
    return F.when(foreign, _decomposed(F.when(foreign, col))).otherwise(col)


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``: an expression inside a lambda runs per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(items: Column, low: int, high: int, join) -> Column:
    """All runs of ``low`` to ``high`` neighbouring items, joined."""
    def of_size(xs: Column, n: int) -> Column:
        runs = F.transform(
            F.sequence(F.lit(1), F.size(xs) - (n - 1)), lambda i: join([F.element_at(xs, i + k) for k in range(n)])
        )
        return F.when(F.size(xs) >= n, runs).otherwise(F.array().cast("array<string>"))

    return _bind(items, lambda xs: F.concat(*[of_size(xs, n) for n in range(low, high + 1)]))


def char_grams(col: Column, low: int, high: int) -> Column:
    """Character n-grams of the text, whitespace runs taken as one blank."""
    normal = F.regexp_replace(col, rf"[{SPACE}]{{2,}}", " ")

    def of_size(t: Column, n: int) -> Column:
        # look ahead n characters from every character on
        return F.regexp_extract_all(t, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))

    return _bind(normal, lambda t: F.concat(*[of_size(t, n) for n in range(low, high + 1)]))


def word_grams(col: Column, low: int, high: int) -> Column:
    """Word n-grams, words being runs of word characters."""
    words = F.regexp_extract_all(col, F.lit(rf"([{WORD}]+)"), F.lit(1))
    return _windows(words, low, high, lambda parts: F.concat_ws(" ", *parts))


def normal_text(col: Column, accents: bool = False) -> Column:
    lowered = F.lower(col)
    return strip_accents(lowered) if accents else lowered


def _tasks(df: DataFrame, column: str) -> int:
    size = df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, 1 + int(size) // TASK_BYTES)


def term_counts(df: DataFrame, doc: str, column: str, analyzer: str = "char", low: int = 3, high: int = 5,
                accents: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Rows ``doc term tf``. Texts are shuffled by their document, into as many tasks as they need; their n-grams are not."""
    grams = char_grams if analyzer == "char" else word_grams
    normal = df.select(doc, *(keep or []), normal_text(F.coalesce(F.col(column), F.lit("")), accents).alias("_t"))
    # behind the accents: a Python step hides how its rows are spread
    normal = normal.repartition(_tasks(df, column), doc)
    return (
        normal.select(doc, *(keep or []), F.explode(grams(F.col("_t"), low, high)).alias("term"))
        .groupBy(doc, *(keep or []), "term").agg(F.count("*").alias("tf"))
    )


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None, weight: str | None = None) -> DataFrame:
    """Rows ``term df idf`` of the fitted terms; ``weight`` counts a document several times."""
    copies = F.col(weight) if weight else F.lit(1)
    terms = (
        counts.groupBy("term").agg(F.sum(copies).alias("df"), F.sum(F.col("tf") * copies).alias("_total"))
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
    )
    if max_features is not None:
        terms = terms.orderBy(F.desc("_total"), "term").limit(max_features)
    idf = F.ln((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return terms.select("term", "df", idf.alias("idf"))


def weigh(counts: DataFrame, terms: DataFrame, doc: str) -> DataFrame:
    """Rows ``doc term tf df weight`` with unit length per document; terms outside the vocabulary drop out."""
    raw = counts.join(broadcast_if_small(terms, NARROW_ROW_LIMIT), "term").withColumn("_raw", F.col("tf") * F.col("idf"))
    # a document's terms are bounded by its length
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(doc)))
    return raw.select(*counts.columns, "df", (F.col("_raw") / norm).alias("weight"))


def fit_min_df(n_docs: int) -> int:
    return max(3, n_docs // 5000)


def tfidf(df: DataFrame, doc: str, column: str, analyzer: str = "char", low: int = 3, high: int = 5,
          min_df: int | None = None, max_df: float = 0.9, max_features: int | None = None,
          accents: bool = True, fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default: the frame itself) and weigh the frame."""
    fitted = df if fit_on is None else fit_on
    n_docs = fitted.count()
    counts = term_counts(df, doc, column, analyzer, low, high, accents)
    base = counts if fit_on is None else term_counts(fit_on, doc, column, analyzer, low, high, accents)
    terms = vocabulary(base, n_docs, fit_min_df(n_docs) if min_df is None else min_df, max_df, max_features)
    return weigh(counts, materialise(terms, "vocabulary"), doc)
