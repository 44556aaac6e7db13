"""Text scalars as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .regex import DIGIT, SPACE, WORD, unicode_pattern

CHARSETS = {
    "arabic": "\u0600-\u06ff",
    "latin": "A-Za-z",
    "digits": DIGIT,
    "punct": rf"^{WORD}{SPACE}",
}


def text(col) -> Column:
    """Missing text is empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def count_class(col: Column, characters: str) -> Column:
    """How many characters belong to a class: whole runs are cut out, not single characters."""
    return F.length(col) - F.length(F.regexp_replace(col, f"[{characters}]+", ""))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def count_char(col: Column, ch: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def contained(col: Column, words: list[str]) -> Column:
    """How many of the words occur at least once."""
    return reduce(add, [F.contains(col, F.lit(w)).cast("int") for w in words])


def characters(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def distinct_characters(col: Column) -> Column:
    return F.size(F.array_distinct(characters(col)))


def entropy(col: Column, epsilon: float = 0.0) -> Column:
    """Shannon entropy over characters in bits; ``epsilon`` is added inside the logarithm."""
    # sorted characters: every run is one distinct character with its count
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(col, "")), ""), F.lit(r"(?s)(.)\1*+"), F.lit(0))
    # bound once per row: a lambda evaluates what it takes from outside for every element
    bound = F.array(F.struct(F.transform(runs, F.length).alias("runs"), F.length(col).cast("double").alias("size")))

    def of(b: Column) -> Column:
        def add(acc: Column, run: Column) -> Column:
            return acc - run / b["size"] * F.log2(run / b["size"] + F.lit(epsilon))

        return F.aggregate(b["runs"], F.lit(0.0), add)

    return F.when(F.length(col) > 0, F.element_at(F.transform(bound, of), 1)).otherwise(F.lit(0.0))


def longest_run(col: Column) -> Column:
    repeated = F.regexp_extract_all(col, F.lit(r"(?s)(.)\1++"), F.lit(0))
    longest = F.array_max(F.transform(repeated, F.length))
    return F.coalesce(longest, F.least(F.length(col), F.lit(1)))


def charset_ratio(col: Column, charset: str) -> Column:
    if charset not in CHARSETS:
        return F.lit(0.0)
    return count_class(col, CHARSETS[charset]) / F.greatest(F.length(col), F.lit(1))


def word_count(col: Column) -> Column:
    return count_matches(col, rf"[{WORD}]+")


def collapse_spaces(col: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, rf"[{SPACE}]+", " "))


def urgency_score(col: Column) -> Column:
    hits = contained(F.lower(col), fv.URGENCY_TERMS)
    return F.least(hits / F.lit(float(len(fv.URGENCY_TERMS))), F.lit(1.0))


def grammar_errors(col: Column) -> Column:
    hits = (
        count_matches(col, unicode_pattern(r"\s{2,}"))
        + count_matches(col, r"[.!?]{2,}")
        + count_matches(col, unicode_pattern(r"\b[A-Z]{3,}\b"))
    )
    return F.least(hits, F.lit(10))


def personalization_score(col: Column) -> Column:
    lowered = F.lower(col)
    hits = reduce(add, [lowered.rlike(unicode_pattern(p)).cast("int") for p in fv.PERSONALIZATION_PATTERNS])
    return F.least(hits / F.lit(float(len(fv.PERSONALIZATION_PATTERNS))), F.lit(1.0))


def text_signals(df: DataFrame, body: str | None = None) -> DataFrame:
    """Urgency, grammar, personalisation and length signals of the message text (``body`` wins over ``text``)."""
    source = body or next((c for c in ("body", "text") if c in df.columns), None)
    if source is None:
        return df
    t = text(source)
    return df.withColumns({
        "urgency_score": urgency_score(t),
        "grammar_errors": grammar_errors(t),
        "personalization_score": personalization_score(t),
        "char_count": F.length(t),
    })


def fingerprint(col: Column, chars: int | None = None) -> Column:
    """md5 of lowered, whitespace-collapsed text; ``chars`` hashes only so many first characters."""
    normal = collapse_spaces(F.lower(col))
    return F.md5(normal if chars is None else F.substring(normal, 1, chars))


def group_key(modality: Column, domain: Column, message: Column | None = None) -> Column:
    """``modality:domain``; without a domain one shared bucket, or one bucket per message where it is given."""
    kind = F.lower(F.coalesce(modality, F.lit("url")))
    known = F.nullif(domain, F.lit(""))
    alone = F.lit("no-domain") if message is None else F.concat(F.lit("nodom:"), fingerprint(message))
    return F.concat(kind, F.lit(":"), F.coalesce(known, alone))


def preview(col: Column, chars: int = 100) -> Column:
    """Display column: the first characters and an ellipsis where text was longer."""
    return F.concat(F.substring(col, 1, chars), F.when(F.length(col) > chars, "...").otherwise(""))


def sender_domain(col: Column) -> Column:
    """Lower-cased part after the first ``@``; anything else is ``unknown``."""
    trimmed = F.trim(F.coalesce(col, F.lit("unknown")))
    at = F.instr(trimmed, "@")
    part = F.lower(F.substring(trimmed, at + 1, F.length(trimmed)))
    return F.when((at > 0) & (F.length(part) > 0), part).otherwise(F.lit("unknown"))


def temporal_features(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Hour, Monday-based weekday and the two calendar flags; an unreadable time gives null and 0."""
    ts = F.col(column)
    if dict(df.dtypes)[column] == "string":
        ts = F.try_to_timestamp(ts)
    return df.withColumn(column, ts).withColumns({
        "hour": F.hour(column),
        "day_of_week": F.weekday(column),
        "is_weekend": flag(F.weekday(column) >= 5),
        "is_business_hours": flag(F.hour(column).between(9, 17)),
    })
