"""Quality rules with host verdicts.

Every document is counted once (words, symbols, repeated lines, repeated runs of words). The share of each host's
documents that fail a rule is shrunk towards all hosts by a beta prior whose two parameters are fitted to the hosts'
rates, so a host of two documents is not judged by them alone. A host whose shrunk rate passes a limit in any rule is
refused; that verdict is joined back to its documents.

Defined results: a null text has no words and fails the base rules; null hosts are one host of their own; a text of any
length is counted whole; repeated rows are judged alike and all returned; an empty table gives an empty result; other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import broadcast_if_small, materialise
from .common import bounded_batches, bytes_of, fresh, mix, same, sealed, sums, windows, word_hashes, word_spans

#: Fixed values of the base rules, and the limits of the two rules that only count towards a host.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
MAX_SYMBOL_PERCENT, MAX_DUP_LINES = 50, 10
MAX_HOST_RATE = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["base", "symbols", "lines"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def count_texts(texts) -> list[np.ndarray]:
    """The columns of :data:`COUNTS` for an Arrow column of texts."""
    data, offsets = bytes_of(texts)
    starts, ends, before = word_spans(data, offsets)
    words = np.diff(before)
    code_points = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    chars = sums(code_points & (np.cumsum(inside[:-1], dtype=np.int8) > 0), offsets)
    hashes, after = windows(word_hashes(data, starts, ends), before, 3)
    runs = np.diff(after)
    # a run of a text of one or two words is no window of three
    keys = mix(hashes ^ mix(np.repeat(np.arange(len(words)), runs)))
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.arange(len(keys)) + np.repeat(before[:-1] - after[:-1], runs)
    covered = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    raw = data.tobytes()
    lines = [_repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [words, chars, sums(_SYMBOL[data], offsets), np.array(lines, np.int64), sums(covered[:-3], before)]


def with_counts(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """The frame with the five counts under the given names."""
    bounded_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(x, pa.int64()) for x in count_texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Alpha and beta of each rule's prior, by the method of moments over ``n`` and ``f_<rule>`` of the hosts.

    The variance of the rates less what drawing documents adds to it gives the prior's weight in documents; it lies
    between 1 and the number of all documents.
    """
    total = F.sum("n").cast("double")
    means = hosts.agg(total.alias("n"), F.count("*").alias("hosts"),
                      *[(F.sum(f"f_{r}") / total).alias(r) for r in RULES]).first()
    if not means["n"]:
        return {r: (0.5, 0.5) for r in RULES}
    rate = {r: F.col(f"f_{r}") / F.col("n") - F.lit(means[r]) for r in RULES}
    spread = hosts.agg(*[(F.sum(F.col("n") * rate[r] * rate[r]) / F.lit(means["n"])).alias(r) for r in RULES]).first()
    priors = {}
    for r in RULES:
        drawn = means[r] * (1 - means[r])
        between = spread[r] - drawn * means["hosts"] / means["n"]
        weight = min(max(drawn / between - 1, 1.0), means["n"]) if between > 0 else means["n"]
        priors[r] = (means[r] * weight, (1 - means[r]) * weight)
    return priors


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE,
          carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default), then the counts, ``base_failed``, ``host_failed`` and ``kept``.

    Names that the frame already has get an underscore appended. The counted rows are written once to the shared folder.
    """
    carried = docs.columns if carry is None else carry
    frame, inner = sealed(docs, [*dict.fromkeys([*carried, text, host])])
    own = docs.select(*[F.col(f"`{c}`") for c in carried])
    counted = with_counts(frame, inner[text], COUNTS).select(
        *[inner[c] for c in carried], F.col(inner[host]).alias("host"), *COUNTS)
    counted = materialise(counted, "quality")
    words = F.col("n_words")
    fails = {
        "base": base_failed(words, F.col("n_repeat_words")),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * words,
        "lines": F.col("n_dup_lines") > MAX_DUP_LINES,
    }
    hosts = materialise(counted.groupBy(F.col("host").alias("h")).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"f_{r}") for r, c in fails.items()]), "quality-hosts")
    refused = F.lit(False)
    for r, (alpha, beta) in beta_priors(hosts).items():
        refused |= (F.col(f"f_{r}") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)) > max_host_rate
    bad = broadcast_if_small(hosts.where(refused).select("h", F.lit(True).alias("refused")))
    host_failed = F.coalesce(F.col("refused"), F.lit(False))
    made = {**{c: F.col(c) for c in COUNTS}, "base_failed": fails["base"], "host_failed": host_failed,
            "kept": ~fails["base"] & ~host_failed}
    return counted.join(bad, same(F.col("host"), F.col("h")), "left").select(
        *[F.col(inner[c]).alias(c) for c in carried], *[c.alias(fresh(own, n)) for n, c in made.items()])


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that no rule and no host verdict refuses, with their own columns."""
    judged = judge(docs, text, host)
    return judged.where(F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_CORE = f"""
quality_words AS (
  SELECT row_number() OVER () AS row, *, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {{docs}}),
quality_windows AS (
  SELECT row, unnest(range(1, len(words) - 1)) AS i,
         unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS w
  FROM quality_words),
quality_repeats AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT row, i, count(*) OVER (PARTITION BY row, w) AS n FROM quality_windows), unnest([0, 1, 2]) AS t(k)
  WHERE n > 1 GROUP BY row),
quality_counts AS (
  SELECT q.*, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM quality_words q LEFT JOIN quality_repeats USING (row)),
quality_failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
         100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words AS symbols_failed, n_dup_lines > {MAX_DUP_LINES} AS lines_failed
  FROM quality_counts),
quality_hosts AS (
  SELECT source, count(*) AS n, unnest(['base', 'symbols', 'lines']) AS rule,
         unnest([count(*) FILTER (WHERE base_failed), count(*) FILTER (WHERE symbols_failed),
                 count(*) FILTER (WHERE lines_failed)]) AS f
  FROM quality_failed GROUP BY source),
quality_means AS (
  SELECT rule, CAST(sum(n) AS DOUBLE) AS total, count(*) AS hosts, sum(f) / CAST(sum(n) AS DOUBLE) AS mean
  FROM quality_hosts GROUP BY rule),
quality_between AS (
  SELECT rule, total, mean, mean * (1 - mean) AS drawn,
         sum(n * (f / n - mean) * (f / n - mean)) / total - mean * (1 - mean) * hosts / total AS between_hosts
  FROM quality_hosts JOIN quality_means USING (rule) GROUP BY rule, total, mean, hosts),
quality_priors AS (
  SELECT rule, mean, CASE WHEN between_hosts > 0 THEN least(greatest(drawn / between_hosts - 1, 1), total) ELSE total END AS weight
  FROM quality_between),
quality_refused AS (
  SELECT source, bool_or((f + mean * weight) / (n + weight) > {MAX_HOST_RATE}) AS refused
  FROM quality_hosts JOIN quality_priors USING (rule) GROUP BY source),
quality_judged AS (
  SELECT f.*, refused AS host_failed, NOT base_failed AND NOT refused AS kept
  FROM quality_failed f JOIN quality_refused r ON f.source IS NOT DISTINCT FROM r.source)"""

ORACLE = "WITH " + ORACLE_CORE.format(docs="documents") + f"""
SELECT doc_id, {', '.join(COUNTS)}, base_failed, host_failed, kept FROM quality_judged"""
