"""URL filter: path rules, and a naive Bayes verdict on segmented host and path tokens for the rest.

The longest rule that fits a URL decides. URLs that a rule decides are the labelled rows of the classifier. Concatenated
host names are cut into words by a unigram Viterbi search over all words of the given texts, however rare: the substrings of
each distinct part of a host are joined with the word counts, so that a part is cut with the few words that occur in it.
Neighbouring letters that no word covers are one unknown word. Tokens of host and path are hashed into :data:`BUCKETS`
counters for multinomial naive Bayes with add-one smoothing over the buckets in use; these are all that reaches the driver.

Defined results: a null URL or one without ``://`` has empty host and path and the classifier's verdict on no tokens, its
prior; equal scores, and no labelled row at all, give ``allow``; hosts and paths of any length are read whole; repeated
rows are counted and returned; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..session import materialise
from .common import bounded_batches, by_shuffle

#: The rules as (verdict, host followed by the path's beginning).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Share of all words that a word of :func:`unigrams` has at least.
MIN_SHARE = 1e-5
BUCKETS = 1 << 18
#: Longer words are looked for by their opening of this length, shorter ones as they are.
OPENING = 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or one above it and whose path begins the URL's; and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """``w n``: the words (runs of letters, lower case, no mark-up) and their counts."""
    plain = F.lower(F.regexp_replace(F.col(f"`{column}`"), "(?s)<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("w")).where("w <> ''")
    return materialise(words.groupBy("w").agg(F.count("*").alias("n")), "url-words")


def unigrams(texts: DataFrame, column: str, min_share: float = MIN_SHARE) -> dict[str, int]:
    """Counts of the words that make up at least ``min_share`` of all, for :func:`token_buckets`."""
    counts = word_counts(texts, column)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return {r["w"]: r["n"] for r in counts.where(F.col("n") >= min_share * total).collect()}


@dataclass(frozen=True)
class Segmenter:
    """Viterbi over unigram log probabilities; unknown words cost more the longer they are.

    ``total`` counts all words, where ``counts`` has a part of them only.
    """

    counts: dict[str, int]
    total: int | None = None

    def __post_init__(self):
        total = (sum(self.counts.values()) if self.total is None else self.total) or 1
        object.__setattr__(self, "score", {w: math.log10(n / total) for w, n in self.counts.items()})
        object.__setattr__(self, "longest", max(map(len, self.counts), default=1))
        object.__setattr__(self, "unknown", -math.log10(total) - 1)

    def __call__(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            found = best[end - 1] + self.score.get(name[end - 1], self.unknown), -1
            for start in range(max(0, end - self.longest), end - 1):
                word = name[start:end]
                if word in self.score:
                    found = max(found, (best[start] + self.score[word], start - end))
            best.append(found[0])
            back.append(end + found[1])
        words, end = [], len(name)
        while end:
            words.append(name[back[end]:end])
            end = back[end]
        return self.joined(words[::-1])

    def joined(self, words: list[str]) -> list[str]:
        """Neighbouring unknown letters, or digits, as one word, which costs the same."""
        out, open_kind = [], None
        for word in words:
            kind = None if word in self.score else word.isdigit()
            if kind is not None and all(x.isdigit() == kind for x in word) and kind == open_kind:
                out[-1] += word
            else:
                out.append(word)
            open_kind = kind
        return out


_NUMBER, _PART = re.compile(r"[0-9]+"), re.compile(r"[^\W_]+")


def tokens(host: str, path: str, segment) -> list[str]:
    """Words of the host's labels with ``h:``, words of the path with ``p:``; numbers by their first digit and length."""
    return marked([word for part in _PART.findall(host) for word in segment(part)], path)


def marked(words: Sequence[str], path: str) -> list[str]:
    """The tokens of a host's words and of a path."""
    found = ["h:" + w for w in words] + ["p:" + part.lower() for part in _PART.findall(path)]
    return [_NUMBER.sub(lambda m: m[0][0] + "0" * (len(m[0]) - 1), token) for token in found]


def bucket(token: str) -> int:
    value = 14695981039346656037
    for byte in token.encode():
        value = (value ^ byte) * 1099511628211 % (1 << 64)
    return (value ^ value >> 32) % BUCKETS


class UrlTokens:
    """Buckets of a URL's tokens; hosts repeat, so their segmentation is remembered while memory allows."""

    def __init__(self, counts: dict[str, int]):
        self.segment = lru_cache(maxsize=50_000)(Segmenter(counts))
        self.bucket = lru_cache(maxsize=200_000)(bucket)

    def __call__(self, host: str, path: str) -> list[int]:
        return [self.bucket(t) for t in tokens(host, path, self.segment)]


def token_buckets(host: Column, path: Column, counts) -> Column:
    """``array<int>``; ``counts`` is a broadcast of the unigrams."""

    @pandas_udf(ArrayType(IntegerType()))
    def run(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        made = _url_tokens(counts)
        return pd.Series([np.array(made(h, p), np.int32) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    return run(host, path)


_MADE: list = []


def _url_tokens(counts) -> UrlTokens:
    """The tokeniser of this worker, made once per broadcast."""
    if not _MADE or _MADE[0] is not counts.value:
        _MADE[:] = [counts.value, UrlTokens(counts.value)]
    return _MADE[1]


@pandas_udf(ArrayType(StringType()))
def parts_of(hosts: pd.Series) -> pd.Series:
    return pd.Series([_PART.findall(h) for h in hosts], dtype=object)


@pandas_udf(ArrayType(StringType()))
def pieces_of(parts: pd.Series) -> pd.Series:
    """The distinct substrings of a part that can be words or the openings of words."""
    return pd.Series([list({p[i:j] for i in range(len(p)) for j in range(i + 1, min(len(p), i + OPENING) + 1)}) for p in parts], dtype=object)


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``h words`` of the distinct hosts (column ``host``) that have parts; ``counts`` is ``w n`` of all words."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0)

    @pandas_udf(ArrayType(StringType()))
    def cut(parts: pd.Series, words: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([Segmenter({} if w is None else dict(zip(w, n.tolist(), strict=True)), total)(p)
                          for p, w, n in zip(parts, words, numbers, strict=True)], dtype=object)

    placed = materialise(hosts.select("host", F.posexplode(parts_of("host")).alias("i", "part")), "url-host-parts")
    parts = materialise(placed.select("part").distinct(), "url-parts")
    pieces = parts.select("part", F.explode(pieces_of("part")).alias("piece"))
    # a longer word meets the parts that hold its opening, and stays where the part holds all of it
    opened = counts.withColumn("opening", F.substring("w", 1, OPENING))
    known = pieces.join(by_shuffle(opened), F.col("piece") == F.col("opening")).where(F.contains("part", "w")).groupBy(
        F.col("part").alias("p")).agg(F.collect_list(F.struct("w", "n")).alias("known"))
    found = parts.join(by_shuffle(known), F.col("part") == F.col("p"), "left").select(
        F.col("part").alias("p"), cut("part", F.col("known.w"), F.col("known.n")).alias("words"))
    found = materialise(found, "url-part-words")
    joined = placed.join(by_shuffle(found), F.col("part") == F.col("p")).groupBy(F.col("host").alias("h")).agg(
        F.array_sort(F.collect_list(F.struct("i", "words"))).alias("x"))
    return joined.select("h", F.flatten(F.col("x.words")).alias("words"))


@lru_cache(maxsize=200_000)
def remembered_bucket(token: str) -> int:
    return bucket(token)


@pandas_udf(ArrayType(IntegerType()))
def word_buckets(words: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([np.array([remembered_bucket(t) for t in marked([] if w is None else w, p)], np.int32)
                      for w, p in zip(words, paths, strict=True)], dtype=object)


def naive_bayes(labelled: DataFrame) -> tuple[float, np.ndarray]:
    """Log odds of ``block``: of the prior and of each bucket, from rows of ``verdict buckets``; add-one smoothing."""
    classes = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((2, BUCKETS))
    rows = labelled.select("verdict", F.explode("buckets").alias("b")).groupBy("verdict", "b").agg(F.count("*").alias("n"))
    for r in rows.toLocalIterator():
        counts[int(r["verdict"] == "block"), r["b"]] += r["n"]
    prior = math.log((classes.get("block", 0) + 1) / (classes.get("allow", 0) + 1))
    used = np.count_nonzero(counts.any(axis=0))
    logs = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + max(used, 1))
    return prior, logs[1] - logs[0]


def bayes_verdict(buckets: Column, model) -> Column:
    """``model`` is a broadcast of :func:`naive_bayes`."""

    @pandas_udf(StringType())
    def run(rows: pd.Series) -> pd.Series:
        prior, odds = model.value
        # a sum in a fixed order, so that equal token lists always get equal scores
        return pd.Series(["block" if prior + math.fsum(odds[np.asarray(x, np.int64)]) > 0 else "allow" for x in rows], dtype=object)

    return run(buckets)


def filter_urls(pages: DataFrame, url: str = "url", page_id: str = "page_id", words: str = "html",
                rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id host path rule verdict``; the unigrams come from the column ``words``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    context = spark.sparkContext
    parts = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"),
                         path_of(F.col(f"`{url}`")).alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = materialise(parts.select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict")), "url-rules")
    found = materialise(host_words(ruled.select("host").distinct(), word_counts(pages, words)), "url-host-words")
    judged = materialise(ruled.join(by_shuffle(found), F.col("host") == F.col("h"), "left").select(
        "page_id", "host", "path", "rule", "verdict", word_buckets("words", "path").alias("buckets")), "urls")
    model = context.broadcast(naive_bayes(judged.where("verdict IS NOT NULL")))
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("verdict", bayes_verdict(F.col("buckets"), model)).alias("verdict"))
