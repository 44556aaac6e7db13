"""Line dedup with a log-template tree.

Lines are the parts between line feeds. Tokens that hold a digit are variable fields. The tree has a fixed depth: a
leaf is a token count and the first :data:`DEPTH` tokens. A leaf that enough texts reach gets a profile, the most
frequent token of each place among its distinct lines; lines that agree with it in :data:`SIMILARITY` of the places behind
the leading tokens, and in two of them at least, are one template, in which the other places are variable fields. Where
that template recurs, the leaf's other lines get a profile of their own, and so on until a leaf has no further template. Any
other line, and each line of such a template too, is a template of its own (fields generalised; a line of fields only, as it is
written).

A template that at least ``min_texts`` different texts hold is dropped everywhere but in the text of the smallest id
that has it; so is a line of its own, and a long one (:data:`LONG` tokens, of which :data:`SIMILARITY` are no fields, or
which are all fields) from the second text on.

Whole copies of a text count as one text. Places are compared by two bytes of a hash; equality of leaves and of whole
lines is by 64 bits. Profiles come from distinct lines with their counts, so a line that many texts repeat is one row.

Defined results: a null text stays null, an empty one empty; a line without a word always stays; lines of any length count
whole; ties between the tokens of a place go to the larger code; repeated rows are treated alike; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from ..session import materialise
from .common import bounded_batches, by_shuffle, bytes_of, fresh, mix, sealed, word_hashes, word_spans

DEPTH, SIMILARITY, MIN_TEXTS, LONG = 4, 0.8, 10, 10
_FIELD = np.uint64(0x5851F42D4C957F2D)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def parse_lines(texts) -> tuple[np.ndarray, ...]:
    """Of every line with a word: row, line number, leaf, whole line, whether it is long, and codes.

    A line of fields only has no leaf (0). The codes are two bytes per token, 0 for a field; they come as one array with
    the offsets of the lines.
    """
    data, offsets = bytes_of(texts)
    starts, ends, _ = word_spans(data, offsets)
    raw = word_hashes(data, starts, ends)
    hashes = raw.copy()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    field = digits[ends] > digits[starts]
    hashes[field] = _FIELD
    codes = ((hashes >> np.uint64(48)) | np.uint64(1)).astype(">u2")
    codes[field] = 0
    breaks = np.flatnonzero(data == 10)
    # a line begins at a text's start or after a line feed; equal starts (empty texts) are kept apart by the row
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort([line_start, row])
    line_start, row = line_start[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    line_end = np.concatenate([line_start[1:], [len(data)]]) if len(row) else line_start
    first, last = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    plain = np.concatenate([[0], np.cumsum(~field)])
    used = last > first
    row, number, first, last = row[used], number[used], first[used], last[used]
    size, words = last - first, plain[last] - plain[first]
    alone = words == 0
    long = (size >= LONG) & (alone | (words >= SIMILARITY * size))
    leaf = mix(size.astype(np.uint64))
    for k in range(DEPTH):
        has = size > k
        leaf[has] = mix(leaf[has] ^ hashes[first[has] + k] + np.uint64(k))
    taken = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    place = np.arange(len(taken)) - np.repeat(np.cumsum(size) - size, size)
    told = np.where(np.repeat(alone, size), raw[taken], hashes[taken])
    weighed = mix(told + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = mix(np.add.reduceat(weighed, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64))
    leaf[alone] = 0
    return row, number, leaf.view(np.int64), whole.view(np.int64), long, codes[taken], np.concatenate([[0], np.cumsum(size)])


LINES = "text_key long, doc_id long, line int, leaf long, whole long, long boolean, codes binary"


def lines_of(docs: DataFrame) -> DataFrame:
    """:data:`LINES` of ``text_key doc_id text``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, leaf, whole, long, codes, at = parse_lines(batch.column("text"))
            codes = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(2 * at.astype(np.int64)), pa.py_buffer(codes.tobytes())])
            at_row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key").take(at_row), batch.column("doc_id").take(at_row), pa.array(number.astype(np.int32)),
                 pa.array(leaf), pa.array(whole), pa.array(long), codes.cast(pa.binary())],
                names=["text_key", "doc_id", "line", "leaf", "whole", "long", "codes"])

    return docs.mapInArrow(run, LINES)


@pandas_udf(BooleanType())
def agrees(codes: pd.Series, profile: pd.Series, similarity: pd.Series) -> pd.Series:
    def one(a, b, least):
        equal = (np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2"))[DEPTH:]
        return bool(len(equal) and equal.sum() >= max(2, least * len(equal)))

    return pd.Series([one(a, b, x) for a, b, x in zip(codes, profile, similarity, strict=True)])


@pandas_udf(StringType())
def without_lines(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    def clean(text, gone):
        if text is None or gone is None or not len(gone):
            return text
        gone = set(gone.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([clean(t, d) for t, d in zip(texts, dropped, strict=True)], dtype=object)


def _profiles(distinct: DataFrame) -> DataFrame:
    """``l profile``: the most frequent token of each place, for each leaf of ``leaf codes n``."""
    places = distinct.select("leaf", "n", F.posexplode(F.split(F.hex("codes"), "(?<=\\G....)")).alias("place", "code")).where("code <> ''")
    votes = places.groupBy("leaf", "place", "code").agg(F.sum("n").alias("n"))
    best = votes.groupBy("leaf", "place").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
    ordered = best.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s["code"]), "")
    return ordered.select(F.col("leaf").alias("l"), F.unhex(text).alias("profile"))


def _in_reach(distinct: DataFrame, min_texts: int) -> DataFrame:
    """The lines ``leaf whole n ...`` of leaves whose lines are held by enough texts."""
    reached = distinct.groupBy(F.col("leaf").alias("l")).agg(F.sum("n").alias("t")).where(F.col("t") >= min_texts).select("l")
    return distinct.join(by_shuffle(reached), F.col("leaf") == F.col("l"), "left_semi")


def templates_of(lines: DataFrame, min_texts: int, similarity: float) -> DataFrame:
    """``w template`` of the distinct lines that belong to a template of several lines.

    Each turn takes one template from every leaf; a leaf whose last one did not recur is done.
    """
    held = lines.where("leaf <> 0").select("leaf", "whole", "text_key").distinct().groupBy("leaf", "whole").agg(F.count("*").alias("n"))
    reached = materialise(_in_reach(held, min_texts), "line-reached")
    # copies of a line collapse before the lines of a leaf come together
    codes = lines.where("leaf <> 0").groupBy(F.col("whole").alias("w")).agg(F.first("codes").alias("codes"))
    left = materialise(reached.join(by_shuffle(codes), F.col("whole") == F.col("w")).drop("w"), "line-left")
    found = left.select(F.col("whole").alias("w"), F.lit(0).cast("long").alias("template")).where("false")
    turn = 0
    while not left.isEmpty():
        profiles = _profiles(left)
        marked = left.join(by_shuffle(profiles), F.col("leaf") == F.col("l")).withColumn("joins", agrees("codes", "profile", F.lit(similarity)))
        marked = materialise(marked.drop("l", "profile"), "line-marked")
        recurring = marked.where("joins").groupBy(F.col("leaf").alias("l")).agg(F.sum("n").alias("t")).where(F.col("t") >= min_texts).select("l")
        there = materialise(marked.join(by_shuffle(recurring), F.col("leaf") == F.col("l"), "left_semi"), "line-groups")
        found = found.unionByName(there.where("joins").select(F.col("whole").alias("w"), F.xxhash64("leaf", F.lit(turn)).alias("template")))
        left = materialise(_in_reach(there.where("NOT joins").drop("joins"), min_texts), "line-left")
        turn += 1
    return found


def _surplus(rows: DataFrame, name: str) -> DataFrame:
    """``text_key line`` of what goes: all but the home copies of what ``least`` texts hold."""
    texts = rows.groupBy(name, "text_key").agg(F.min("doc_id").alias("doc_id"), F.min("least").alias("least"))
    home = F.min_by("text_key", F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    recurring = texts.groupBy(F.col(name).alias("t")).agg(F.count("*").alias("n"), home.alias("home"), F.min("least").alias("least"))
    # written first: the join below then has two plain shuffles, and the rows of a frequent template can be split
    recurring = materialise(recurring.where(F.col("n") >= F.col("least")).select("t", "home"), "line-recurring")
    return rows.join(by_shuffle(recurring), F.col(name) == F.col("t")).where("text_key <> home").select("text_key", "line")


def dropped_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> DataFrame:
    """``text_key dropped``: the line numbers that go from each text, for ``text_key doc_id text``."""
    lines = materialise(lines_of(docs), "lines")
    found = materialise(templates_of(lines, min_texts, similarity), "line-found")
    own = lines.select("text_key", "doc_id", "line", "whole", F.when(F.col("long"), F.least(F.lit(2), F.lit(min_texts))).otherwise(min_texts).alias("least"))
    shared = own.join(by_shuffle(found), F.col("whole") == F.col("w")).withColumn("least", F.lit(min_texts)).select("text_key", "doc_id", "line", "template", "least")
    gone = _surplus(own, "whole").unionByName(_surplus(materialise(shared, "line-templates"), "template"))
    return gone.groupBy("text_key").agg(F.collect_set("line").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_texts: int = MIN_TEXTS,
                         similarity: float = SIMILARITY) -> DataFrame:
    """The frame with its text cleaned, and the numbers of the dropped lines in ``dropped`` (null: none).

    ``dropped`` gets underscores where the frame has such a column. The document id must be a whole number.
    """
    frame, names = sealed(docs)
    keyed = frame.withColumn("key", F.xxhash64(names[text]))
    found = materialise(dropped_lines(keyed.select(
        F.col("key").alias("text_key"), F.col(names[doc_id]).cast("long").alias("doc_id"), F.col(names[text]).alias("text")),
        min_texts, similarity), "line-dropped")
    joined = keyed.join(by_shuffle(found), F.col("key") == F.col("text_key"), "left")
    clean = without_lines(F.col(names[text]), F.col("dropped"))
    return joined.select(*[(clean if c == text else F.col(n)).alias(c) for c, n in names.items()],
                         F.col("dropped").alias(fresh(docs, "dropped")))


def line_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id n_lines n_dropped kept_chars kept_sha256`` of every document."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    cleaned = drop_recurring_lines(source, "text", "doc_id", **options)
    n_dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    left = F.when(F.col("text").isNull() | ((F.col("text") == "") & (n_dropped > 0)), 0).otherwise(
        F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    return cleaned.select(
        "doc_id", (left + n_dropped).alias("n_lines"), n_dropped.alias("n_dropped"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
