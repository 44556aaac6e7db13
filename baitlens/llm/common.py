"""What several operators share: words and hashes of Arrow text columns, batch limits, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Rows and bytes in one Arrow batch; a batch holds at least one row, whatever its length.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes hashed in one go inside a batch, so that temporary arrays stay small.
HASH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BYTE_LOWER = _BYTE[_LOWER]


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sealed(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns (or some of them) under names that no operator uses, and those names."""
    names = {c: f"c{i}__" for i, c in enumerate(df.columns if columns is None else columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: joined by a shuffle at every size, never by broadcasting a small one."""
    return df.hint("merge")


def bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array, and the offsets of each; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], dtype=np.int64)
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and how many words precede each text."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        base, top = starts[i], ends[j - 1]
        at = starts[i:j] - base
        place = np.arange(top - base) - np.repeat(at, np.diff(np.append(at, top - base)))
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE | np.uint64(1), np.uint64))
        values = table[data[base:top]] * powers[place]
        values[_SPACE[data[base:top]]] = 0
        out[i:j] = np.add.reduceat(values, at)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _BASE)


def windows(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and how many runs precede each text.

    A text of fewer words (one at least) has one run, all its words.
    """
    counts = np.diff(before)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    after = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(after[-1]) + np.repeat(before[:-1] - after[:-1], runs)
    stop = np.repeat(before[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = at + k < stop
        factor = mix(np.array([k + 1], np.uint64) * _BASE)[0] | np.uint64(1)
        out[here] += hashes[at[here] + k] * factor
    return mix(out), after


def rounds_of(edges: DataFrame) -> DataFrame:
    """One round on edges ``a > b``: each larger neighbour, then each smaller one, moves to the least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", "m")).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node root``: the least node that links lead to, for each node with a link to another.

    ``edges`` has integers ``a`` and ``b``. Each round is a few joins and aggregates on the edges that are left, written
    to the shared folder; the number of rounds grows with the logarithm of a component's size.
    """
    normal = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(normal, name)
    while True:
        inner = now.join(now.select(F.col("a").alias("_n")), F.col("b") == F.col("_n"), "left_semi")
        if inner.isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        now = materialise(rounds_of(now), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", F.col("b").alias("root")).distinct())
