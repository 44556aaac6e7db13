"""Exact substring dedup: every byte covered by a window of 200 bytes that also starts somewhere else is removed.

Windows are sorted by most significant digits, no deeper than their 200 bytes, and groups of one leave after each pass.

Pass 1. The suffixes to sort are thinned first: a window belongs to its anchor, the place of the least hash of the 16-byte
strings inside it, so equal windows have equal anchors at equal distances. Consecutive windows of one anchor whose distances
fall into the same 64 form a slot. The digit is the core, the bytes that all windows of such a slot share; a slot
whose core is found once holds no repeated window and is dropped.

Pass 2. The digit is the whole stretch of the slot. Slots with equal cores and stretches repeat each other in every
window. What is left are slots with a core in common but other bytes around it, at the ends of repeated passages.

Pass 3. For these, one slot of each stretch unfolds into its windows, and the digit is the window itself.

Slots move as hashes and positions (a match needs equal cores and equal stretches, 128 bits); a text is read again only
for pass 3 and for the removal. Hot digits are counted before they are shuffled, and the joins back can be split. Texts are
known by a 64-bit hash, so copies of a text share their slots.

Defined results: a null text is empty; a text shorter than a window keeps all bytes; matches never cross texts, but do
overlap themselves; a long text is cut into segments that overlap by a window; repeated rows repeat each other, so texts of
at least one window lose everything; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import _BASE, _BYTE, bounded_batches, by_shuffle, bytes_of, fresh, mix

WINDOW, GRAM, SPREAD = 200, 16, 64
#: Bytes that are worked on at once; longer texts are cut into segments of this size and a window more.
SEGMENT = 1 << 21
_INDEX = np.uint64((1 << 24) - 1)
_ODD = _BASE | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return (np.concatenate([one, np.cumprod(np.full(n, _ODD, np.uint64))]), np.concatenate([one, np.cumprod(np.full(n, inverse, np.uint64))]))


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(SEGMENT + 2 * WINDOW)
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` keys."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    right = np.minimum.accumulate(padded, axis=1).ravel()
    left = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(left[: n - width + 1], right[width - 1: n])


def slots_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, core and stretch of every slot of some texts (at most a segment)."""
    empty = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty, empty, empty
    hashes = Hashes(data)
    gram, power, size = _BYTE[data], _ODD, 1
    while size < GRAM:
        gram = gram[:-size] * power + gram[size:]
        power, size = np.uint64(int(power) ** 2 % (1 << 64)), 2 * size
    gram = (mix(gram) & ~_INDEX) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_least(gram, WINDOW - GRAM + 1) & _INDEX).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = start + WINDOW <= offsets[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if not len(start):
        return empty, empty, empty, empty, empty
    band = (anchor - start) // SPREAD
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (band[1:] != band[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    anchor, band, low = anchor[first], band[first], start[first]
    high = low + count - 1
    at = anchor - band * SPREAD
    core = mix(hashes.of(at, at - SPREAD + 1 + WINDOW) ^ band.astype(np.uint64))
    reach = ((anchor - low) * 256 + (anchor - high)).astype(np.uint64)
    stretch = mix(hashes.of(low, high + WINDOW) ^ mix(reach))
    return text[first], low, count, core.view(np.int64), stretch.view(np.int64)


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Groups of whole texts of at most a segment, and the overlapping segments of longer ones.

    Yields bytes, offsets, the first text, and where in that text the bytes begin.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > SEGMENT:
            for at in range(0, int(offsets[i + 1] - offsets[i]) - WINDOW + 1, SEGMENT):
                piece = data[offsets[i] + at: min(offsets[i] + at + SEGMENT + WINDOW - 1, offsets[i + 1])]
                yield piece, np.array([0, len(piece)]), i, at
            i += 1
            continue
        j = int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1
        yield data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], i, 0
        i = j


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of materialised frames that nothing reads any more, and the shuffle files of dropped ones.

    Only for frames of this module, whose readers have been written to the shared folder themselves.
    """
    jvm = spark.sparkContext._jvm
    for frame in frames:
        folders = {file.rpartition("/")[0] for file in frame.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


def slots(texts: DataFrame) -> DataFrame:
    """``core stretch key place`` of ``key text``: place is the first window times 256 plus the number of windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for piece, at, first, begin in _segments(data, offsets):
                text, low, count, core, stretch = slots_of(piece, at)
                place = (low - at[text] + begin) * 256 + count
                yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(stretch), pa.array(keys[first + text]), pa.array(place)],
                                                 names=["core", "stretch", "key", "place"])

    return texts.mapInArrow(run, "core long, stretch long, key long, place long")


def unfolded(texts: DataFrame) -> DataFrame:
    """``window key start wanted`` of ``key text places wanted``: the windows of the listed slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            for row in range(batch.num_rows):
                key = batch.column("key")[row].as_py()
                place = np.sort(np.array(batch.column("places")[row].as_py(), np.int64))
                wanted, place = place & 1, place >> 1
                low, count = place >> 8, place & 255
                for i, j, begin in _runs(low, count):
                    piece = data[offsets[row] + begin: offsets[row] + low[j - 1] + count[j - 1] - 1 + WINDOW]
                    start = np.repeat(low[i:j] - begin - np.cumsum(count[i:j]) + count[i:j], count[i:j]) + np.arange(count[i:j].sum())
                    window = Hashes(piece).of(start, start + WINDOW)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(window.view(np.int64)), pa.array(np.full(len(start), key)), pa.array(start + begin),
                         pa.array(np.repeat(wanted[i:j], count[i:j]) > 0)], names=["window", "key", "start", "wanted"])

    return texts.mapInArrow(run, "window long, key long, start long, wanted boolean")


def _runs(low: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Groups of slots that lie within a segment: first, last (exclusive), and where the first begins."""
    i = 0
    while i < len(low):
        j = i + 1
        while j < len(low) and low[j] + count[j] - low[i] <= SEGMENT:
            j += 1
        yield i, j, int(low[i])
        i = j


def repeated_places(texts: DataFrame) -> DataFrame:
    """``key places``: the runs of repeated windows (first window times 256 plus how many) of each text ``key text``."""
    spark = texts.sparkSession
    found = materialise(slots(texts), "windows-slots")
    # pass 1: slots whose core is found again
    cores = found.groupBy(F.col("core").alias("c")).count().where("count > 1").select("c")
    cores = materialise(cores, "windows-cores")
    discard(spark)
    shared = materialise(found.join(by_shuffle(cores), F.col("core") == F.col("c")).drop("c"), "windows-shared")
    discard(spark, found, cores)
    # pass 2: slots whose whole stretch is found again
    stretches = materialise(shared.groupBy("core", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")), "windows-stretches")
    twice = stretches.where("n > 1").select(F.col("core").alias("c"), F.col("stretch").alias("s"))
    equal = shared.join(by_shuffle(twice), (F.col("core") == F.col("c")) & (F.col("stretch") == F.col("s"))).select("key", "place")
    equal = materialise(equal.distinct(), "windows-equal")
    # pass 3: the windows of stretches that share their core with another stretch
    mixed = stretches.groupBy(F.col("core").alias("c")).count().where("count > 1").select("c")
    opened = stretches.join(mixed, F.col("core") == F.col("c")).select(
        F.col("one.key").alias("k"), (F.col("one.place") * 2 + F.when(F.col("n") == 1, 1).otherwise(0)).alias("p"))
    opened = materialise(opened.groupBy("k").agg(F.collect_list("p").alias("places")), "windows-open")
    unfold = materialise(unfolded(texts.join(by_shuffle(opened), F.col("key") == F.col("k")).select("key", "text", "places")), "windows-unfolded")
    discard(spark, shared, stretches, opened)
    again = unfold.groupBy(F.col("window").alias("w")).count().where("count > 1").select("w")
    single = unfold.where("wanted").join(by_shuffle(again), F.col("window") == F.col("w")).select("key", (F.col("start") * 256 + 1).alias("place"))
    places = equal.unionByName(single.distinct()).groupBy("key").agg(F.collect_list("place").alias("places"))
    places = materialise(places, "windows-places")
    discard(spark, equal, unfold)
    return places


def merged_spans(places: np.ndarray) -> np.ndarray:
    """Maximal runs of bytes (start, end) that the windows cover; runs that touch are one."""
    places = np.sort(places)
    start, end = places >> 8, (places >> 8) + (places & 255) - 1 + WINDOW
    if not len(start):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.column_stack([start[first], np.append(reach[first[1:] - 1], reach[-1])])


def remove_repeated(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns by default), ``removed_spans`` (byte ranges, end exclusive) and ``kept_bytes`` of every row.

    The two names get underscores where the frame has such columns. What is kept of a character need not be whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    carried = docs.columns if carry is None else carry
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    places = repeated_places(docs.select(F.xxhash64(content).alias("key"), content.alias("text")))
    inner = {c: f"c{i}__" for i, c in enumerate(carried)}
    names = [*inner.values()]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], content.alias("text"), F.xxhash64(content).alias("key")).join(
        by_shuffle(places.withColumnRenamed("key", "k")), F.col("key") == F.col("k"), "left").drop("k", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            spans, kept = [], []
            for row, found in enumerate(batch.column("places")):
                piece = data[offsets[row]: offsets[row + 1]]
                gone = merged_spans(found.values.to_numpy()) if found.is_valid else np.zeros((0, 2), np.int64)
                edges = np.concatenate([[0], gone.ravel(), [len(piece)]]).reshape(-1, 2)
                kept.append(b"".join(piece[a:b].tobytes() for a, b in edges))
                spans.append([{"start": a, "end": b} for a, b in gone.tolist()])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(spans, kind), pa.array(kept, pa.binary())],
                                             names=[*names, "spans", "kept"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}spans array<struct<start: long, end: long>>, kept binary")
    left = docs.select(*[F.col(f"`{c}`") for c in carried])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carried, strict=True)],
                      F.col("spans").alias(fresh(left, "removed_spans")), F.col("kept").alias(fresh(left, "kept_bytes")))


def removal_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id n_bytes n_removed n_spans kept_sha256`` of every row."""
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = remove_repeated(source, "text", ["doc_id"])
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return out.select("doc_id", (F.octet_length("kept_bytes") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
