"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are runs of five words; a shingle weighs its count in the text times its inverse document frequency. Frequencies
of all documents are gathered in a count-min sketch of fixed size; below :data:`RARE_SHARE` of the documents all shingles
weigh the same, so the sketch's error only matters for frequent ones, and every document sees the same weights. Improved
consistent weighted sampling draws one (shingle, level) per hash function; two texts agree on a draw as often as their
weighted Jaccard similarity says. Bands of draws are the candidate keys.

Equal texts are one node from the start. In a bucket every text is compared with the oldest one, its leader. Texts of a
leader that then are in different components meet if they share a shingle which the leader lacks, among the first that make
up a fifth of their weight, or if their weights inside the leader leave room for the similarity. Similar texts always do
one or the other. So a family of copies costs one comparison per member, texts that share no more than a passage cost none
among themselves, and no candidate link is left out. Links have a verified weighted Jaccard similarity of at least 0.8;
classes are the components of the links.

Defined results: a null text, or one without a word, is a class of its own row's text (null texts: of the row); a text of
one to four words has one shingle; long texts are read whole; rows without an id can share a class, whose id is the
smallest id of its rows; repeated rows share a class and of rows that repeat the kept id one stays; an empty table gives
an empty result; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bounded_batches, by_shuffle, bytes_of, components, mix, same, sealed, windows, word_hashes, word_spans

WORDS, SIMILARITY = 5, 0.8
#: 22 bands of 5 draws: a pair at 0.8 is missed with probability 0.0002.
BANDS, DRAWS = 22, 5
RARE_SHARE = 0.01
#: Count-min sketch: rows and columns; its expected error is a share of the documents that does not grow with them.
SKETCH_ROWS, SKETCH_COLUMNS, SKETCH_CHUNK = 2, 1 << 17, 1 << 13
#: Index bits of the table of draws, and shingles that are drawn from at once.
_ENTRIES, CHUNK = 16, 1 << 15


def shingle_counts(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of an Arrow column, sorted inside each text, their counts, and the offsets of the texts."""
    data, offsets = bytes_of(texts)
    starts, ends, before = word_spans(data, offsets)
    hashes, after = windows(word_hashes(data, starts, ends), before, WORDS)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(after))
    order = np.argsort(hashes)
    # a stable sort of small integers is a radix sort; a batch has few texts
    order = order[np.argsort(text[order].astype(np.uint16 if len(offsets) <= 1 << 16 else np.int64), kind="stable")]
    hashes, text = hashes[order], text[order]
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    return hashes[first], np.diff(np.append(first, len(hashes))), np.searchsorted(text[first], np.arange(len(offsets)))


def sketch_places(shingles: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(64 - int(np.log2(SKETCH_COLUMNS)))
    return [(mix(shingles + np.uint64(row + 1)) >> bits).astype(np.int64) for row in range(SKETCH_ROWS)]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch (rows by columns) of how many texts hold a shingle, and the number of texts; from a column ``text``."""
    bounded_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((SKETCH_ROWS, SKETCH_COLUMNS), np.int64), 0
        for batch in batches:
            shingles, _, at = shingle_counts(batch.column("text"))
            n += int((np.diff(at) > 0).sum())
            for row, places in enumerate(sketch_places(shingles)):
                counts[row] += np.bincount(places, minlength=SKETCH_COLUMNS)
        chunks = counts.reshape(-1, SKETCH_CHUNK)
        used = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([-1, *used], pa.int32()),
            "counts": pa.array([np.array([n]).tobytes(), *[chunks[i].tobytes() for i in used]], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = 0, None
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            for x in batch.column("counts").to_pylist():
                total = total + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(run, "chunk int, counts binary")
    # two steps, so that no task adds up what every task of the first step made
    spread = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    halves = spread.groupBy("chunk", "part").applyInArrow(summed, "chunk int, counts binary")
    sketch, n = np.zeros((SKETCH_ROWS * SKETCH_COLUMNS // SKETCH_CHUNK, SKETCH_CHUNK), np.int64), 0
    for r in halves.groupBy("chunk").applyInArrow(summed, "chunk int, counts binary").collect():
        if r["chunk"] < 0:
            n = int(np.frombuffer(r["counts"], np.int64)[0])
        else:
            sketch[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return sketch.reshape(SKETCH_ROWS, SKETCH_COLUMNS), n


class Weights:
    """Document frequencies of the sketch and the weights made of them, as the workers use them."""

    def __init__(self, sketch: np.ndarray, n: int):
        self.sketch, self.n = sketch, max(n, 1)

    def frequencies(self, shingles: np.ndarray) -> np.ndarray:
        return np.min([self.sketch[row][places] for row, places in enumerate(sketch_places(shingles))], axis=0)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log1p(1 / np.maximum(self.frequencies(shingles) / self.n, RARE_SHARE)) * counts

    def prefix(self, shingles: np.ndarray, counts: np.ndarray, similarity: float, last: np.ndarray) -> np.ndarray:
        """The first shingles of a text, up to more than 1 - similarity of its weight; which, as a mask.

        Shingles marked in ``last`` come after all others, rare ones before frequent ones. In any order that is the same for
        all texts, two texts that reach the similarity have their first common shingle in both prefixes.
        """
        frequency = self.frequencies(shingles)
        order = np.lexsort([shingles, frequency, last])
        weight = np.log1p(1 / np.maximum(frequency / self.n, RARE_SHARE))[order] * counts[order]
        before = np.cumsum(weight) - weight
        mask = np.zeros(len(shingles), bool)
        mask[order[before <= (1 - similarity) * weight.sum() + 1e-9]] = True
        return mask


@lru_cache(maxsize=1)
def _draw_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), beta ~ uniform and ln c, c ~ Gamma(2, 1), for every value of the index bits."""
    def uniform(salt: int) -> np.ndarray:
        raw = mix(np.arange(1 << _ENTRIES, dtype=np.uint64) * np.uint64(8) + np.uint64(salt))
        return ((raw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53

    r = -np.log(uniform(0) * uniform(1))
    return r, uniform(2), np.log(-np.log(uniform(3) * uniform(4)))


def _log_a(entry: np.ndarray, log_weight: np.ndarray | float) -> np.ndarray:
    """ln a of a draw; it depends on the weight only through the level, so equal values mean equal levels."""
    r, beta, log_c = (x[entry] for x in _draw_table())
    level = np.floor(log_weight / r + beta)
    return (log_c - r * (level - beta) - r).astype(np.float32)


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats."""
    bits = x.view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


@lru_cache(maxsize=1)
def _usual_bits() -> np.ndarray:
    """The sort keys of all entries for a rare shingle that occurs once."""
    entries = np.arange(1 << _ENTRIES)
    return _ordered_bits(_log_a(entries, np.log(np.log1p(1 / RARE_SHARE))))


def band_keys(shingles: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts by bands: a key of the band's draws. Every text must have a shingle."""
    usual_weight = np.log1p(1 / RARE_SHARE)
    out = np.empty((len(at) - 1, BANDS), np.uint64)
    first = 0
    while first < len(out):
        # few texts at a time, so that the arrays of one draw stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
        here = slice(at[first], at[last])
        odd = np.flatnonzero(np.abs(weights[here] - usual_weight) > 1e-12)
        _chunk_keys(shingles[here], odd, np.log(weights[here][odd]), at[first:last] - at[first], out[first:last])
        first = last
    return out


def _chunk_keys(shingles: np.ndarray, odd: np.ndarray, log_odd: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    usual, low, shift = _usual_bits(), np.uint64(0xFFFFFFFF), np.uint64(64 - _ENTRIES)
    scrambled, entry, bits = (np.empty(len(shingles), np.uint64) for _ in range(3))
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for draw in range(DRAWS):
            factor = mix(np.array([band * DRAWS + draw + 1], np.uint64))[0] | np.uint64(1)
            np.multiply(shingles, factor, out=scrambled)
            np.right_shift(scrambled, shift, out=entry)
            np.take(usual, entry.view(np.int64), out=bits, mode="clip")
            if len(odd):
                bits[odd] = _ordered_bits(_log_a(entry[odd].view(np.int64), log_odd))
            # ties between shingles of one entry are broken by other bits of the same product
            np.bitwise_and(scrambled, low, out=scrambled)
            np.bitwise_or(bits, scrambled, out=bits)
            key = mix(key ^ np.minimum.reduceat(bits, starts))
        out[:, band] = key


def signatures(docs: DataFrame, weights) -> DataFrame:
    """``doc_id node bands``: from ``doc_id node text``; no bands for a text without a word."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, counts, at = shingle_counts(batch.column("text"))
            full = np.flatnonzero(np.diff(at) > 0)
            per_row = np.zeros(batch.num_rows, np.int64)
            values = np.zeros(0, np.int64)
            if len(full):
                per_row[full] = BANDS
                values = band_keys(shingles, weights.value(shingles, counts), np.append(at[full], len(shingles))).ravel().view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), bands], names=["doc_id", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "node", "text").mapInArrow(run, f"doc_id {kind}, node long, bands array<long>")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Common weight of two (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return float(np.minimum(a[1][i], b[1][j]).sum())


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common = overlap(a, b)
    return common / max(float(a[1].sum() + b[1].sum()) - common, 1e-300)


def compared(pairs: DataFrame, texts: DataFrame, weights, similarity: float, describe: bool = False) -> DataFrame:
    """The pairs ``a b`` of nodes with ``good``: whether their texts (``node text``) reach the similarity.

    ``describe`` adds ``weight`` (of a), ``within`` (its weight on shingles of b), and ``outside``: the shingles of a that are
    not in b and belong to the prefix of a when all shingles of b come last.
    """
    left = texts.select(F.col("node").alias("_a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("_b"), F.col("text").alias("right"))
    joined = by_shuffle(by_shuffle(pairs).join(left, F.col("a") == F.col("_a"))).join(right, F.col("b") == F.col("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("left", "right"):
                shingles, counts, at = shingle_counts(batch.column(side))
                w = weights.value(shingles, counts)
                sides.append([(shingles[x:y], w[x:y], counts[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)])
            columns = {"a": batch.column("a"), "b": batch.column("b"),
                       "good": pa.array([weighted_jaccard(x[:2], y[:2]) >= similarity for x, y in zip(*sides, strict=True)], pa.bool_())}
            if describe:
                inside = [np.isin(x[0], y[0], assume_unique=True) for x, y in zip(*sides, strict=True)]
                columns["weight"] = pa.array([float(x[1].sum()) for x in sides[0]], pa.float64())
                columns["within"] = pa.array([float(x[1][i].sum()) for x, i in zip(sides[0], inside, strict=True)], pa.float64())
                columns["outside"] = pa.array([x[0][weights.value.prefix(x[0], x[2], similarity, i) & ~i].view(np.int64)
                                               for x, i in zip(sides[0], inside, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "a long, b long, good boolean" + (", weight double, within double, outside array<long>" if describe else "")
    return joined.select("a", "b", "left", "right").mapInArrow(run, schema)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def unsettled_pairs(tried: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a b`` in different components that may be similar, of nodes which were compared with the same leader.

    ``tried`` has ``a leader weight within outside``. Common shingles of two similar texts either include one that the leader
    lacks; the first such is in the prefixes of both. Or the leader has them all, and then the weights within the leader
    bound the overlap: it must be at least s / (1 + s) of both weights together.
    """
    known = tried.join(roots.select(F.col("node").alias("_n"), "root"), F.col("a") == F.col("_n"), "left").select(
        "a", "leader", "weight", "within", "outside", F.coalesce("root", "a").alias("root"))
    known = known.join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("leader") == F.col("_n"), "left")
    known = materialise(known.select("a", "leader", "weight", "within", "outside", "root",
                                     (F.col("root") != F.coalesce("_r", "leader")).alias("apart")), "near-known")
    shingle = known.select("leader", "a", "root", F.explode("outside").alias("s")).select(F.xxhash64("leader", "s").alias("key"), "a", "root")
    members = [F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("y")]
    parts = shingle.groupBy("key", "root").agg(F.count("*").alias("n"), *members)
    mixed = parts.groupBy(F.col("key").alias("k")).agg(
        F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("parts"), F.sum("n").alias("n"),
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("parts > 1")
    # the shingles around one changed word have the same members: one of them will do
    mixed = mixed.groupBy("n", "x", "y").agg(F.min(F.struct("k", "largest")).alias("m")).select("m.*")
    mixed = materialise(mixed, "near-mixed")
    crowded = shingle.join(by_shuffle(mixed), F.col("key") == F.col("k")).select("key", "a", "root", "largest")
    crowded = materialise(crowded, "near-crowded")
    # a pair with several common keys meets under the least one only
    own = crowded.groupBy(F.col("a").alias("n")).agg(F.collect_set("key").alias("keys"))
    listed = materialise(crowded.join(by_shuffle(own), F.col("a") == F.col("n")).drop("n"), "near-listed")
    few = listed.where("root <> largest").select(F.col("key").alias("kx"), F.col("a").alias("x"), F.col("root").alias("rx"), F.col("keys").alias("keys_x"))
    first = F.col("key") == F.array_min(F.array_intersect("keys_x", "keys"))
    outside = few.join(by_shuffle(listed), (F.col("key") == F.col("kx")) & (F.col("rx") != F.col("root")) & first).select(*_ordered("x", "a"))
    # weights in steps of 5 %, so that only weights that can fit meet
    step = lambda w: F.floor(F.log(F.greatest(w, F.lit(1e-12))) / math.log(1.05)).cast("int")
    room = F.col("within") * (1 + similarity) / similarity - F.col("weight") + 1e-6
    small, large = similarity * F.col("weight"), F.least(F.col("weight") / similarity, room)
    apart = known.where("apart").where(room >= small).select(
        F.col("leader").alias("lx"), F.col("a").alias("x"), F.col("root").alias("rx"), F.col("weight").alias("wx"), room.alias("room_x"),
        F.explode(F.sequence(step(small), F.greatest(step(small), step(large)))).alias("bx"))
    others = known.where(room >= small).select("leader", "a", "root", "weight", room.alias("room"), step(F.col("weight")).alias("bin"))
    within = apart.join(others, (F.col("leader") == F.col("lx")) & (F.col("bin") == F.col("bx")) & (F.col("root") != F.col("rx")) & (
        F.col("weight") <= F.col("room_x")) & (F.col("wx") <= F.col("room"))).select(*_ordered("x", "a"))
    return outside.unionByName(within).distinct()


def near_duplicate_links(keys: DataFrame, texts: DataFrame, weights, similarity: float) -> DataFrame:
    """Verified links ``a b`` that connect every pair of nodes which shares a key and is similar enough.

    ``keys`` has ``key node doc_id``. Every node meets the oldest text (the smallest id) of its buckets; of the rest only those
    meet that can be similar, given how much of them that text has.
    """
    oldest = F.min_by("node", F.struct(F.col("doc_id").isNull(), "doc_id", "node"))
    # written first: the join then has two plain shuffles, and the rows of a large bucket can be split
    leaders = materialise(keys.groupBy(F.col("key").alias("k")).agg(oldest.alias("leader")), "near-leaders")
    pairs = keys.join(by_shuffle(leaders), F.col("key") == F.col("k")).where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    tried = materialise(compared(materialise(pairs, "near-pairs"), texts, weights, similarity, describe=True), "near-tried")
    roots = components(tried.where("good").select("a", "b"), "near-roots")
    met = unsettled_pairs(tried.withColumnRenamed("b", "leader"), roots, similarity).join(
        tried.select(*_ordered("a", "b")), ["a", "b"], "left_anti")
    found = compared(materialise(met, "near-met"), texts, weights, similarity).where("good").select("a", "b")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)


def text_node(text: Column, doc_id: Column) -> Column:
    """A number for each text; a null text is nobody's copy, its row's id stands for it."""
    return F.xxhash64(F.coalesce(F.md5(text.cast("binary")), F.concat(F.lit("null:"), F.coalesce(doc_id.cast("string"), F.lit("")))))


def near_duplicate_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id node class_id kept`` of every row; ``node`` identifies the text, ``class_id`` is the class's smallest id."""
    spark = docs.sparkSession
    content, own_id = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    source = docs.select(own_id.alias("doc_id"), text_node(content, own_id).alias("node"), content.alias("text"))
    weights = spark.sparkContext.broadcast(Weights(*document_frequencies(source)))
    signed = materialise(signatures(source, weights), "near-signed")
    nodes = materialise(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id")), "near-nodes")
    keys = nodes.select("node", "doc_id", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").count().where("count > 1").select("key")
    keys = materialise(keys.join(crowded, "key"), "near-keys")
    wanted = keys.select("node").distinct().join(nodes.select("node", "doc_id"), "node").select(F.col("node").alias("n"), F.col("doc_id").alias("d"))
    texts = source.join(by_shuffle(wanted), (F.col("node") == F.col("n")) & same(F.col("doc_id"), F.col("d")), "left_semi")
    texts = materialise(texts.select("node", "text").dropDuplicates(["node"]), "near-texts")
    roots = components(near_duplicate_links(keys, texts, weights, similarity), "near-classes")
    placed = nodes.select("node", "doc_id").join(roots, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = materialise(placed.join(smallest, "root").select(F.col("node").alias("n"), "class_id"), "near-class-ids")
    return signed.select("doc_id", "node").join(classes, F.col("node") == F.col("n")).select(
        "doc_id", "node", "class_id", same(F.col("doc_id"), F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one with the smallest id, with its own columns."""
    classes = near_duplicate_classes(docs, text, doc_id, similarity)
    kept = materialise(classes.where("kept").groupBy(F.col("doc_id").alias("_d"), F.col("node").alias("_n")).agg(
        F.count("*").alias("_rows")), "near-kept")
    frame, names = sealed(docs)
    rows = frame.withColumn("node", text_node(F.col(names[text]), F.col(names[doc_id]))).join(
        by_shuffle(kept), (F.col("node") == F.col("_n")) & same(F.col(names[doc_id]), F.col("_d")))
    repeated = rows.where("_rows > 1").dropDuplicates(["node", names[doc_id]])
    return rows.where("_rows = 1").unionByName(repeated).select(*[F.col(n).alias(c) for c, n in names.items()])


def class_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id class_id kept`` of every document."""
    return near_duplicate_classes(docs, text, doc_id, **options).select("doc_id", "class_id", "kept")
