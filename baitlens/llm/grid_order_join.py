"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least the threshold lie within epsilon = sqrt(2 - 2 * threshold). Vectors are rotated to
their principal axes; the cells of side epsilon on the leading axes give the epsilon grid order, by which the vectors of a
label are sorted (range partitions, so a frequent label is many tasks) and cut into blocks. The order is a tree of
intervals. Pairs of intervals are split level by level, from the whole sequence down to blocks, and a pair whose boxes are
further apart than epsilon is dropped with everything below it. The blocks that are left are compared by a matrix product in
double precision; a block pair returns for each linked vector its links and the least vector it is connected with inside
the pair, never the pairs of vectors.

Vectors of equal label and equal components are one node that counts its copies.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one without a label, links
with nothing; vectors of different lengths never link; rows without an id link as others do, and the component id is the
smallest id there is; repeated rows are vectors of their own; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_rank
from ..session import materialise
from .common import bounded_batches, components, same

COSINE = 0.98
#: Leading principal axes, vectors in a block, children of an interval.
AXES, BLOCK, FAN = 6, 1024, 8
SLACK = 1e-9


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Python workers get that many rows at a time; for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and very small components."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def nodes_of(rows: DataFrame) -> DataFrame:
    """``vec_id label dim raw node`` from ``vec_id label embedding``: the vector's bytes; null where it cannot link."""
    value = F.col("embedding")
    usable = F.col("label").isNotNull() & value.isNotNull() & (F.size(value) > 0) & F.forall(
        value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0)
    good = rows.select("vec_id", F.col("label").cast("string").alias("label"),
                       F.when(F.coalesce(usable, F.lit(False)), value.cast("array<double>")).alias("v"))
    key = F.when(F.col("v").isNotNull(), F.xxhash64("label", "v", F.hash("v")))
    return good.select("vec_id", "label", F.col("v").alias("raw"), key.alias("node"))


def principal_axes(nodes: DataFrame, dim: int, axes: int) -> np.ndarray:
    """Leading eigenvectors (columns) of the covariance of the unit vectors; shorter vectors are padded with zeros."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for x in _matrices(batch.column("raw")):
                x = np.pad(unit(x), ((0, 0), (0, dim - x.shape[1])))
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            for x in batch.column("g").to_pylist():
                total += np.frombuffer(x).reshape(dim + 1, dim + 1)
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    parts = nodes.select("raw").mapInArrow(run, "g binary").repartition(8).mapInArrow(summed, "g binary")
    gram = sum((np.frombuffer(r["g"]).reshape(dim + 1, dim + 1) for r in parts.toLocalIterator()), np.zeros((dim + 1, dim + 1)))
    mean = gram[:-1, -1] / max(gram[-1, -1], 1)
    covariance = gram[:-1, :-1] / max(gram[-1, -1], 1) - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1][:, ::-1][:, :axes]


def _matrices(column) -> Iterator[np.ndarray]:
    """The vectors of an Arrow list column as one matrix per run of equal lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]]) if len(lengths) else np.zeros(1, int)
    values, start = column.flatten().to_numpy(zero_copy_only=False), 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(lengths[a:b].sum())
        yield values[start: start + size].reshape(b - a, -1)
        start += size


def grid_ordered(nodes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """The nodes with their coordinates ``x`` on the axes and cells ``c``, sorted by label, length and cells."""
    dim, k = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.pad(unit(x), ((0, 0), (0, dim - x.shape[1]))) @ axes for x in _matrices(batch.column("raw"))]
            x = np.vstack(found) if found else np.zeros((0, k))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), k).cast(pa.list_(kind))
                     for v, kind in ((x, pa.float64()), (np.floor(x / epsilon).astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "x", "c"])

    schema = "node long, label string, raw array<double>, copies long, dim int, x array<double>, c array<int>"
    placed = materialise(nodes.select("node", "label", "raw", "copies", F.size("raw").alias("dim")).mapInArrow(run, schema), "grid-cells")
    order = ["label", "dim", *[F.col("c")[i] for i in range(k)], "node"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def blocks_of(ordered: DataFrame, k: int) -> DataFrame:
    """Runs of at most :data:`BLOCK` nodes of one label and length: their box and, as bytes, ids, copies and vectors."""
    bounds = [f"{side}{i}" for side in ("lo", "hi") for i in range(k)]
    schema = "part int, seq long, label string, dim int, nodes binary, copies binary, raw binary, " + ", ".join(f"{b} double" for b in bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq = {}, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            x = np.vstack(held["x"])
            row = {"part": held["part"], "seq": seq, "label": held["label"], "dim": held["dim"],
                   "nodes": np.concatenate(held["node"]).tobytes(), "copies": np.concatenate(held["copies"]).tobytes(),
                   "raw": np.vstack(held["raw"]).tobytes()}
            row |= dict(zip(bounds, [*x.min(axis=0).tolist(), *x.max(axis=0).tolist()], strict=True))
            seq, held = seq + 1, {}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("nodes", pa.binary()),
                           ("copies", pa.binary()), ("raw", pa.binary()), *[(b, pa.float64()) for b in bounds]])
        for batch in batches:
            labels, dims = batch.column("label").to_pylist(), batch.column("dim").to_numpy()
            i, n = 0, batch.num_rows
            while i < n:
                if held and (held["label"] != labels[i] or held["dim"] != dims[i] or held["n"] >= BLOCK):
                    yield flush()
                if not held:
                    held = {"label": labels[i], "dim": int(dims[i]), "n": 0, "part": batch.column("part")[0].as_py(),
                            "node": [], "copies": [], "raw": [], "x": []}
                j = i
                while j < n and j - i < BLOCK - held["n"] and labels[j] == held["label"] and dims[j] == held["dim"]:
                    j += 1
                piece = batch.slice(i, j - i)
                held["node"].append(piece.column("node").to_numpy())
                held["copies"].append(piece.column("copies").to_numpy())
                held["raw"].append(piece.column("raw").flatten().to_numpy().reshape(j - i, -1))
                held["x"].append(piece.column("x").flatten().to_numpy().reshape(j - i, -1))
                held["n"] += j - i
                i = j
        if held:
            yield flush()

    return ordered.select("node", "label", "raw", "copies", "dim", "x", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def interval_pairs(boxes: DataFrame, k: int, epsilon: float) -> DataFrame:
    """Pairs ``a b`` of blocks (``pos`` from 0, ``label``, ``dim`` and bounds) that may hold vectors within epsilon."""
    lows, highs = [f"lo{i}" for i in range(k)], [f"hi{i}" for i in range(k)]
    total = boxes.count()
    levels = 0
    while FAN ** levels < total:
        levels += 1

    def level(n: int) -> DataFrame:
        return boxes.groupBy("label", "dim", F.floor(F.col("pos") / FAN ** n).cast("long").alias("iv")).agg(
            *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])

    pairs = materialise(level(levels).select("label", "dim", F.col("iv").alias("a"), F.col("iv").alias("b")), "grid-pairs")
    for n in range(levels - 1, -1, -1):
        children = materialise(level(n), "grid-intervals")

        def side(name: str, children: DataFrame = children) -> DataFrame:
            return children.select(
                F.col("label").alias(f"{name}_label"), F.col("dim").alias(f"{name}_dim"), F.floor(F.col("iv") / FAN).cast("long").alias(f"{name}_up"),
                F.col("iv").alias(f"{name}_iv"), *[F.col(c).alias(f"{name}_{c}") for c in lows + highs])

        joined = pairs
        for name, up in (("l", "a"), ("r", "b")):
            joined = joined.join(side(name), (F.col("label") == F.col(f"{name}_label")) & (F.col("dim") == F.col(f"{name}_dim")) & (
                F.col(up) == F.col(f"{name}_up")))
        gaps = [F.greatest(F.lit(0.0), F.col(f"l_lo{i}") - F.col(f"r_hi{i}"), F.col(f"r_lo{i}") - F.col(f"l_hi{i}")) for i in range(k)]
        near = sum((g * g for g in gaps), F.lit(0.0)) <= (epsilon + SLACK) ** 2
        pairs = materialise(joined.where((F.col("l_iv") <= F.col("r_iv")) & near).select(
            "label", "dim", F.col("l_iv").alias("a"), F.col("r_iv").alias("b")), "grid-pairs")
    return pairs.select("a", "b")


def _least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id each row and column is connected with, given who is linked with whom."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right, top).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], top).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def compare_blocks(pairs: DataFrame, blocks: DataFrame, cosine: float) -> DataFrame:
    """``node links root`` of the linked vectors of each pair of blocks."""
    cells = ["nodes", "copies", "raw"]
    left = blocks.select(F.col("pos").alias("l"), F.col("dim").alias("d"), *[F.col(c).alias(f"l_{c}") for c in cells])
    right = blocks.select(F.col("pos").alias("r"), *[F.col(c).alias(f"r_{c}") for c in cells])
    joined = pairs.join(left, F.col("a") == F.col("l")).join(right, F.col("b") == F.col("r")).select(
        "a", "b", "d", *[f"{s}_{c}" for s in "lr" for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids, copies, vectors = ([np.frombuffer(at[f"{s}_{c}"], kind) for s in "lr"] for c, kind in (
                    ("nodes", np.int64), ("copies", np.int64), ("raw", np.float64)))
                units = [unit(v.reshape(-1, at["d"])) for v in vectors]
                linked = units[0] @ units[1].T >= cosine
                alone = at["a"] == at["b"]
                if alone:
                    np.fill_diagonal(linked, False)
                rows, columns = linked.any(axis=1), linked.any(axis=0)
                if not rows.any():
                    continue
                linked = linked[np.ix_(rows, columns)]
                roots = _least_linked(linked, ids[0][rows], ids[1][columns])
                links = linked @ copies[1][columns], linked.T @ copies[0][rows]
                used = [(ids[0][rows], links[0], roots[0]), (ids[1][columns], links[1], roots[1])]
                if alone:
                    used = [(used[0][0], links[0], np.minimum(*roots))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*used, strict=True)], names=["node", "links", "root"])

    return joined.mapInArrow(run, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                           cosine: float = COSINE) -> DataFrame:
    """``vec_id n_links component_id kept`` of every row."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialise(nodes_of(vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                                               F.col(f"`{embedding}`").alias("embedding"))), "grid-rows")
    nodes = materialise(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "grid-nodes")
    plain = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    dim = nodes.agg(F.max(F.size("raw"))).first()[0]
    if dim is None:
        return rows.select("vec_id", *plain)
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    axes = principal_axes(nodes, dim, min(AXES, dim))
    k = axes.shape[1]
    with batch_rows(spark, BLOCK):
        cut = materialise(blocks_of(grid_ordered(nodes, axes, epsilon), k), "grid-blocks")
    # from 0, so that all blocks lie in interval 0 of the top level
    place = materialise(with_rank(cut.select("part", "seq"), ["part", "seq"], "pos").withColumn("pos", F.col("pos") - 1), "grid-positions")
    blocks = materialise(cut.join(place.withColumnsRenamed({"part": "p", "seq": "s"}), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))), "grid-placed")
    pairs = interval_pairs(blocks.drop("nodes", "copies", "raw"), k, epsilon)
    with batch_rows(spark, 4):
        found = materialise(compare_blocks(pairs, blocks, cosine), "grid-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "grid-components")
    joined = nodes.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").select(
        "node", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    joined = materialise(joined, "grid-joined")
    smallest = joined.groupBy(F.col("root").alias("q")).agg(F.min("least").alias("component_id"))
    told = materialise(joined.join(smallest, F.col("root") == F.col("q")).select(F.col("node").alias("n"), "n_links", "component_id"), "grid-told")
    linked = rows.where("node IS NOT NULL").join(told, F.col("node") == F.col("n")).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", same(F.col("vec_id"), F.col("component_id")).alias("kept"))
    return linked.unionByName(rows.where("node IS NULL").select("vec_id", *plain))
