"""The score curve: one row per distinct score with running counts. Every ranking metric derives from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_running_sums


def score_counts(scored: DataFrame, group_by: Sequence[str] = (), score: str = "score",
                 label: str = "label") -> DataFrame:
    """Rows per distinct score: positives and negatives (merged before the shuffle)."""
    positive = F.col(label) == 1
    return (
        scored.where(F.col(score).isNotNull()).groupBy(*group_by, F.col(score).alias("score"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )


def score_curve(scored: DataFrame, group_by: Sequence[str] = (), score: str = "score",
                label: str = "label") -> DataFrame:
    """``score pos neg tp fp n_pos n_neg corner``: counts at or above each distinct score, highest first.

    ``corner`` marks the points a ROC curve keeps when collinear points are dropped.
    """
    counts = score_counts(scored, group_by, score, label)
    summed = with_running_sums(
        counts, [F.desc("score")], {"tp": "pos", "fp": "neg"}, group_by, next_of=["pos", "neg"],
        totals={"n_pos": "pos", "n_neg": "neg"},
    )
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return summed.withColumn("corner", first | last | bend).drop("next_pos", "next_neg")


def share(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def with_rates(curve: DataFrame) -> DataFrame:
    return curve.withColumns({
        "fpr": share(F.col("fp"), F.col("n_neg")),
        "tpr": share(F.col("tp"), F.col("n_pos")),
    })


def roc_points(curve: DataFrame, group_by: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """``threshold fpr tpr`` with the origin at an infinite threshold, stored as null."""
    points = with_rates(curve.where("corner") if drop_collinear else curve)
    origin = curve.select(*group_by).distinct() if group_by else curve.agg(F.count("*")).select()
    origin = origin.select(
        *group_by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.select(*group_by, F.col("score").alias("threshold"), "fpr", "tpr").unionByName(origin)


def pr_points(curve: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """``threshold precision recall`` for every distinct score."""
    return curve.select(
        *group_by, F.col("score").alias("threshold"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("n_pos")).alias("recall"),
    )


def linspace(start: Column, stop: Column, n: int) -> Column:
    """Array of n evenly spaced values, both ends included."""
    step = (stop - start) / F.lit(float(n - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, stop).otherwise(i * step + start)
    )


def grid_confusion(counts: DataFrame, grid: Column, group_by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at every threshold of an ascending grid (a bounded array column), in one pass.

    A score is counted once, in the slot of the highest threshold it reaches; the slots are then summed.
    """
    slotted = counts.withColumn("_grid", grid).withColumn(
        "_slot", F.size(F.filter("_grid", lambda g: g <= F.col("score")))
    )
    per_slot = slotted.groupBy(*group_by, "_slot").agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), F.first("_grid").alias("_grid")
    )
    per_group = per_slot.groupBy(*group_by).agg(
        F.collect_list(F.struct("_slot", "_pos", "_neg")).alias("_slots"), F.first("_grid").alias("_grid"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
    )

    def above(field: str) -> Column:
        reached = F.filter("_slots", lambda s: s["_slot"] > F.col("_index"))
        return F.aggregate(F.transform(reached, lambda s: s[field]), F.lit(0).cast("bigint"), lambda a, x: a + x)

    return (
        per_group.select("*", F.posexplode("_grid").alias("_index", "threshold"))
        .withColumns({"tp": above("_pos"), "fp": above("_neg")})
        .withColumns({"fn": F.col("n_pos") - F.col("tp"), "tn": F.col("n_neg") - F.col("fp")})
        .select(*group_by, F.col("_index").alias("grid_index"), "threshold", "tp", "fp", "tn", "fn")
    )


def literal_grid(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# --- area under ROC without a curve: whole tables of distinct scores ---------------------------------------

#: Rows of a group and class that a task sorts at once, and rows that a range of scores is meant to have.
HELD_SCORES = 1 << 20


def packed_scores(values: np.ndarray) -> bytes:
    """Distinct values and how often they occur; steps between sorted values, alike bytes side by side, compress well."""
    distinct, counts = np.unique(values + 0.0, return_counts=True)  # a negative zero is zero
    bits = distinct.view(np.uint64)
    steps = bits - np.concatenate([bits[:0], np.zeros(min(1, len(bits)), np.uint64), bits[:-1]])
    halves = (steps.view(np.uint8).reshape(-1, 8), counts.astype(np.uint32).view(np.uint8).reshape(-1, 4))
    alike = b"".join(h.T.tobytes() for h in halves)
    return len(distinct).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(alike, asbytes=True)


def unpacked_scores(blobs: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values of all blobs and their counts; those of a blob are distinct and sorted."""
    values, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        data = np.frombuffer(pa.decompress(blob[8:], 12 * n, "zstd"), np.uint8)
        steps = np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
        values.append(np.cumsum(steps, dtype=np.uint64).view(np.float64))
        counts.append(np.ascontiguousarray(data[8 * n:].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64))
    return np.concatenate(values), np.concatenate(counts)


def _by_range(values: np.ndarray, kind: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """The scores of both classes between two edges each, packed."""
    sides = [np.sort(values[kind == k]) for k in (1, 0)]
    cuts = [[0, *np.searchsorted(side, edges), len(side)] for side in sides]
    for r in range(len(edges) + 1):
        pos, neg = (side[cut[r]: cut[r + 1]] for side, cut in zip(sides, cuts, strict=True))
        # the first range stands for a group whose rows are in neither class
        if len(pos) or len(neg) or not r:
            yield r, packed_scores(pos), packed_scores(neg)


def _kind(label: str) -> Column:
    positive = F.col(label) == 1
    # a row without a label is in neither class
    return F.coalesce(F.when(positive, 1).when(~positive, 0), F.lit(2)).cast("byte")


def _range_schema(group: str) -> pa.Schema:
    return pa.schema([(group, pa.string()), ("range", pa.int32()), ("pos", pa.binary()), ("neg", pa.binary())])


def packed_ranges(scored: DataFrame, group: str, bounds: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """``group range pos neg``: the scores of both classes between two bounds, packed inside the tasks."""
    edges, schema = np.array(bounds, np.float64), _range_schema(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}

        def flush(name) -> pa.RecordBatch:
            values, kind = (np.concatenate(c) for c in zip(*held.pop(name), strict=True))
            rows = [(name, *r) for r in _by_range(values, kind, edges)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes, values, kind = names.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for code, name in enumerate(names.dictionary.to_pylist()):
                here = codes == code
                held.setdefault(name, []).append((values[here], kind[here]))
                if sum(len(v) for v, _ in held[name]) >= HELD_SCORES:
                    yield flush(name)
        for name in list(held):
            yield flush(name)

    rows = scored.where(F.col(score).isNotNull()).select(F.col(group).cast("string"), F.col(score).cast("double"), _kind(label))
    return rows.mapInArrow(run, f"`{group}` string, range int, pos binary, neg binary")


def packed_columns(scored: DataFrame, scores: dict[str, str], group: str, bounds: Sequence[float], label: str = "label") -> DataFrame:
    """The same for scores that stand side by side: ``scores`` names the column of each group."""
    edges, schema = np.array(bounds, np.float64), _range_schema(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            kind = np.concatenate([b.column(0).to_numpy() for b in held])
            for i, name in enumerate(scores):
                there = np.concatenate([b.column(i + 1).is_valid().to_numpy(zero_copy_only=False) for b in held])
                values = np.concatenate([b.column(i + 1).to_numpy(zero_copy_only=False) for b in held])
                if there.any():
                    rows = [(name, *r) for r in _by_range(values[there], kind[there], edges)]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD_SCORES:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    rows = scored.select(_kind(label).alias("_kind"), *[F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(scores.values())])
    return rows.mapInArrow(run, f"`{group}` string, range int, pos binary, neg binary")


def range_areas(ranges: DataFrame, group: str) -> DataFrame:
    """``group roc_auc``: area under ROC, ties halved, from :func:`packed_ranges`; 0 with one class only."""
    def inside(table: pa.Table) -> pa.Table:
        pos, n_pos = unpacked_scores(table.column("pos").to_pylist())
        neg, n_neg = unpacked_scores(table.column("neg").to_pylist())
        order = np.argsort(neg, kind="stable")  # sorted runs, which are merged
        neg, below = neg[order], np.concatenate([[0], np.cumsum(n_neg[order])])
        # twice the pairs in order, so that halves are whole
        twice = n_pos * (below[np.searchsorted(neg, pos)] + below[np.searchsorted(neg, pos, "right")])
        row = {group: table.column(group)[0].as_py(), "range": table.column("range")[0].as_py(),
               "n_pos": int(n_pos.sum()), "n_neg": int(n_neg.sum()), "twice": int(twice.sum())}
        return pa.Table.from_pylist([row], pa.schema([(group, pa.string()), ("range", pa.int32())] + [(c, pa.int64()) for c in ("n_pos", "n_neg", "twice")]))

    counted = ranges.groupBy(group, "range").applyInArrow(inside, f"`{group}` string, range int, n_pos long, n_neg long, twice long")
    lower = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("twice") / 2 + F.col("n_pos") * F.coalesce(F.sum("n_neg").over(lower), F.lit(0))
    return counted.withColumn("_pairs", pairs).groupBy(group).agg(
        share(F.sum("_pairs"), F.sum("n_pos") * F.sum("n_neg")).alias("roc_auc"))
