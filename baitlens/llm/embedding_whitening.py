"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Every remaining component c becomes the whole number floor(1024 * c) + 100000; vectors are packed into blocks of rows once.
The covariance is never formed: a pass multiplies the centred rows of every block with a small matrix Q and sums
X'(X Q) over the blocks (partial sums in the tasks, one more level of sums, then a matrix of dimensions x columns on the
driver). A few Lanczos steps bound the spectrum. Each round runs the Chebyshev recurrence with such passes, which damps
everything between the lower bound and the least Ritz value of the block; QR and Rayleigh-Ritz follow. Rounds end when the
residuals of all wanted components are certified to lie at the rounding of the passes; a run that cannot be certified
raises an error.

Defined results: a vector that is null, empty, or holds null or non-finite components is dropped; so is one whose length is
not the commonest (of equally common ones the largest). Components beyond 2**52 / 1024 count as that bound. Where the
covariance has fewer than ``components`` eigenvalues above rounding, only those are returned (none for a single vector, or
for copies of one). ``deviation`` is null where it exceeds a long. Rows without an id and repeated rows are rows of their
own; an empty table gives an empty result; other columns are left alone. The sign of a component makes its largest entry
positive.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches
from .grid_order_join import batch_rows

COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0 ** 52
#: Columns iterated besides the wanted ones, degree of the filter, Lanczos steps, rounds until the run is given up.
BUFFER, DEGREE, LANCZOS, ROUNDS = 24, 10, 10, 200
#: Residuals, as shares of the largest eigenvalue: where rounds end, and what must be reached.
AIM, CERTIFIED = 1e-14, 1e-11
#: Components in a block of rows (one row at least); eigenvalues below this share of the largest are rounding.
BLOCK, RANK = 1 << 17, 1e-12


@dataclass(frozen=True)
class Whitening:
    """What is fitted: of the order of dimensions x components, whatever the number of rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def packed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Blocks ``dim rows ids x``: whole-number vectors of one length as bytes, with their ids."""
    kind = vectors.schema[vec_id].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("rows", T.LongType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, x = zip(*held.pop(dim), strict=True)
            ids, x = pa.concat_arrays(ids), np.vstack(x)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), lists,
                                               pa.array([x.tobytes()], pa.binary())], names=["dim", "rows", "ids", "x"])

        for batch in batches:
            column = batch.column("v").cast(pa.list_(pa.float64()))
            lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = (lengths > 0) & (bad[starts[1:]] == bad[starts[:-1]])
            whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            for dim in np.unique(lengths[usable]).tolist():
                rows, most = np.flatnonzero(usable & (lengths == dim)), max(1, BLOCK // dim)
                for i in range(0, len(rows), most):
                    some = rows[i:i + most]
                    held.setdefault(dim, []).append((batch.column("id").take(pa.array(some)), whole[starts[some][:, None] + np.arange(dim)]))
                    if sum(len(p[0]) for p in held[dim]) >= most:
                        yield flush(dim)
        for dim in [*held]:
            yield flush(dim)

    return vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("v")).mapInArrow(run, schema)


def matrix(block: dict) -> np.ndarray:
    return np.frombuffer(block["x"], np.int64).reshape(block["rows"], block["dim"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, subtracted in whole numbers wherever they hold it."""
    if sums.dtype == object:
        return ((x.astype(object) * n - sums) / n).astype(np.float64)
    return (x * n - sums) / n


def whole(n: int, sums: list[int], low: list[int], high: list[int]) -> np.ndarray:
    """The sums as longs where n * x and n * x - S fit into a long for every x, else as Python's whole numbers."""
    worst = max(max(abs(n * x), abs(n * x - s)) for s, a, b in zip(sums, low, high, strict=True) for x in (a, b))
    return np.array(sums, np.int64 if worst < 2 ** 62 else object)


def over_blocks(blocks: DataFrame, part: Callable[[dict], object], merge: Callable[[object, object], object]) -> object:
    """``part`` of every block, merged in the tasks, then in the root of as many tasks, then here; None without blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                got = part({c: batch.column(c)[row].as_py() for c in ("dim", "rows", "x")})
                total = got if total is None else merge(total, got)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([pickle.dumps(total)], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted, so that a rerun adds in the same order
        for i, g in enumerate(sorted(g for batch in batches for g in batch.column("g").to_pylist())):
            total = pickle.loads(g) if not i else merge(total, pickle.loads(g))
        if "total" in locals():
            yield pa.RecordBatch.from_pydict({"g": pa.array([pickle.dumps(total)], pa.binary())})

    parts = blocks.select("dim", "rows", "x").mapInArrow(run, "g binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 32:
        parts = parts.repartition(int(tasks ** 0.5) + 1, F.xxhash64("g")).mapInArrow(summed, "g binary")
    total = None
    for g in sorted(bytes(r["g"]) for r in parts.toLocalIterator()):
        total = pickle.loads(g) if total is None else merge(total, pickle.loads(g))
    return total


def _moments(block: dict) -> tuple[int, list[int], list[int], list[int]]:
    x = matrix(block)
    safe = np.abs(x).max() < 2 ** 62 // max(len(x), 1)
    return len(x), (x if safe else x.astype(object)).sum(axis=0).tolist(), x.min(axis=0).tolist(), x.max(axis=0).tolist()


def _merged_moments(a: tuple, b: tuple) -> tuple:
    return (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)], [min(p) for p in zip(a[2], b[2], strict=True)],
            [max(p) for p in zip(a[3], b[3], strict=True)])


def operator(blocks: DataFrame, n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Q -> V Q by one pass over the blocks, V the covariance that is never formed."""
    def multiply(q: np.ndarray) -> np.ndarray:
        def part(block: dict) -> np.ndarray:
            x = centred(matrix(block), n, sums)
            return x.T @ (x @ q)

        return over_blocks(blocks, part, np.add) / n

    return multiply


def spectrum_bounds(apply: Callable, dim: int, rng: np.random.Generator) -> tuple[float, float]:
    """Bounds of the eigenvalues from a few Lanczos steps; the last off-diagonal widens them."""
    q = rng.normal(size=(dim, 1))
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(LANCZOS, dim)):
        w = apply(basis[-1])
        alphas.append(float((w * basis[-1]).sum()))
        known = np.hstack(basis)
        w = w - known @ (known.T @ w)
        w = w - known @ (known.T @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= RANK * max(alphas):
            break
        basis.append(w / betas[-1])
    steps = len(alphas)
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[: steps - 1], 1) + np.diag(betas[: steps - 1], -1))
    return max(0.0, ritz[0] - betas[-1]), ritz[-1] + betas[-1]


def filtered(apply: Callable, q: np.ndarray, vq: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev recurrence: a polynomial that is small on [low, cut] and grows beyond; ``vq`` is V q."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    before, now = q, (vq - middle * q) * (first / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - sigma)
        before, now = now, 2 * (then / half) * (apply(now) - middle * now) - sigma * then * before
        sigma = then
    return now


def rayleigh_ritz(apply: Callable, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), vectors and V times the vectors, inside the span of the columns."""
    q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
    q = np.linalg.qr(q)[0]
    vq = apply(q)
    inner = q.T @ vq
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    return values[::-1], q @ turn[:, ::-1], vq @ turn[:, ::-1]


def fit(blocks: DataFrame, components: int = COMPONENTS, seed: int = 0) -> Whitening | None:
    """Leading eigenpairs of the covariance of the blocks' rows, certified by their residuals."""
    found = over_blocks(blocks, _moments, _merged_moments)
    if found is None:
        return None
    n, totals, low, high = found
    sums, dim = whole(n, totals, low, high), len(totals)
    counted = 0

    raw = operator(blocks, n, sums)

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal counted
        counted += 1
        return raw(q)

    trace = over_blocks(blocks, lambda b: float((centred(matrix(b), n, sums) ** 2).sum()), lambda a, b: a + b) / n
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, counted)
    rng = np.random.default_rng(seed)
    wanted, width = min(components, dim), min(dim, components + BUFFER)
    lower, _ = spectrum_bounds(apply, dim, rng) if width < dim else (0.0, 0.0)
    values, q, vq = rayleigh_ritz(apply, rng.normal(size=(dim, width)))
    before = np.inf
    for _ in range(ROUNDS):
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        done = residual <= AIM or (residual <= CERTIFIED / 10 and residual > before / 4)
        if done or width == dim and before < np.inf:
            break
        before = residual
        # all of the span for a whole basis: one more Rayleigh-Ritz only polishes it
        cut = max(values[-1], values[0] * RANK)
        step = q if width == dim or cut >= values[0] * (1 - RANK) else filtered(apply, q, vq, min(lower, cut * (1 - 1e-6)), cut, values[0], DEGREE)
        values, q, vq = rayleigh_ritz(apply, step)
    if residual > CERTIFIED:
        raise RuntimeError(f"residual {residual:.1e} of the largest eigenvalue after {counted} passes; {CERTIFIED:.0e} is needed")
    kept = int((values[:wanted] > values[0] * RANK).sum())
    vectors = q[:, :kept] * np.where(q[np.abs(q[:, :kept]).argmax(axis=0), np.arange(kept)] < 0, -1, 1)
    return Whitening(n, sums, values[:kept], vectors, trace, float(residual), counted)


def projection(model: Whitening) -> np.ndarray:
    return model.vectors / np.sqrt(model.values)


def identity_error(blocks: DataFrame, model: Whitening) -> float:
    """Largest entry, in absolute value, of the whitened rows' covariance minus the identity."""
    turn, n, sums = projection(model), model.n, model.sums

    def part(block: dict) -> np.ndarray:
        y = np.hstack([centred(matrix(block), n, sums) @ turn, np.ones((block["rows"], 1))])
        return y.T @ y

    gram = over_blocks(blocks, part, np.add) / n
    mean = gram[:-1, -1]
    return float(np.abs(gram[:-1, :-1] - np.outer(mean, mean) - np.eye(len(mean))).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n x - S)**2, exactly; None beyond a long."""
    if sums.dtype != object:
        away = x * n - sums
        if float(np.abs(away).max()) ** 2 * x.shape[1] < 2 ** 62:
            return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - sums.astype(object)
    return [s if s < 2 ** 63 else None for s in (away * away).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error``: a row for each vector and component."""
    spark, kind = vectors.sparkSession, vectors.schema[vec_id].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *[T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    bounded_batches(spark)
    blocks = materialise(packed(vectors, vec_id, embedding), "whitening-blocks")
    lengths = blocks.groupBy("dim").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    blocks = blocks.where(F.col("dim") == lengths["dim"])
    with batch_rows(spark, 8):
        model = fit(blocks, components)
        n, sums, k = model.n, model.sums, len(model.values)
        error = identity_error(blocks, model) if k else 0.0
    turn, share = projection(model), model.values / model.trace if k else np.zeros(0)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row].as_py() for c in ("dim", "rows", "x")}
                x, rows = matrix(block), block["rows"]
                ids, of = batch.column("ids")[row].values, np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(of)), pa.array((centred(x, n, sums) @ turn).ravel()),
                    pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error))], names=names)

    return blocks.mapInArrow(run, schema)
