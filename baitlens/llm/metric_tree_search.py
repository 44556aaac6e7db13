"""Exact top-k search by inner product with a paged M-tree, best first.

Components become whole numbers, floor(1024 * c). With M the largest norm, a vector x is the point (x, sqrt(M^2 - |x|^2)) and a
query q is (q, 0): the nearest points have the largest inner products, so that a metric tree answers the search.

Build: from the root down, a bounded number of a node's points, drawn by hash, become routing objects; every point goes to the
nearest one; children above a few pages are split again. A page is a row: of routing objects, each with its covering radius and
its distance to the parent's routing object, or of points with that distance, by which a node's few pages of points are cut. All pages are Spark tables, written to
the shared folder. Equal vectors are one point that keeps its k + 1 smallest ids, all that can ever be told of them.

Search: every query has a queue of nodes with upper bounds of their scores, in one table. A wave takes each query's best open
nodes (more in each wave), packs queries that visit the same node into blocks, joins them with the page and scores what the
stored bounds don't exclude: where |d(q, p) - d(x, p)| - r already shows that an entry can't reach the query's k-th score,
nothing is computed for it. Children return to the queue, points to the query's k best; a search ends when no open node
can reach the k-th score. Nothing is approximate: scores are whole numbers, bounds are widened by more than rounding, ties are visited.

Defined results: vectors that are null, empty or hold null or non-finite components, rows without an id, and vectors whose length
is not the commonest (of equally common ones the largest) take no part. Rows of equal id and vector count once; rows that share
the query's id are the query's own. Components beyond 2**52 / 1024 count as that bound, and scores beyond a long as the largest
long. An empty table, or one without queries, gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_rank
from ..session import broadcast_if_small, materialise
from .common import bounded_batches, by_shuffle
from .grid_order_join import batch_rows

SCALE, LARGEST, BEST, EVERY = 1024, 2.0 ** 52, 10, 100
#: Points in a page, pages of a node that is not split again, children of a node, rounds of splitting, queries in a block.
CAPACITY, RINGS, FAN, LEVELS, BLOCK = 1024, 4, 64, 9, 1024
#: Nodes that a query visits in the first wave, and how much more in each later one.
WIDTH, WIDER = 2, 8
#: Rounding of distances, as a share of M.
SLACK = 1e-7
ROOT = 1
PAGE = "grp long, leaf boolean, m int, x binary, radius binary, away binary, ids binary, sizes binary"


@dataclass(frozen=True)
class Space:
    """What all pages share: dimensions, M^2, and whether doubles hold every inner product exactly."""

    dim: int
    top: float
    exact: bool

    def vectors(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, np.int64).reshape(-1, self.dim)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products as longs."""
        if self.exact:
            return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
        limit = 2 ** 63 - 1
        return np.clip(a.astype(object) @ b.T.astype(object), -limit, limit).astype(np.int64).reshape(len(a), len(b))

    def height(self, x: np.ndarray) -> np.ndarray:
        """The coordinate that lifts a vector to norm M."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Between points of the tree."""
        inner = a.astype(np.float64) @ b.T.astype(np.float64) + np.outer(self.height(a), self.height(b))
        return np.sqrt(np.maximum(2 * self.top - 2 * inner, 0))


@dataclass(frozen=True)
class Tree:
    pages: DataFrame
    space: Space


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``id dim x``: usable vectors as whole numbers, 8 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v").cast(pa.list_(pa.float64()))
            lengths = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = np.flatnonzero((lengths > 0) & (bad[ends] == bad[ends - lengths]))
            whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * SCALE), -LARGEST, LARGEST).astype(np.int64)
            cells = [whole[ends[i] - lengths[i]: ends[i]].tobytes() for i in usable]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(usable)), pa.array(lengths[usable], pa.int32()), pa.array(cells, pa.binary())],
                                             names=["id", "dim", "x"])

    chosen = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("v")).where("id IS NOT NULL")
    return chosen.mapInArrow(run, "id long, dim int, x binary")


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """``x ids``: each vector once, with its k + 1 smallest ids as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(i, np.int64).tobytes() for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(ids, pa.binary())], names=["x", "ids"])

    first = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    kept = rows.select("x", "id").distinct().withColumn("at", first).where(F.col("at") <= k + 1)
    return kept.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).mapInArrow(run, "x binary, ids binary")


def measured(points: DataFrame, dim: int) -> Space:
    """Largest norm and component: one number each from every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = most = 0.0
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, dim).astype(np.float64)
            if len(v):
                norm, most = max(norm, float((v * v).sum(axis=1).max())), max(most, float(np.abs(v).max()))
        yield pa.RecordBatch.from_pydict({"norm": [norm], "most": [most]})

    got = points.select("x").mapInArrow(run, "norm double, most double").agg(F.max("norm").alias("norm"), F.max("most").alias("most")).first()
    return Space(dim, got["norm"], got["most"] ** 2 * dim < 2 ** 53)


def packed(rows: DataFrame, order: Sequence[str], fixed: Sequence[str], blobs: Sequence[str], most: int) -> DataFrame:
    """Runs of at most ``most`` rows of one ``grp`` as bytes: numbers by 8 each, blobs one after another with their ``sizes``."""
    cells = [*fixed, *blobs, "sizes"]

    def bytes_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset: column.offset + len(column) + 1]
        return (data.to_pybytes()[at[0]:at[-1]] if data else b""), np.diff(at).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        grp, m = None, 0

        def flush() -> pa.RecordBatch:
            row = [pa.array([grp], pa.int64()), pa.array([m], pa.int32()), *[pa.array([b"".join(held[c])], pa.binary()) for c in cells]]
            return pa.RecordBatch.from_arrays(row, names=["grp", "m", *cells])

        for batch in batches:
            groups = batch.column("grp").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]]) if len(groups) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                while a < b:
                    if m and (grp != groups[a] or m >= most):
                        yield flush()
                        m = 0
                    if not m:
                        grp, held = int(groups[a]), {c: [] for c in cells}
                    piece = batch.slice(a, min(b - a, most - m))
                    for c in fixed:
                        held[c].append(piece.column(c).to_numpy(zero_copy_only=False).tobytes())
                    for c in blobs:
                        data, sizes = bytes_of(piece.column(c))
                        held[c].append(data)
                    held["sizes"].append(sizes.tobytes())
                    m += piece.num_rows
                    a += piece.num_rows
        if m:
            yield flush()

    ordered = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    return ordered.select("grp", *fixed, *blobs).mapInArrow(run, "grp long, m int, " + ", ".join(f"{c} binary" for c in cells))


def routing_objects(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """``grp xs aways``: up to FAN points of each group that is to be split, drawn by hash, at least two."""
    fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(1.5 * F.col("n") / CAPACITY)))
    large = sizes.where(F.col("n") > CAPACITY * RINGS).select(F.col("grp").alias("g"), "n")
    draw = F.pmod(F.xxhash64("x"), F.lit(1 << 40)).alias("draw")
    few = points.select("grp", "x", "away", draw).join(broadcast_if_small(large), F.col("grp") == F.col("g")).where(
        F.col("draw") < F.lit(4.0 * (1 << 40)) * fan / F.col("n"))
    ranked = few.withColumn("at", F.row_number().over(Window.partitionBy("grp").orderBy("draw", "x"))).where(F.col("at") <= fan)
    listed = ranked.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("at", "x", "away"))).alias("all"))
    return listed.where(F.size("all") > 1).select("grp", F.col("all.x").alias("xs"), F.col("all.away").alias("aways"))


def assigned(blocks: DataFrame, routes: DataFrame, space: Space) -> DataFrame:
    """Every point of the blocks with the nearest routing object's child as ``grp`` and the distance as ``away``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                x, c = space.vectors(at["x"]), space.vectors(b"".join(at["xs"]))
                d = space.distances(x, c)
                near = d.argmin(axis=1)
                ends = np.concatenate([[0], np.cumsum(np.frombuffer(at["sizes"], np.int32))]).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(at["grp"] * FAN + near.astype(np.int64)), pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array([at["ids"][a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(d[np.arange(len(x)), near])],
                    names=["grp", "x", "ids", "away"])

    right = by_shuffle(routes.select(F.col("grp").alias("g"), "xs"))
    return blocks.join(right, F.col("grp") == F.col("g")).select("grp", "x", "ids", "sizes", "xs").mapInArrow(run, "grp long, x binary, ids binary, away double")


def node_pages(routes: DataFrame, children: DataFrame) -> DataFrame:
    """Pages of routing objects: each child that has points, with its covering radius and its distance to the parent's object."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, entries in zip(batch.column("grp").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{
                    "grp": grp, "leaf": False, "m": len(entries), "x": b"".join(e["x"] for e in entries),
                    "ids": np.array([e["child"] for e in entries], np.int64).tobytes(), "sizes": np.full(len(entries), 8, np.int32).tobytes(),
                    "radius": np.array([e["radius"] for e in entries]).tobytes(), "away": np.array([e["away"] for e in entries]).tobytes()}], arrow)

    arrow = pa.schema([("grp", pa.int64()), ("leaf", pa.bool_()), ("m", pa.int32()), *[(c, pa.binary()) for c in ("x", "radius", "away", "ids", "sizes")]])
    entries = routes.select("grp", F.posexplode(F.arrays_zip("xs", "aways")).alias("k", "e")).select(
        "grp", (F.col("grp") * FAN + F.col("k")).alias("child"), F.col("e.xs").alias("x"), F.col("e.aways").alias("away"))
    known = entries.join(by_shuffle(children.select(F.col("grp").alias("g"), "radius")), F.col("child") == F.col("g"))
    return known.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("child", "x", "away", "radius"))).alias("entries")).mapInArrow(run, PAGE)


def build(points: DataFrame, space: Space) -> Tree:
    """The tree over ``x ids``; a level is a few joins and one shuffle of the points that are still to be split."""
    spark = points.sparkSession
    now = points.select(F.lit(ROOT).cast("long").alias("grp"), "x", "ids", F.lit(0.0).alias("away"))
    sizes = materialise(now.groupBy("grp").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "mtree-sizes")
    pages = []
    for level in range(LEVELS + 1):
        routes = materialise(routing_objects(now, sizes), "mtree-routes")
        split = broadcast_if_small(routes.select(F.col("grp").alias("g")))
        if level == LEVELS or routes.isEmpty():
            settled, routes = now, None
        else:
            settled = now.join(split, F.col("grp") == F.col("g"), "left_anti")
        leaves = packed(settled, ["away"], ["away"], ["x", "ids"], CAPACITY)
        pages.append(leaves.select("grp", F.lit(True).alias("leaf"), "m", "x", F.lit(b"").alias("radius"), "away", "ids", "sizes"))
        if routes is None:
            break
        blocks = materialise(packed(now.join(split, F.col("grp") == F.col("g"), "left_semi"), ["away"], [], ["x", "ids"], BLOCK), "mtree-blocks")
        with batch_rows(spark, 4):
            now = materialise(assigned(blocks, routes, space), "mtree-points")
        sizes = materialise(now.groupBy("grp").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "mtree-sizes")
        pages.append(node_pages(routes, sizes))
    whole = pages[0]
    for page in pages[1:]:
        whole = whole.unionByName(page)
    return Tree(materialise(whole, "mtree-pages"), space)


def look(page: dict, block: dict, space: Space, k: int) -> tuple[list[np.ndarray], int]:
    """What a block of queries finds on a page, as columns ``qid child bound away score id``, and how many products it took."""
    x, q = space.vectors(page["x"]), space.vectors(block["q"])
    qid, own, floor, to_parent = (np.frombuffer(block[c], t) for c, t in (("qid", np.int64), ("own", np.int64), ("floor", np.int64), ("away", np.float64)))
    away = np.frombuffer(page["away"])
    radius = np.zeros(len(x)) if page["leaf"] else np.frombuffer(page["radius"])
    qf = q.astype(np.float64)
    norm = (qf * qf).sum(axis=1)
    slack = 1 + 1e-9 * (norm + space.top)
    thin = SLACK * np.sqrt(space.top + norm)

    # by stored distances alone; the root has no parent
    near = np.abs(to_parent[:, None] - away[None, :]) - radius[None, :] - thin[:, None]
    near = np.maximum(np.nan_to_num(near, nan=0.0), 0)
    open_ = ((norm + space.top)[:, None] - near ** 2) / 2 + slack[:, None] >= floor[:, None]
    rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    nothing = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.float64, np.int64, np.int64)]
    if not len(rows):
        return nothing, 0
    score = space.products(q[rows], x[columns])
    open_ = open_[np.ix_(rows, columns)]
    ids = np.frombuffer(page["ids"], np.int64)
    if not page["leaf"]:
        inner = score.astype(np.float64)
        d = np.sqrt(np.maximum((norm[rows] + space.top)[:, None] - 2 * inner, 0))
        near = np.maximum(d - radius[columns] - thin[rows][:, None], 0)
        bound = ((norm[rows] + space.top)[:, None] - near ** 2) / 2
        bound = np.minimum(bound, inner + np.sqrt(norm[rows])[:, None] * (radius[columns] + thin[rows][:, None])) + slack[rows][:, None]
        r, c = np.nonzero(open_ & (bound >= floor[rows][:, None]))
        return [qid[rows][r], ids[columns][c], bound[r, c], d[r, c], np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)], score.size
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(page["sizes"], np.int32) // 8)])
    told = []
    for r in range(len(rows)):
        at = np.flatnonzero(open_[r] & (score[r] >= floor[rows[r]]))
        if len(at) > k + 1:
            # the k + 1 best and all that tie with the last of them
            least = np.partition(score[r][at], len(at) - k - 1)[len(at) - k - 1]
            at = at[score[r][at] >= least]
        found = [(-int(score[r][c]), i) for c in at.tolist() for i in ids[ends[columns[c]]:ends[columns[c] + 1]].tolist() if i != own[rows[r]]]
        told += [(int(qid[rows[r]]), -s, i) for s, i in sorted(found)[:k]]
    if not told:
        return nothing, score.size
    qids, scores, found = (np.array(t, np.int64) for t in zip(*told, strict=True))
    return [qids, np.full(len(qids), -1), np.zeros(len(qids)), np.zeros(len(qids)), scores, found], score.size


def visited(pairs: DataFrame, tree: Tree, k: int) -> DataFrame:
    """``qid child bound away score id`` that the queries of ``grp qid q own floor away`` find on their nodes' pages."""
    space, names = tree.space, ["qid", "child", "bound", "away", "score", "id"]
    blocks = packed(pairs, ["qid"], ["qid", "own", "floor", "away"], ["q"], BLOCK).withColumnsRenamed({"grp": "g", "away": "to_parent", "sizes": "ends"})
    joined = by_shuffle(blocks).join(by_shuffle(tree.pages), F.col("g") == F.col("grp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                block = {"q": at["q"], "qid": at["qid"], "own": at["own"], "floor": at["floor"], "away": at["to_parent"]}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in look(at, block, space, k)[0]], names=names)

    return joined.select("q", "qid", "own", "floor", "to_parent", "leaf", "x", "radius", "away", "ids", "sizes").mapInArrow(
        run, "qid long, child long, bound double, away double, score long, id long")


def search(queries: DataFrame, tree: Tree, k: int = BEST) -> DataFrame:
    """``qid score id rank`` of the k best for queries ``qid own q``, in waves of best-first visits."""
    spark = queries.sparkSession
    nowhere = F.lit(float("nan"))
    queue = materialise(queries.select("qid", F.lit(ROOT).cast("long").alias("grp"), F.lit(float("inf")).alias("bound"), nowhere.alias("away")), "mtree-queue")
    best = materialise(spark.createDataFrame([], "qid long, score long, id long, rank int"), "mtree-best")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "grp"))
    width = WIDTH
    while True:
        floors = best.where(F.col("rank") == k).select(F.col("qid").alias("f"), F.col("score").alias("floor"))
        left = queue.join(floors, F.col("qid") == F.col("f"), "left").where("floor IS NULL OR bound >= floor").drop("f")
        left = materialise(left.withColumn("turn", order), "mtree-queue")
        if left.isEmpty():
            return best
        first = left.where(F.col("turn") <= width).select(F.col("qid").alias("f"), "grp", "away", F.coalesce("floor", F.lit(-2 ** 63)).alias("floor"))
        pairs = materialise(first.join(queries, F.col("f") == F.col("qid")).drop("f"), "mtree-pairs")
        with batch_rows(spark, 4):
            found = materialise(visited(pairs, tree, k), "mtree-found")
        both = best.drop("rank").unionByName(found.where("child < 0").select("qid", "score", "id"))
        best = materialise(both.withColumn("rank", rank).where(F.col("rank") <= k), "mtree-best")
        queue = left.where(F.col("turn") > width).select("qid", "grp", "bound", "away").unionByName(
            found.where("child >= 0").select("qid", F.col("child").alias("grp"), "bound", "away"))
        width *= WIDER


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = BEST, every: int = EVERY) -> DataFrame:
    """``query_id rank vec_id score``: the k largest inner products of each row whose id is divisible by ``every`` with all others."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialise(whole_vectors(vectors, vec_id, embedding), "mtree-rows")
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return nothing
    rows = rows.where(F.col("dim") == lengths["dim"])
    asked = rows.where(F.col("id") % every == 0).select("id", "x").distinct()
    if asked.isEmpty():
        return nothing
    points = materialise(points_of(rows, k), "mtree-points")
    tree = build(points, measured(points, lengths["dim"]))
    queries = materialise(with_rank(asked, ["id", "x"], "qid").select("qid", F.col("id").alias("own"), F.col("x").alias("q")), "mtree-queries")
    best = search(queries, tree, k)
    return best.join(queries.select(F.col("qid").alias("f"), "own"), F.col("f") == F.col("qid")).select(
        F.col("own").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLE = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= {BEST}
"""
