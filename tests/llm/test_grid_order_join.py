import math

import numpy as np
import pytest

from baitlens.llm import grid_order_join as g
from baitlens.llm import queries


def brute(rows):
    """Links and components by all pairs, by position."""
    n = len(rows)
    units = []
    for _, label, v in rows:
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(g.unit(np.array([v], float))[0] if good else None)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]):
                if float(units[i] @ units[j]) >= g.COSINE:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if units[i] is not None else r[0]
        out.append((r[0], links[i], component, r[0] == component))
    return sorted(map(str, out))


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[i % 12] * rng.uniform(0.1, 50) if i % 3 else rng.normal(size=dim) * 3
        rows.append((i, int(rng.integers(0, 3)), (v + rng.normal(size=dim) * (0.06 if i % 3 else 0)).astype(np.float32).tolist()))
    return rows


EDGES = [(900, None, [1.0] * 16), (901, 1, None), (902, 1, []), (903, 1, [0.0] * 16), (904, 1, [float("nan")] * 16),
         (905, 1, [float("inf")] + [1.0] * 15), (906, 1, [None] + [1.0] * 15), (907, 2, [1e30] * 16), (908, 2, [1e-30] * 16),
         (909, 2, [1.0, 2.0]), (910, 2, [1.0, 2.0]), (910, 2, [1.0, 2.0]), (None, 2, [1.0, 2.0]), (None, 0, [5.0] * 16), (None, None, None)]


@pytest.mark.parametrize("block, fan, axes", [(1024, 8, 6), (16, 2, 3), (7, 3, 1)])
def test_links_equal_brute_force(spark, monkeypatch, block, fan, axes):
    monkeypatch.setattr(g, "BLOCK", block)
    monkeypatch.setattr(g, "FAN", fan)
    monkeypatch.setattr(g, "AXES", axes)
    rows = vectors(5, 300) + EDGES + vectors(5, 20)[:4]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = g.near_duplicate_vectors(frame).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_far_blocks_are_skipped(spark):
    """Two clouds far apart: no pair of blocks joins them."""
    boxes = spark.createDataFrame([(i, "l", 2, float(i % 2) * 5, float(i % 2) * 5 + 0.1) for i in range(20)], "pos long, label string, dim int, lo0 double, hi0 double")
    pairs = {tuple(r) for r in g.interval_pairs(boxes, 1, 0.2).collect()}
    assert pairs == {(a, b) for a in range(20) for b in range(a, 20) if a % 2 == b % 2}


@pytest.mark.parametrize("blocks", [7, 8, 9, 64])
def test_number_of_blocks_is_a_power_of_fan(spark, monkeypatch, blocks):
    """All vectors of the label link: none may be lost with the last block."""
    monkeypatch.setattr(g, "BLOCK", 2)
    counted = []

    def seen(boxes, k, epsilon, pairs=g.interval_pairs):
        counted.append(boxes.count())
        return pairs(boxes, k, epsilon)

    monkeypatch.setattr(g, "interval_pairs", seen)
    n = 2 * blocks
    rows = [(i, 1, [1.0, i * 1e-3, 0.0]) for i in range(n)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(1)
    got = sorted(tuple(r) for r in g.near_duplicate_vectors(frame).collect())
    assert counted == [blocks] and g.FAN == 8
    assert got == [(i, n - 1, 0, i == 0) for i in range(n)]


def test_empty_extra_columns_and_unlinked(spark):
    schema = "vec_id long, label int, embedding array<float>, node string, kept string, n_links string"
    assert g.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 1, None, "a", "b", "c"), (2, None, [1.0], "a", "b", "c")]
    assert sorted(map(tuple, g.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op4_grid_order_join(spark, sf).collect()) == brute(rows)
