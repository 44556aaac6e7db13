import math

import numpy as np
import pytest

from baitlens.llm import embedding_whitening as w
from baitlens.llm import queries

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=w.COMPONENTS):
    """Ids, deviations, whitened rows and shares by a full decomposition in whole-number centred form."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in good]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    good = [(i, v) for i, v in good if len(v) == dim]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    away = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[a / n for a in r] for r in away])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:components] > values[0] * w.RANK).sum()) if values[0] > 0 else 0
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in good], [sum(a * a for a in r) for r in away], white, values[:k] / values.sum()


def check(rows, got):
    ids, away, white, share = brute(rows)
    k = white.shape[1]
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c in by:
        # the driver may return the rows in any order: deviations and ids go with the whitened values
        mine = sorted((r["vec_id"], r["deviation"], round(r["whitened"], 6)) for r in by[c])
        matches = [sorted((i, d, round(s * float(v), 6) + 0.0) for i, d, v in zip(ids, away, white[:, c - 1], strict=True)) for s in (1, -1)]
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 for a, b in zip(mine, m, strict=True)) for m in matches)
        assert abs(by[c][0]["explained"] / share[c - 1] - 1) < 1e-9
    assert all(r["identity_error"] <= 1e-9 for r in got)


def vectors(seed, n, dim, decay=0.9):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return [(i, (rng.normal(size=dim) * decay ** np.arange(dim) @ turn).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, dim, block", [(400, 48, 1 << 17), (300, 12, 84), (40, 60, 960), (5, 3, 1 << 17)])
def test_equals_a_full_decomposition(spark, monkeypatch, n, dim, block):
    monkeypatch.setattr(w, "BLOCK", block)
    rows = vectors(3, n, dim)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(rows, w.whiten(frame).collect())


def test_rows_that_are_dropped_and_repeated(spark):
    rows = vectors(4, 60, 6) + [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6),
                                (104, [float("inf")] + [0.0] * 5), (105, [1.0, 2.0]), (7, [0.5] * 6), (7, [0.5] * 6)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("component", w.F.lit("mine")).repartition(2)
    check(rows, w.whiten(frame).collect())
    alone = w.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0])], SCHEMA)).collect()
    assert len(alone) == 2 and {r["vec_id"] for r in alone} == {None, 1} and sorted(round(r["whitened"], 9) for r in alone) == [-1.0, 1.0]


def test_degenerate_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = w.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_very_large_components(spark):
    """Whole numbers beyond what n * x holds: exact arithmetic, deviations beyond a long are null."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.0])]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA), components=1).collect()
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["vec_id"])][:2] == [None, None] and len(got) == 3


def test_filter_damps_the_unwanted_interval():
    values = np.array([10.0, 9.0, 4.0, 3.0, 2.0])
    q = np.eye(5)
    out = np.diag(w.filtered(lambda m: values[:, None] * m, q, values[:, None] * q, 1.5, 4.0, 10.0, 8))
    assert abs(out[0] - 1) < 1e-9 and abs(out[1]) > 0.1 and np.abs(out[2:]).max() < 1e-4


def test_bounds_enclose_the_spectrum():
    values = np.linspace(3, 50, 40)
    low, high = w.spectrum_bounds(lambda m: values[:, None] * m, 40, np.random.default_rng(0))
    assert low <= 3 and high >= 50


def test_query_equals_a_full_decomposition(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op12_embedding_whitening(spark, sf).collect())
