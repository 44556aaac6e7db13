import math

import numpy as np
import pytest

from baitlens.llm import metric_tree_search as m
from baitlens.llm import queries
from baitlens.session import materialise

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=m.BEST, every=m.EVERY):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v in good]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    points = {(i, tuple(math.floor(1024 * float(np.float32(c))) for c in v)) for i, v in good if len(v) == dim}
    out = []
    for i, q in points:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in points if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def clusters(seed, n, dim=8, centres=12, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, (middle[i % centres] * rng.uniform(0.5, 2) + rng.normal(size=dim) * spread).astype(np.float32).tolist()) for i in range(n)]


def told(frame, **kw):
    return sorted(map(tuple, m.top_k(frame, **kw).collect()))


EDGES = [(5000, None), (5001, []), (5002, [float("nan")] * 8), (5100, [float("inf")] + [1.0] * 7), (5200, [None] + [1.0] * 7), (5300, [1.0, 2.0]),
         (None, [9.0] * 8), (5400, [0.0] * 8), (5500, [0.5] * 8), (5500, [0.5] * 8), (5500, [0.25] * 8), (5501, [0.5] * 8)]


@pytest.mark.parametrize("capacity, fan, block, width", [(512, 32, 1024, 4), (8, 2, 3, 1), (16, 4, 1024, 2), (1, 2, 5, 4)])
def test_equals_brute_force(spark, monkeypatch, capacity, fan, block, width):
    for name, value in (("RINGS", 1), ("CAPACITY", capacity), ("FAN", fan), ("BLOCK", block), ("WIDTH", width)):
        monkeypatch.setattr(m, name, value)
    rows = clusters(1, 120) + EDGES
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert told(frame, every=20) == brute(rows, every=20)


def test_ties_and_many_copies(spark, monkeypatch):
    """A third of all rows is one vector; equal scores go to the smaller ids, also across pages."""
    monkeypatch.setattr(m, "CAPACITY", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 90, 3)] + [(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(90) if i % 3]
    assert told(spark.createDataFrame(rows, SCHEMA), every=10) == brute(rows, every=10)


def test_components_that_doubles_do_not_hold(spark, monkeypatch):
    monkeypatch.setattr(m, "CAPACITY", 4)
    rows = [(i, [float(2 ** 17 + 3 * i), float(i % 7), -float(2 ** 16)]) for i in range(30)]
    assert told(spark.createDataFrame(rows, SCHEMA), every=10) == brute(rows, every=10)


def test_few_rows_no_queries_empty_and_clashing_columns(spark):
    clash = spark.createDataFrame([(100, [1.0, 2.0], "a", "b"), (1, [3.0, 4.0], "a", "b")], SCHEMA + ", id string, grp string")
    assert told(clash) == [(100, 1, 1, 11 * 1024 * 1024)]
    for rows in ([], [(1, [1.0])], [(100, [1.0])], [(100, None)]):
        got = m.top_k(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_pages_keep_their_bounds_and_spare_products(spark, monkeypatch):
    """Radii cover all points below, parent distances are true, and a search by the stored bounds computes few products."""
    monkeypatch.setattr(m, "CAPACITY", 16)
    monkeypatch.setattr(m, "RINGS", 1)
    monkeypatch.setattr(m, "FAN", 8)
    rows = clusters(2, 600, dim=4, centres=20, spread=0.01)
    points = materialise(m.points_of(m.whole_vectors(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding"), 3), "t")
    space = m.measured(points, 4)
    pages = [r.asDict() for r in m.build(points, space).pages.collect()]
    by = {}
    for p in pages:
        by.setdefault(p["grp"], []).append({k: bytes(v) if isinstance(v, bytearray) else v for k, v in p.items()})
    assert sum(p["m"] for p in pages if p["leaf"]) == points.count() and all(p["m"] <= 16 for p in pages)

    def below(grp):
        return np.vstack([space.vectors(p["x"]) if p["leaf"] else np.vstack([below(int(c)) for c in np.frombuffer(p["ids"], np.int64)]) for p in by[grp]])

    for p in (p for g in by for p in by[g] if not p["leaf"]):
        objects = space.vectors(p["x"])
        for o, child, radius in zip(objects, np.frombuffer(p["ids"], np.int64), np.frombuffer(p["radius"]), strict=True):
            assert space.distances(below(int(child)), o[None]).max() <= radius + 1e-3
            for q in by[int(child)]:
                assert np.abs(space.distances(space.vectors(q["x"]), o[None])[:, 0] - np.frombuffer(q["away"])).max() < 1e-3
    # one query, node by node, best bound first
    q = space.vectors(by[m.ROOT][0]["x"])[:1]
    queue, best, products = [(float("inf"), m.ROOT, float("nan"))], [], 0
    while queue and (len(best) < 3 or max(queue)[0] >= best[-1][0]):
        _, grp, away = queue.pop(queue.index(max(queue)))
        floor = best[-1][0] if len(best) == 3 else -2 ** 63
        block = {"q": q.tobytes(), "qid": np.array([1]).tobytes(), "own": np.array([-1]).tobytes(), "floor": np.array([floor]).tobytes(), "away": np.array([away]).tobytes()}
        for p in by[grp]:
            found, count = m.look(p, block, space, 3)
            products += count
            queue += [(b, int(c), a) for c, b, a in zip(found[1], found[2], found[3], strict=True) if c >= 0]
            best = sorted(best + [(int(s), int(i)) for c, s, i in zip(found[1], found[4], found[5], strict=True) if c < 0], key=lambda t: (-t[0], t[1]))[:3]
    scores = sorted((-int(s) for s in (below(m.ROOT) @ q[0])))[:3]
    assert [-s for s, _ in best] == scores and products < 300


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op13_metric_tree_search(spark, sf).collect())) == brute(rows)
