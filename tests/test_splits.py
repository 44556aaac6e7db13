"""Splits, order helpers and folds: exact sizes, whole groups, skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitlens.operators import ordering as od
from baitlens.operators import splits as sp
from baitlens.session import checkpoint_dir, scratch_path


def test_rank_with_hot_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 3).alias("g"))
    rows = od.with_rank(df, ["k", "id"], "r", total="n").collect()
    assert [r["r"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))] == list(range(1, 1001))
    assert {r["n"] for r in rows} == {1000}
    grouped = od.with_rank(df, ["k", "id"], "r", ["g"]).collect()
    for g in range(3):
        part = sorted((r for r in grouped if r["g"] == g), key=lambda r: (r["k"], r["id"]))
        assert [r["r"] for r in part] == list(range(1, len(part) + 1))


def test_running_sums_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    weights = rng.integers(0, 9, 500)
    df = spark.createDataFrame([(int(v), int(w)) for v, w in zip(values, weights)], "v int, w int")
    out = od.with_running_sums(df, [F.desc("v")], {"s": "w"}, next_of=["w"], totals={"t": "w"}).orderBy(F.desc("v")).collect()
    order = weights[np.argsort(-values)]
    assert [r["s"] for r in out] == order.cumsum().tolist()
    assert [r["next_w"] for r in out] == order[1:].tolist() + [None]
    assert {r["t"] for r in out} == {int(weights.sum())}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(x)) for g in ("a", "b") for x in np.round(rng.normal(size=301), 1)]
    data += [("c", 5.0), ("d", None), ("a", float("nan"))]
    table = spark.createDataFrame(data, "g string, x double")
    found = {r["g"]: r for r in od.exact_quantiles(table, "x", [0.0, 0.25, 0.5, 0.9], ["g"]).collect()}
    for g in ("a", "b"):
        xs = [x for k, x in data if k == g and x == x]
        assert [found[g][f"q{i}"] for i in range(4)] == pytest.approx(np.quantile(xs, [0, 0.25, 0.5, 0.9]).tolist())
    assert found["c"]["q3"] == 5.0 and "d" not in found


def test_quantile_brackets(spark, monkeypatch):
    """Small sketches: the bracket path on many rows, and the full order where a bracket misses."""
    rng = np.random.default_rng(3)
    xs = np.where(rng.random(4000) < 0.4, 7.0, np.round(rng.normal(size=4000), 3))
    table = spark.createDataFrame([(float(x),) for x in xs], "x double")
    want = np.quantile(xs, [0.001, 0.25, 0.5, 0.999]).tolist()
    for accuracy in (100, 3):
        monkeypatch.setattr(od, "SKETCH_ACCURACY", accuracy)
        row = od.exact_quantiles(table, "x", [0.001, 0.25, 0.5, 0.999]).first()
        assert list(row) == pytest.approx(want)
    monkeypatch.setattr(od, "_bracketed", lambda clean, qs, names: clean.groupBy(*names).agg(
        *[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(qs))]))
    assert list(od.exact_quantiles(table, "x", [0.001, 0.25, 0.5, 0.999]).first()) == pytest.approx(want)


def test_stratified_split_sizes(spark):
    df = spark.range(200).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    counts = {(r["label"], r["split"]): r["n"] for r in sp.stratified_split(df, "id", "label").groupBy("label", "split").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {(0, "train"): 126, (0, "val"): 27, (0, "test"): 27, (1, "train"): 14, (1, "val"): 3, (1, "test"): 3}
    again = sp.stratified_split(df, "id", "label").exceptAll(sp.stratified_split(df, "id", "label"))
    assert again.count() == 0


def test_group_folds_balance_and_integrity(spark):
    df = spark.range(600).withColumn("g", F.when(F.col("id") < 200, "hot").otherwise((F.col("id") % 37).cast("string")))
    folded = sp.group_folds(df, "g", 3)
    assert folded.count() == 600
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert [r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).orderBy("fold").collect()] == pytest.approx([200] * 3, abs=12)


def plain_greedy(sizes, k):
    """Folds of ``{name: size}`` by the plain rule, group by group."""
    loads, found = [0] * k, {}
    for name, size in sorted(sizes.items(), key=lambda g: (-g[1], g[0])):
        fold = loads.index(min(loads))
        loads[fold] += size
        found[name] = fold
    return found


@pytest.mark.parametrize("seed, groups, most, k", [(1, 40, 3, 2), (2, 2000, 9, 2), (3, 700, 1, 5), (4, 60, 400, 7), (5, 3, 5, 5)])
def test_group_folds_equal_the_plain_greedy(spark, seed, groups, most, k):
    """Sizes with many repeats, a group with a third of all rows, more folds than groups."""
    rng = np.random.default_rng(seed)
    sizes = {f"g{i}": int(n) for i, n in enumerate(rng.integers(1, most + 1, groups))}
    sizes["g0"] = max(1, sum(sizes.values()) // 2)
    df = spark.createDataFrame(list(sizes.items()), "g string, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    folded = sp.group_folds(df, "g", k)
    assert {r["g"]: r["fold"] for r in folded.select("g", "fold").distinct().collect()} == plain_greedy(sizes, k)
    assert folded.count() == sum(sizes.values())


def test_a_hundred_thousand_groups_equal_the_plain_greedy(spark):
    df = spark.range(100_000).select(F.col("id").cast("string").alias("g"), F.explode(F.sequence(F.lit(1), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int") + 1)).alias("i"))
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r["g"]: r["fold"] for r in sp.group_folds(df, "g", 5).select("g", "fold").distinct().collect()} == plain_greedy(sizes, 5)


def test_dealing_in_closed_form():
    rng = np.random.default_rng(6)
    for _ in range(300):
        k, step, items = int(rng.integers(1, 6)), int(rng.integers(1, 5)), int(rng.integers(1, 40))
        start = rng.integers(0, 20, k).tolist()
        ties = rng.permutation(k).tolist()
        phases, got = sp._dealt(start, ties, step, items)
        loads, picks = list(start), []
        for _ in range(items):
            picks.append(min(range(k), key=lambda f: (loads[f], ties[f])))
            loads[picks[-1]] += step
        ends = [first for first, _ in phases[1:]] + [items]
        assert [turn[i % len(turn)] for (first, turn), end in zip(phases, ends) for i in range(end - first)] == picks
        assert [x + n * step for x, n in zip(start, got)] == loads


def plain_stratified(vectors, k):
    """Folds of ``[(name, counts)]``, taken in the given order, by standard deviations of shares over all folds and strata."""
    totals = np.sum([v for _, v in vectors], axis=0)
    held, found = np.zeros((k, len(totals))), {}
    for name, v in vectors:
        best = None
        for fold in range(k):
            held[fold] += v
            key = (round(float(np.mean(np.std(held / totals, axis=0))), 12), held[fold].sum() - sum(v), fold)
            held[fold] -= v
            best = key if best is None or key < best else best
        held[best[2]] += v
        found[name] = best[2]
    return found, held


@pytest.mark.parametrize("seed, groups, strata, k", [(1, 300, 3, 4), (2, 120, 5, 3), (3, 50, 2, 5)])
def test_stratified_group_folds_are_as_even_as_the_plain_greedy(spark, seed, groups, strata, k):
    rng = np.random.default_rng(seed)
    rows = [(f"g{g}", f"s{s}") for g in range(groups) for s in range(strata) for _ in range(int(rng.integers(0, 3)))]
    rows += [("g1", "s0")] * 40 + [(None, "s1")] * 3 + [("g2", None)] * 2
    folded = sp.stratified_group_folds(spark.createDataFrame(rows, "g string, s string"), "g", "s", k)
    got = folded.collect()
    assert len(got) == len(rows)
    fold = {r["g"]: r["fold"] for r in got}
    assert all(fold[r["g"]] == r["fold"] for r in got)
    names = [None, *sorted({s for _, s in rows if s is not None})]
    vectors = {g: [sum(1 for x, y in rows if x == g and y == s) for s in names] for g in fold}
    import hashlib

    def place(g):
        v, name = vectors[g], "\0null" if g is None else g
        parts = [(i, n) for i, n in enumerate(v) if n]
        return -(len(v) * sum(n * n for n in v) - sum(v) ** 2), parts, hashlib.md5(f"42|{name}".encode()).hexdigest(), name

    want, _ = plain_stratified([(g, vectors[g]) for g in sorted(vectors, key=place)], k)
    assert fold == want


def test_many_strata_are_no_limit(spark):
    df = spark.range(1200).select((F.col("id") % 400).cast("string").alias("g"), (F.col("id") % 300).cast("string").alias("s"))
    folded = sp.stratified_group_folds(df, "g", "s", 4)
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert [r["count"] for r in folded.groupBy("fold").count().collect()] == [300] * 4


def test_stratified_group_folds(spark):
    df = spark.range(900).select("id", (F.col("id") / 9).cast("int").alias("g"), F.when(F.col("id") % 5 == 0, "p").otherwise("n").alias("s"))
    folded = sp.stratified_group_folds(df, "g", "s", 3)
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    shares = [r["share"] for r in folded.groupBy("fold").agg(F.avg((F.col("s") == "p").cast("int")).alias("share")).collect()]
    assert shares == pytest.approx([0.2] * 3, abs=0.03)


def test_time_series_folds(spark):
    rows = sp.time_series_folds(spark.range(10), "id", 3).collect()
    tests = {f: sorted(r["id"] for r in rows if r["fold"] == f and r["role"] == "test") for f in range(3)}
    trains = {f: sorted(r["id"] for r in rows if r["fold"] == f and r["role"] == "train") for f in range(3)}
    assert tests == {0: [4, 5], 1: [6, 7], 2: [8, 9]}
    assert trains == {0: list(range(4)), 1: list(range(6)), 2: list(range(8))}


def test_quartiles_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, None if i == 9 else "2024-01-01 00:00:00") for i in range(10)], "id int, t string").select(
        "id", F.col("t").cast("timestamp_ntz").alias("ts"))
    found = {r["id"]: r["quartile"] for r in sp.temporal_quartiles(df, "ts", "id").collect()}
    assert [found[i] for i in range(10)] == ["Q1", "Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4", None]


def test_campaign_ids_follow_first_row(spark):
    df = spark.createDataFrame([(3, "b"), (1, "z"), (2, "a"), (4, "z"), (5, None)], "id int, g string")
    assert {r["id"]: r["campaign_id"] for r in sp.campaign_ids(df, "g", "id").collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 3}


def test_scratch_below_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_null_groups_get_a_fold_and_no_row_is_lost(spark):
    from baitlens.operators import splits

    rows = [(i, None if i % 4 == 0 else f"g{i % 13}", i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, grp string, label int")
    for folded in (splits.group_folds(df, "grp"), splits.stratified_group_folds(df, "grp", "label")):
        found = folded.collect()
        assert len(found) == 100 and len({r["fold"] for r in found if r["grp"] is None}) == 1
