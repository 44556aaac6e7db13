"""Curve, metrics and thresholds against brute force over raw rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitlens.operators import curve as cv
from baitlens.operators import metrics as mt
from baitlens.operators import thresholds as th

CASES = {
    "ties": ([0, 0, 1, 1, 0, 1, 1, 0], [0.1, 0.4, 0.4, 0.8, 0.8, 0.9, 0.35, 0.2]),
    "perfect": ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]),
    "constant": ([0, 1, 1, 0], [0.5, 0.5, 0.5, 0.5]),
    "ends": ([0, 1, 0, 1], [0.0, 1.0, 1.0, 0.0]),
}


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = [(m, int(y), float(p)) for m, (ys, ps) in CASES.items() for y, p in zip(ys, ps)]
    ys = rng.integers(0, 2, 400)
    rows += [("random", int(y), float(np.clip(round(0.3 * y + 0.6 * rng.random(), 2), 0, 1))) for y in ys]
    return spark.createDataFrame(rows, "model string, label int, score double").cache()


def arrays(scored, model):
    rows = scored.where(F.col("model") == model).collect()
    return np.array([r["label"] for r in rows]), np.array([r["score"] for r in rows])


def pair_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])


def average_precision(y, p):
    total, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (hit & (y == 1)).sum() / (y == 1).sum()
        total += (recall - before) * ((hit & (y == 1)).sum() / hit.sum())
        before = recall
    return total


def test_ranking_metrics(scored):
    rows = {r["model"]: r for r in mt.ranking_metrics(cv.score_curve(scored, ["model"]), ["model"], 0.05).collect()}
    for model in [*CASES, "random"]:
        y, p = arrays(scored, model)
        assert rows[model]["roc_auc"] == pytest.approx(pair_auc(y, p))
        assert rows[model]["pr_auc"] == pytest.approx(average_precision(y, p))


def test_one_class(spark):
    only = spark.createDataFrame([(1, 0.2), (1, 0.7)], "label int, score double")
    row = mt.ranking_metrics(cv.score_curve(only)).first()
    assert row["roc_auc"] == 0.0 and row["recall_at_fpr_interp"] is None
    assert mt.fold_metrics(only.withColumn("fold", F.lit(0))).first()["roc_auc"] is None


def test_corners_drop_collinear_points(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    curve = cv.score_curve(spark.createDataFrame(rows, "label int, score double"))
    kept = [r["threshold"] for r in cv.roc_points(curve).orderBy(F.desc_nulls_first("threshold")).collect()]
    assert kept == [None, 0.9, 0.7, 0.5, 0.4]
    assert cv.roc_points(curve, drop_collinear=False).count() == 7


def confusion_at(y, p, t):
    hit = p >= t
    return (hit & (y == 1)).sum(), (hit & (y == 0)).sum(), (~hit & (y == 0)).sum(), (~hit & (y == 1)).sum()


def test_grid_confusion(scored):
    grid = [0.0, 0.35, 0.5, 0.8, 1.0]
    table = cv.grid_confusion(cv.score_counts(scored, ["model"]), cv.literal_grid(grid), ["model"]).collect()
    for r in table:
        y, p = arrays(scored, r["model"])
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == confusion_at(y, p, r["threshold"])
    assert len(table) == 5 * 5


def test_best_f1(scored):
    found = {r["model"]: r for r in th.best_f1_threshold(scored, ["model"]).collect()}
    for model in [*CASES, "random"]:
        y, p = arrays(scored, model)
        best = (-1.0, 0.5)
        for t in [*sorted(set(p)), 1.0]:
            tp, fp, tn, fn = confusion_at(y, p, t)
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            if f1 > best[0]:
                best = (f1, t)
        assert (found[model]["f1"], found[model]["threshold"]) == pytest.approx(best)


def test_precision_floor_fallback(scored):
    found = {r["model"]: r for r in th.precision_floor_threshold(scored, ["model"], 0.999).collect()}
    assert found["constant"]["strategy"] == "max_precision_fallback" and found["constant"]["threshold"] == 1.0
    assert found["perfect"]["strategy"] == "precision_floor" and found["perfect"]["threshold"] == 0.8


def test_fpr_targeted(scored):
    found = {r["model"]: r for r in th.fpr_targeted_threshold(scored, ["model"], 0.1).collect()}
    for model, row in found.items():
        y, p = arrays(scored, model)
        tp, fp, tn, fn = confusion_at(y, p, row["threshold"])
        assert row["recall"] == pytest.approx(tp / (tp + fn))
        assert row["strategy"] == "min_fpr_fallback" or fp / (fp + tn) <= 0.1 + 1e-9
    allowed = [confusion_at(*arrays(scored, "random"), t) for t in np.linspace(0, 1, 101)]
    assert found["random"]["recall"] >= max(tp / (tp + fn) for tp, fp, tn, fn in allowed if fp / (fp + tn) <= 0.1)


def test_cost_guard(scored):
    found = {r["model"]: r for r in th.cost_guarded_threshold(scored, ["model"], 0.003).collect()}
    assert found["perfect"]["threshold"] == 0.8
    assert found["constant"]["threshold_fpr"] is None
    assert found["constant"]["threshold"] == pytest.approx(0.01)


@pytest.mark.parametrize("x", [0.0, 1e-300, 0.1, 0.25, 0.5, 0.7, 0.9999999, 1.0])
def test_next_after(one, x):
    assert one(x, th.next_after(F.col("v")), kind="double") == math.nextafter(x, 1.0)


def test_recall_at_precision(scored):
    found = {r["model"]: r for r in th.recall_at_precision(scored, ["model"], 0.9).collect()}
    assert tuple(found["constant"])[1:] == (1.0, 0.0, 1.0)
    assert (found["perfect"]["threshold"], found["perfect"]["recall"]) == (0.8, 1.0)


def test_preferred_model():
    assert th.preferred_model(["RF", "LR"]) == "LR"
    assert th.preferred_model(["Z", "A"]) == "A"


def test_calibration_ignores_zero(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 0.1), (0, 1.0)], "label int, score double")
    row = mt.calibration_error(rows).first()
    assert row["ece"] == pytest.approx((0.9 + 1.0) / 3) and row["mce"] == pytest.approx(1.0)
    assert [tuple(r) for r in mt.reliability_curve(rows).select("bin", "n").orderBy("bin").collect()] == [(1, 2), (10, 1)]


def test_bootstrap_contains_estimate_and_repeats(scored):
    rows = scored.where("model = 'random'")
    first = {r["metric"]: r for r in mt.bootstrap_ci(rows, 0.5, 0.1, 60).collect()}
    again = {r["metric"]: r for r in mt.bootstrap_ci(rows, 0.5, 0.1, 60).collect()}
    point = mt.metrics_row(rows, 0.5, target_fpr=0.1).first()
    for name in ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1"):
        assert first[name]["ci_low"] <= point[name] <= first[name]["ci_high"]
        assert first[name]["mean"] == again[name]["mean"] and first[name]["n_boot"] == 60


def test_quality_grade(spark):
    rows = spark.createDataFrame([(0.96, 0.91, 0.97), (0.9, 0.85, 0.9), (0.85, 0.85, 0.5), (0.1, 0.1, 0.1)],
                                 "recall double, precision double, roc_auc double")
    graded = [tuple(r) for r in mt.quality_grade(rows).select("quality_points", "quality_grade").collect()]
    assert graded == [(7, "PRODUCTION READY"), (4, "GOOD MODEL"), (2, "NEEDS IMPROVEMENT"), (0, "POOR PERFORMANCE")]


def test_bootstrap_does_not_depend_on_the_layout(spark):
    from baitlens.operators.metrics import bootstrap_ci

    rows = [(i % 97 / 97, int(i * 7 % 11 < 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "score double, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out.append({r["metric"]: (round(r["mean"], 9), round(r["ci_low"], 9), round(r["ci_high"], 9)) for r in bootstrap_ci(df, n_boot=60).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
