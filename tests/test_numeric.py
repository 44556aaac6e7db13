"""Profile, drift, vectors, robustness and explanation on small frames."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from baitlens.operators import curve as cv
from baitlens.operators import drift as dr
from baitlens.operators import exchange as xc
from baitlens.operators import explain as ex
from baitlens.operators import metrics as mt
from baitlens.operators import profile as pf
from baitlens.operators import robustness as rb
from baitlens.operators import schema as sh
from baitlens.operators import vectors as vc
from baitlens.operators.splits import class_weights


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(np.exp(2 * y)), 1.0, None if i % 10 == 0 else float(z), int(x > 0))
            for i, (x, y, z) in enumerate(rng.normal(size=(200, 3)))]
    return spark.createDataFrame(rows, "id int, plain double, heavy double, constant double, holes double, label int").cache()


def reference(values, bounds):
    """Independent numpy walk through the cleaning steps of one column."""
    x = np.array([np.nan if v is None else v for v in values], dtype=float)
    if bounds:
        x = np.clip(x, *bounds)
    ok = x[~np.isnan(x)]
    n, m = len(ok), ok.mean()
    skew = ((ok - m) ** 3).mean() / ((ok - m) ** 2).mean() ** 1.5 * np.sqrt(n * (n - 1)) / (n - 2)
    if abs(skew) > 1:
        x = np.log1p(x - ok.min() + 1.0)
    x = np.where(np.isnan(x), np.nanmedian(x), x)
    return (x - x.mean()) / x.std()


def test_profile_matches_numpy(spark, frame):
    profile = pf.fit_profile(frame, ["plain", "heavy", "constant", "holes"])
    assert profile.removed == ["constant"] and profile.order == ["plain", "heavy", "holes"]
    assert profile.columns["heavy"].log_min is not None and profile.columns["plain"].log_min is None
    out = pf.apply_profile(frame, profile, ["id"]).orderBy("id").collect()
    rows = frame.orderBy("id").collect()
    for c in profile.order:
        raw = [r[c] for r in rows]
        clean = [v for v in raw if v is not None]
        q1, q3 = np.quantile(clean, [0.25, 0.75])
        assert [r[c] for r in out] == pytest.approx(reference(raw, (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))).tolist(), abs=1e-9)
    again = pf.Profile.from_table(profile.to_table(spark))
    assert again == profile


def test_profile_edge_columns(spark):
    df = spark.createDataFrame([(1.0, None, float("inf"), 2.0)], "a double, nothing double, endless double, b double")
    profile = pf.fit_profile(df, ["a", "nothing", "endless", "b"])
    assert profile.order == [] and set(profile.removed) == {"a", "nothing", "endless", "b"}
    stats = {r["column"]: r["skew"] for r in pf.moments(spark.createDataFrame(
        [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, c double"), ["x", "c"]).collect()}
    assert stats["x"] == pytest.approx(1.763633, abs=1e-5) and stats["c"] is None


def test_refit_skew_uses_the_frame(frame):
    profile = pf.fit_profile(frame, ["heavy"])
    calm = frame.withColumn("heavy", F.col("plain") + 10)
    frozen = pf.apply_profile(calm, profile, scale=False).agg(F.max("heavy")).first()[0]
    refit = pf.apply_profile(calm, profile, scale=False, refit_skew=True).agg(F.max("heavy")).first()[0]
    assert frozen < 4 < refit


def test_clean_removes_copies_only_in_train(frame):
    doubled = frame.unionByName(frame)
    _, (train, other) = pf.clean(doubled, doubled, keep=["id"], columns=["plain"])
    assert (train.count(), other.count()) == (200, 400)


def test_robust_scale(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 2.0, 7.0), (3, 3.0, 7.0), (4, 4.0, None)], "id int, x double, c double")
    rows = pf.robust_scale(df, ["x", "c"], ["id"]).orderBy("id").collect()
    assert [r["x"] for r in rows] == pytest.approx([1 / 1.5, 2 / 1.5, 2.0, 4 / 1.5])
    assert [r["c"] for r in rows] == [7.0, 7.0, 7.0, 0.0]


def test_drift_against_itself_is_zero(frame):
    # quarters are exact in single precision, in which the baseline bins are kept
    frame = frame.withColumn("plain", F.floor(F.col("plain") * 4) / 4)
    baseline = dr.establish_baseline(frame, ["plain", "constant"])
    assert {round(r["psi"], 12) for r in dr.data_drift(baseline, frame).collect()} == {0.0}
    shares = dr.label_shares(frame, "label")
    assert dr.label_drift(shares, shares).first()[0] == pytest.approx(0.0, abs=1e-12)
    report = dr.drift_report(baseline, frame, shares, "label")
    assert dr.is_alert(report) is False
    row = report.first()
    assert row["accuracy_degradation"] is None and row["overall_drift_score"] == pytest.approx(0.0, abs=1e-9)


def test_histogram_edges_and_range(spark):
    base = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    baseline = dr.establish_baseline(base, ["x"])
    assert baseline.first()["counts"] == [1] * 9 + [2]
    moved = spark.createDataFrame([(-1.0,), (0.0,), (10.0,), (10.1,), (None,)], "x double")
    row = dr.data_drift(baseline, moved).first()
    assert row["out_of_range"] == 2 and row["drifted"]


def test_constant_feature_and_missing_class(spark):
    base = spark.createDataFrame([(5.0, "a"), (5.0, "b")], "x double, y string")
    row = dr.establish_baseline(base, ["x"]).first()
    assert sum(row["counts"]) == 2 and row["std"] == 1.0
    js = dr.label_drift(dr.label_shares(base, "y"), dr.label_shares(base.where("y = 'a'"), "y")).first()[0]
    p, q = np.array([0.5, 0.5]), np.array([1.0, 0.0]) + 1e-10
    m = (p + q) / 2
    assert js == pytest.approx(0.5 * (p * np.log(p / m)).sum() + 0.5 * (q * np.log(q / m)).sum(), abs=1e-8)


def test_mean_shift(frame):
    baseline = dr.establish_baseline(frame, ["plain"])
    row = dr.mean_shift(baseline, frame.withColumn("plain", F.col("plain") + 10)).first()
    assert row["shifted"] and row["z_score"] > 3


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4)], int(i < 20)) for i in range(120)]
    return spark.createDataFrame(rows, "id int, x array<double>, label int").cache()


def test_neighbours_are_exact_on_one_run(points):
    data = {r["id"]: np.array(r["x"]) for r in points.collect()}
    found = {}
    for r in vc.nearest_neighbours(points, "id", "x", 5).collect():
        found.setdefault(r["id"], set()).add(r["neighbour"])
    for i, x in data.items():
        order = sorted((np.linalg.norm(x - y), j) for j, y in data.items() if j != i)
        assert found[i] == {j for _, j in order[:5]}


def test_neighbours_in_bounded_runs(points):
    rows = vc.nearest_neighbours(points, "id", "x", 3, chunk_rows=32).collect()
    assert len(rows) == 120 * 3 and all(r["id"] != r["neighbour"] for r in rows)


def test_neighbours_are_exact_over_many_blocks(spark):
    """Clusters, copies and ties over blocks of 16 rows, string ids: the same neighbours as all pairs give."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 8)) * 4
    # eighths, so that equal distances are equal in floating point
    x = [np.round((centres[i % 5] + rng.normal(size=8) * 0.3) * 8) / 8 for i in range(300)]
    x += [x[0]] * 25 + [np.zeros(8)] * 3
    ids = [f"n{i:03d}" for i in range(len(x))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, x array<double>").repartition(3)
    got = {}
    for r in vc.nearest_neighbours(frame, "id", "x", 5, chunk_rows=16).orderBy("rank").collect():
        got.setdefault(r["id"], []).append((round(r["distance"], 9), r["neighbour"]))
    for i, v in zip(ids, x, strict=True):
        want = sorted((round(float(np.sqrt(((v - w) ** 2).sum())), 9), j) for j, w in zip(ids, x, strict=True) if j != i)[:5]
        assert sorted(got[i]) == want


def test_smote_balances(points):
    balanced = vc.smote(points, "id", "x", "label")
    counts = {(r["label"], r["synthetic"]): r["n"] for r in balanced.groupBy("label", "synthetic").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, False): 100, (1, False): 20, (1, True): 80}
    minority = np.array([r["x"] for r in points.where("label = 1").collect()])
    made = np.array([r["x"] for r in balanced.where("synthetic").collect()])
    assert (made >= minority.min(0) - 1e-9).all() and (made <= minority.max(0) + 1e-9).all()
    with pytest.raises(ValueError):
        vc.smote(points.where("label = 1"), "id", "x", "label")


def test_svd_matches_numpy(points):
    basis, values = vc.truncated_svd(points, "x", 2)
    matrix = np.array([r["x"] for r in points.collect()])
    assert values == pytest.approx(np.linalg.svd(matrix, compute_uv=False)[:2])
    projected = vc.project(points, "x", basis).orderBy("id").first()
    assert projected["svd"] == pytest.approx((matrix[0] @ basis).tolist())
    assert vc.unit_length(F.col("x")) is not None


def scorer(df):
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("url_entropy"))))


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(x > 0), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))]
    return spark.createDataFrame(rows, "id int, label int, url_entropy double, other double").cache()


def test_robustness_report(features):
    report = rb.robustness_report(features, ["url_entropy", "other"], scorer, "id")
    rows = {(r["suite"], r["perturbation"]): r for r in report["sweep"].collect()}
    assert rows["baseline", "none"]["accuracy"] == 1.0 and rows["baseline", "none"]["degradation"] == 0.0
    assert len(rows) == 1 + len(rb.DETERMINISTIC) + len(rb.random_suites("id", ["url_entropy", "other"]))
    assert report["temperature"].count() == 4 and report["threshold_sensitivity"].count() == 5
    assert {s for s, _ in rows} == {"baseline", "obfuscation", "temporal_drift", "multilingual", "domain_shift", "url_shorteners", "adversarial"}


def test_permutation_importance(features):
    rows = {r["feature"]: r for r in ex.permutation_importance(features, "id", ["url_entropy", "other"], scorer, repeats=4).collect()}
    assert rows["url_entropy"]["permutation_importance"] > 0.3
    assert rows["other"]["permutation_importance"] == pytest.approx(0.0, abs=1e-12)
    assert ex.permutation_importance(features, "id", ["url_entropy"], scorer, repeats=1, max_rows=40).count() == 1


def test_permutation_importance_in_parts(spark, monkeypatch):
    """Parts, buckets and ranges of scores give the plain rule's areas; only one repeat's scores are on disk at a time."""
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 12, size=(700, 2)) / 4 - 1.5
    labels = (cells[:, 0] + rng.normal(size=700) > 0).astype(int)
    rows = [(f"r{i:03d}", int(y), float(a), float(b)) for i, (y, (a, b)) in enumerate(zip(labels, cells, strict=True))]
    frame = spark.createDataFrame(rows, "id string, label int, url_entropy double, other double").repartition(5)
    monkeypatch.setattr(ex, "WHOLE_ROWS", 100)
    monkeypatch.setattr(ex, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ex, "HELD_SCORES", 150)
    monkeypatch.setattr(cv, "HELD_SCORES", 150)
    stored, most = [], []

    def materialise(df, name="step", compression=None, real=ex.materialise):
        stored.append(real(df, name, compression))
        most.append(sum(os.path.exists(f.inputFiles()[0].removeprefix("file:")) for f in stored if f.inputFiles()))
        return stored[-1]

    monkeypatch.setattr(ex, "materialise", materialise)

    def add(df):
        return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("url_entropy") + 0.1 * F.col("other")))))

    got = {r["feature"]: r for r in ex.permutation_importance(frame, "id", ["url_entropy", "other"], add, repeats=3).collect()}

    def area(entropy, other):
        score = 1 / (1 + np.exp(-(entropy + 0.1 * other)))
        pos, neg = score[labels == 1], score[labels == 0]
        return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))

    losses = {"url_entropy": [], "other": []}
    for rep in range(3):
        order = sorted(range(700), key=lambda i: hashlib.md5(f"42|{rep}|{rows[i][0]}".encode()).hexdigest())
        losses["url_entropy"].append(area(*cells.T) - area(cells[order, 0], cells[:, 1]))
        losses["other"].append(area(*cells.T) - area(cells[:, 0], cells[order, 1]))
    for name, values in losses.items():
        assert got[name]["permutation_importance"] == pytest.approx(np.mean(values), abs=2e-5)
        assert got[name]["permutation_std"] == pytest.approx(np.std(values), abs=2e-5)
        assert got[name]["repeats"] == 3
    assert max(most) <= ex.PARTS and len(stored) == 1 + 3 * ex.PARTS


def test_md5_words_are_the_digests():
    texts = ["", "|7", "|é–", *(f"|{i}" for i in range(9000)), *("|" + "x" * k for k in range(44, 70))]
    high, low = xc.md5_words(b"42|0", pa.array(texts)[1:])
    wanted = [hashlib.md5(("42|0" + t).encode()).hexdigest() for t in texts[1:]]
    assert [f"{int(h):016x}{int(x):016x}" for h, x in zip(high, low, strict=True)] == wanted


def test_shuffled_pairs_follow_the_keys(spark, monkeypatch):
    """Null and repeated ids, one more row than fits a pack, parts without rows: the rows meet as in a sort of the keys."""
    monkeypatch.setattr(xc, "PACKED_ROWS", 16)
    monkeypatch.setattr(xc, "DEALT_ROWS", 40)
    rows = [(None if i % 9 == 4 else f"r{i // 2}", i % 2, float(i), i + 1) for i in range(97)]
    frame = spark.createDataFrame(rows, "id string, label int, x double, _pos long").repartition(3)
    packed = xc.packed_table(frame, "id", ["label", "x"])
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    parts = [[tuple(r) for r in p.collect()] for p in xc.shuffled_pairs(packed, kinds, ["label", "x"], ["x"], 3, 42, len(rows), 10, 4)]
    order = sorted(rows, key=lambda r: (hashlib.md5(("42|3" + ("" if r[0] is None else f"|{r[0]}")).encode()).hexdigest(), r[3]))
    assert len(parts) == 4 and sorted(sum(parts, []), key=lambda r: r[1]) == [(r[1], r[2], d[2]) for r, d in zip(rows, order, strict=True)]


def test_permutation_importance_scores_a_row_once(spark):
    """Features are scored side by side; with more of them than stand in a row, each has a row. Both give the same."""
    names = [f"f{i}" for i in range(ex.SIDE_BY_SIDE + 1)]
    rng = np.random.default_rng(11)
    cells = rng.normal(size=(60, len(names)))
    rows = [(i, int(c[0] + c[1] > 0), *map(float, c)) for i, c in enumerate(cells)]
    frame = spark.createDataFrame(rows, "id int, label int, " + ", ".join(f"{c} double" for c in names))
    sizes = []

    def first_two(df):
        scored = df.withColumn("score", F.col("f0") + F.col("f1"))
        sizes.append(scored.columns.count("_feature"))
        return scored

    few, many = ({r["feature"]: r["permutation_importance"] for r in ex.permutation_importance(frame, "id", c, first_two, repeats=2).collect()}
                 for c in (names[:-1], names))
    assert sizes[:len(names) + 1].count(1) == 0 and 1 in sizes
    assert many == pytest.approx(few | {names[-1]: 0.0}, abs=1e-12)


def test_range_areas_edges(spark):
    """Ties across blocks, both zeros, missing scores and labels, one class only."""
    rows = [("a", s, y) for s, y in [(0.0, 1), (-0.0, 0), (0.5, 1), (0.5, 0), (2.0, 1), (-3.0, 0), (None, 1), (1.0, None)]]
    rows += [("b", 1.0, 1), ("b", 2.0, 1), ("c", float("nan"), 1), ("c", 5.0, 0), ("d", 1.0, None)]
    frame = spark.createDataFrame(rows, "g string, score double, label int").repartition(4)
    want = {r["g"]: r["roc_auc"] for r in mt.ranking_metrics(cv.score_curve(frame, ["g"]), ["g"]).collect()}
    for bounds in ([], [0.0], [-1.0, 0.5, 1.5]):
        got = dict(map(tuple, cv.range_areas(cv.packed_ranges(frame, "g", bounds), "g").collect()))
        assert got == want
    assert want == {"a": pytest.approx(7 / 9), "b": 0.0, "c": 1.0, "d": 0.0}


def test_explain_tables(spark, features):
    importance = spark.createDataFrame([("url_entropy", 1.0), ("other", 0.0)], "feature string, tree_importance double")
    attribution, merged, errors = ex.explain(features, "id", ["url_entropy", "other"], {"url_entropy": 1.0, "other": 0.0}, scorer, importance, repeats=2)
    assert merged.columns == ["feature", "shap_importance", "tree_importance", "permutation_importance"]
    assert merged.first()["feature"] == "url_entropy" and attribution.count() == 2 and errors.count() == 0
    assert ex.error_summary(scorer(features), 0.99).first()["fn"] > 0


def test_class_weights(spark):
    row = class_weights(spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")).first()
    assert (row["weight_pos"], row["weight_neg"], row["scale_pos_weight"]) == pytest.approx((2.0, 4 / 6, 2.4))
    assert class_weights(spark.createDataFrame([(0,)], "label int")).first()["weight_pos"] is None


def test_schema_helpers(spark):
    assert sh.sanitise_names(["a b", "a-b", "1x", "__", "a_b_2"]) == {"a b": "a_b", "a-b": "a_b_2", "1x": "f_1x", "__": "f_", "a_b_2": "a_b_2_2"}
    assert sh.sanitise_names_ascii(["1x", "é", "a b", "a b"]) == ["F_1x", "F", "a_b", "a_b_2"]
    df = spark.createDataFrame([(1, float("nan"), True, "t", 0)], "n int, d double, b boolean, s string, label int")
    assert sh.numeric_columns(df) == ["n", "d", "b"]
    assert sh.clean_non_finite(df).first()["d"] == 0.0
    aligned = sh.align_numeric(df, ["d", "missing"])
    assert aligned.columns == ["s", "label", "d", "missing"] and aligned.first()["missing"] == 0.0
    assert sh.freeze_numeric_block(df.select("s")) == ["_zero"]
    for bad in (df.drop("label"), df.select("label")):
        with pytest.raises(ValueError):
            sh.require_columns(bad)


def test_idle_perturbations_are_not_scored_again(features):
    seen = []

    def watching(df):
        seen.append(df)
        return scorer(df)

    suites = rb.random_suites("id", ["url_entropy", "other"])
    table = rb.perturbation_sweep(features, ["url_entropy", "other"], watching, suites, keep=["id"])
    rows = {(r["suite"], r["perturbation"]): r.asDict() for r in table.collect()}
    assert len(rows) == 1 + len(suites)
    # only the noise changes one of the two features
    assert seen[0].count() == 2 * 80
    base = rows["baseline", "none"]
    assert all(rows["domain_shift", n][c] == base[c] for n in ("financial", "government") for c in base if c not in ("suite", "perturbation"))
