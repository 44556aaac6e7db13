"""Models, calibration, stacking and the two training paths on small data."""

import threading

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from baitlens.operators import scoring as sc
from baitlens.operators.tfidf import strip_accents, tfidf
from baitlens.plans import models as ml
from baitlens.plans.config import EvaluationConfig, TrainingConfig
from baitlens.plans.features import FeatureSpace, fit_vectorizer
from baitlens.plans.training import run_training, train_text

SMALL = dict(rf_trees=5, rf_depth=3, gbt_rounds=3, gbt_depth=2, gbt_step=0.3, lr_max_iter=50)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(160):
        label = int(i % 3 == 0)
        rows.append((i, label, [float(v) for v in rng.normal(size=3) + label]))
    return spark.createDataFrame(rows, "row_id int, label int, x array<double>").select(
        "row_id", "label", array_to_vector("x").alias("features"), (F.col("row_id") % 2).alias("fold")).cache()


def test_calibration_is_monotone_and_smoothed(spark):
    rng = np.random.default_rng(10)
    p = rng.random(300)
    scored = spark.createDataFrame([(int(rng.random() < x), float(x)) for x in p], "label int, score double")
    iso = [r["calibrated"] for r in ml.calibrate(scored, "isotonic").apply(scored).orderBy("score").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(iso, iso[1:]))
    sigmoid = ml.calibrate(scored, "sigmoid")
    assert sigmoid.slope > 0
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, score double")
    fitted = [r["calibrated"] for r in ml.calibrate(perfect, "sigmoid").apply(perfect).orderBy("score").collect()]
    assert fitted == pytest.approx([1 / 3, 2 / 3], abs=1e-3)  # smoothed targets of one row per class


def test_stack_and_cross_validation(table):
    config = TrainingConfig(**SMALL)
    weighted = ml.balanced_weights(table)
    makers = {n: (lambda n=n: ml.estimator(n, config, 160)) for n in ("LR", "RF")}
    stack = ml.fit_stack(weighted, "row_id", "fold", makers)
    assert ml.probabilities(stack, table, ["row_id"]).where("score BETWEEN 0 AND 1").count() == 160
    with pytest.raises(ValueError):
        ml.fit_stack(weighted, "row_id", "fold", {"LR": makers["LR"]})
    scores = ml.cross_validate(table, "fold", lambda n: ml.estimator("LR", config, n), ["row_id"], weigh=ml.balanced_weights)
    per_fold, summary = ml.cross_validation_report(scores)
    assert scores.count() == 160 and per_fold.count() == 2
    assert summary.first()["roc_auc_mean"] > 0.75


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(table):
    forest = ml.estimator("RF", TrainingConfig(**SMALL), 160, weight=None)
    assert forest.getCacheNodeIds()
    plain = forest.copy({forest.cacheNodeIds: False})
    assert forest.fit(table).toDebugString.split("\n", 1)[1] == plain.fit(table).toDebugString.split("\n", 1)[1]


def test_stack_fits_side_by_side(table):
    """Each fit waits until another one runs; the base models of the stack are in the order of their makers."""
    config, meet = TrainingConfig(**SMALL), threading.Barrier(2, timeout=60)

    class Waiting(Estimator):
        def __init__(self, inner):
            super().__init__()
            self.inner = inner

        def _fit(self, dataset):
            meet.wait()
            return self.inner.fit(dataset)

    makers = {n: (lambda n=n: Waiting(ml.estimator(n, config, 160))) for n in ("RF", "LR")}
    stack = ml.fit_stack(ml.balanced_weights(table), "row_id", "fold", makers)
    assert stack.names == ["RF", "LR"] and [hasattr(b, "trees") for b in stack.bases] == [True, False]
    assert ml.probabilities(stack, table, ["row_id"]).where("score BETWEEN 0 AND 1").count() == 160


def test_weights(table):
    balanced = ml.balanced_weights(table).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in balanced] == pytest.approx([80.0, 80.0])
    assert ml.positive_weight(table).where("label = 1").first()["weight"] == pytest.approx(106 / 54 * 0.8)


def test_vectorizer_equals_long_form(spark):
    rows = [(i, f"café number {i % 4} and {'word ' * (i % 3)}") for i in range(12)]
    docs = spark.createDataFrame(rows, "row_id int, text string")
    model = fit_vectorizer(docs, "row_id", "text", "char", 3, 5, "tfidf", min_df=2)
    vectors = {r["row_id"]: r["tfidf"] for r in model.transform(docs).collect()}
    long = tfidf(docs, "row_id", "text", "char", 3, 5, min_df=2).collect()
    words = model.stages[1].vocabulary
    for r in long:
        assert vectors[r["row_id"]][words.index(r["term"])] == pytest.approx(r["weight"])
    assert len(long) == sum(v.numNonzeros() for v in vectors.values())


def test_strip_accents(one):
    assert one("Éçœñ ﬁn Ǆ", strip_accents(F.col("v"))) == "Ecœn fin DZ"
    assert one(None, strip_accents(F.col("v"))) is None and one("plain", strip_accents(F.col("v"))) == "plain"


def test_strip_accents_equals_the_standard_form_everywhere(spark):
    """Every assigned code point of every plane, alone and between letters: Hangul, ligatures, numerals, kanji, presentation forms."""
    import unicodedata

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    texts = ["x".join(map(chr, points[i:i + 2000])) for i in range(0, len(points), 2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r["p"] for r in frame.select(F.col("v"), strip_accents(F.col("v")).alias("p")).collect()]

    def standard(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))

    assert got == [standard(t) for t in texts] and one_by_one("각ﷺⅧ㌀") == standard("각ﷺⅧ㌀")


def one_by_one(text):
    from baitlens.operators.tfidf import _PLAIN

    return text.translate(_PLAIN)


def mails(spark, n=160):
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = f"{'urgent verify your account' if bad else 'meeting notes attached'} number {i % 17} thanks {i % 5}"
        url = f"http://{'login-x' if bad else 'docs'}{i % 40}.example.com/{'verify' if bad else 'page'}/{i}"
        rows.append((i, text, url, f"user{i}@s{i}.com", "phish" if bad else "ham", ("train", "train", "val", "test")[i % 4]))
    return spark.createDataFrame(rows, "row_id int, text string, url string, sender string, label string, split string")


def test_text_path(spark):
    df = mails(spark).withColumn("label", (F.col("label") == "phish").cast("int"))
    config = TrainingConfig(**SMALL, svd_components=4, operating_point="fpr", target_fpr=0.1)
    parts = {s: df.where(F.col("split") == s).drop("split", "sender") for s in ("train", "val", "test")}
    space, trained = train_text(parts["train"], parts["val"], "row_id", "text", config)
    assert set(trained.models) == {"LR", "RF", "GBT", "Stacking"}
    assert set(trained.calibrations) == {"RF", "GBT", "Stacking"}
    view = space.transform(parts["test"])
    widths = view.select(F.size(vector_to_array("features_lr")).alias("a"), F.size(vector_to_array("features_tree")).alias("b")).distinct().collect()
    assert len(widths) == 1 and widths[0]["a"] > widths[0]["b"]
    scored = trained.score(view, ["row_id", "label"])
    assert scored.where("(score >= 0.5) = (label = 1)").count() >= 38
    skipped = FeatureSpace(TrainingConfig(use_tfidf=False))
    assert "features_tree" in skipped.fit(parts["train"]).columns


def test_whole_run(spark):
    splits = mails(spark, 360)
    config = EvaluationConfig(cv_folds=2, time_series_cv=False, target_fpr=0.1)
    result = run_training(splits, "row_id", config, TrainingConfig(**SMALL, models=("LR", "RF")), bootstrap_rounds=20)
    assert result.trained.best_name in {"LR", "RF"} and result.features == result.profile.order
    metrics = result.tables["test_metrics"].first()
    assert metrics["roc_auc"] > 0.95
    assert result.tables["validation"].count() == 2
    assert result.tables["bootstrap"].count() == 7
    assert result.tables["drift_baseline"].count() == len(result.features)
    assert result.tables["robustness_temperature"].count() == 4


def test_scoring_fallbacks(spark):
    df = spark.createDataFrame([(1.0,)], "prediction double")
    assert sc.probability_column(df).first()["score"] == 1.0
    raw = df.withColumn("rawPrediction", array_to_vector(F.array(F.lit(-50.0), F.lit(50.0))))
    assert sc.probability_column(raw).first()["score"] == pytest.approx(1.0, abs=1e-8)
    assert sc.feature_view("LR") == "features_lr" and sc.feature_view("RF") == "features_tree"
    marked = sc.predictor(lambda d: d.withColumn("score", F.lit(0.4)), 0.4)(df).first()
    assert marked["prediction"] == 1


def test_queries_train_with_the_default_settings():
    from baitlens.catalog import vectors

    assert vectors.CONFIG == TrainingConfig()


def test_grams_stay_with_their_document(spark):
    rows = [(i % 9, "one two three four") for i in range(12)] + [(None, "one two"), (None, None)]
    long = tfidf(spark.createDataFrame(rows, "row_id int, text string"), "row_id", "text", "word", 1, 2, min_df=1, max_df=1.0)
    plan = long._jdf.queryExecution().executedPlan().toString()
    # the texts are shuffled by their document; no n-gram is
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan
    counts = {(r["row_id"], r["term"]): r["tf"] for r in long.collect()}
    assert counts[0, "one two"] == 2 and counts[None, "one"] == 1 and counts[3, "four"] == 1
