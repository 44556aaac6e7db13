"""Training jobs: the text path, the numeric path with cross-validation, and the whole run from splits to tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import training_label
from ..functions.text import sender_domain, temporal_features, text_signals
from ..functions.url import basic_url_features
from ..operators.drift import establish_baseline, label_shares
from ..operators.explain import error_rows, model_importance, permutation_importance
from ..operators.leakage import remove_leakage
from ..operators.metrics import bootstrap_ci, metrics_row, ranking_metrics
from ..operators.curve import score_curve
from ..operators.profile import Profile, apply_profile, fit_profile
from ..operators.robustness import robustness_report
from ..operators.schema import common_columns, numeric_columns
from ..operators.scoring import feature_view
from ..operators.splits import campaign_ids, group_folds, stratified_folds, time_series_folds
from ..operators.thresholds import best_model, cost_guarded_threshold, preferred_model, quick_pick, select_threshold
from ..operators.vectors import smote
from ..session import materialise
from .config import EvaluationConfig, TrainingConfig
from .features import FeatureSpace
from .models import (
    balanced_weights, calibrate, cross_validate, cross_validation_report, estimator, fit_stack, positive_weight,
    probabilities,
)


@dataclass
class Trained:
    """Fitted models by name with their calibration, chosen thresholds and the winner."""

    models: dict[str, Transformer]
    views: dict[str, str]
    calibrations: dict[str, object] = field(default_factory=dict)
    selection: DataFrame | None = None
    best_name: str = ""
    best_threshold: float = 0.5

    def score(self, df: DataFrame, keep: Sequence[str], name: str | None = None) -> DataFrame:
        """Calibrated probability of one model (default: the winner)."""
        chosen = name or self.best_name
        ready = df.withColumnRenamed(self.views[chosen], "features")
        scored = probabilities(self.models[chosen], ready, keep)
        if chosen in self.calibrations:
            return self.calibrations[chosen].apply(scored).select(*keep, F.col("calibrated").alias("score"))
        return scored


def _validation_scores(trained: Trained, val: DataFrame, label: str) -> DataFrame:
    return materialise(reduce(DataFrame.unionByName, [
        trained.score(val, [label], name).withColumn("model", F.lit(name)) for name in trained.models
    ]), "validation-scores")


def train_models(train: DataFrame, val: DataFrame, row_id: str, config: TrainingConfig, label: str = "label") -> Trained:
    """Fit the base models and the stack on prepared views, calibrate on validation, choose thresholds and winner."""
    train, val = materialise(train, "train-view"), materialise(val, "val-view")
    linear = balanced_weights(train, label).withColumnRenamed("features_lr", "features")
    tree = train.withColumnRenamed("features_tree", "features")
    if config.use_smote:
        arrays = tree.select(row_id, label, vector_to_array("features").alias("features"))
        tree = materialise(smote(arrays, row_id, "features", label, ratio=config.smote_ratio, seed=config.seed)
                           .withColumn("features", array_to_vector("features")), "balanced-view")
    tree = positive_weight(tree, label)
    n_rows = train.count()
    models, views = {}, {}
    for name in config.models:
        data = linear if name == "LR" else tree
        make = estimator(name, config, n_rows, "features", label)
        if name == "GBT":
            held = val.withColumnRenamed("features_tree", "features").select("features", label).withColumns(
                {"weight": F.lit(1.0), "_held": F.lit(True)})
            data = data.select("features", label, "weight").withColumn("_held", F.lit(False)).unionByName(held)
            make = estimator(name, config, n_rows, "features", label, validation="_held")
        models[name], views[name] = make.fit(data), feature_view(name)
    stackable = [n for n in config.models if n != "LR"]
    if config.use_stacking and len(stackable) >= 2:
        folded = stratified_folds(train.withColumnRenamed("features_tree", "features"), row_id, label,
                                  config.stacking_folds, config.seed)
        makers = {n: (lambda n=n: estimator(n, config, n_rows, "features", label, None)) for n in stackable}
        models["Stacking"], views["Stacking"] = fit_stack(folded, row_id, "fold", makers, label), "features_tree"
    trained = Trained(models, views)
    if config.calibrate:
        raw = _validation_scores(trained, val, label)
        trained.calibrations = {
            n: calibrate(raw.where(F.col("model") == n), config.calibration_method, label=label)
            for n in models if n != "LR"
        }
    if config.skip_evaluation:
        trained.best_name = preferred_model(list(models))
        return trained
    scores = _validation_scores(trained, val, label).withColumnRenamed(label, "label")
    options = {"cost_fp": config.cost_fp, "cost_fn": config.cost_fn}
    if config.operating_point == "fpr":
        options["target_fpr"] = config.target_fpr
    if config.operating_point == "precision":
        options["min_precision"] = config.min_precision
    if config.operating_point == "prauc":
        ranked = ranking_metrics(score_curve(scores, ["model"]), ["model"])
        trained.selection = quick_pick(ranked)
    elif config.operating_point == "best_f1":
        trained.selection = best_model(select_threshold(scores, "best_f1", ["model"]), by="f1", top=len(models))
    else:
        trained.selection = best_model(select_threshold(scores, config.operating_point, ["model"], **options),
                                       top=len(models))
    winner = trained.selection.first()
    trained.best_name, trained.best_threshold = winner["model"], float(winner["threshold"])
    return trained


def train_text(train: DataFrame, val: DataFrame, row_id: str, text: str, config: TrainingConfig,
               label: str = "label") -> tuple[FeatureSpace, Trained]:
    """Feature space on the training rows, then models on its views."""
    space = FeatureSpace(config, row_id, text)
    return space, train_models(space.fit(train, [label]), space.transform(val), row_id, config, label)


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep").transform(df).select(
        *keep, output)


def folds_for(df: DataFrame, row_id: str, config: EvaluationConfig, label: str = "label") -> DataFrame:
    """Row order folds where time counts, else sender groups, else stratified; long form ``row fold role``."""
    k = config.cv_folds
    if config.time_series_cv and "timestamp" in df.columns:
        return time_series_folds(df, row_id, k)
    if config.group_column in df.columns:
        tests = group_folds(df.select(row_id, config.group_column), config.group_column, k)
    else:
        tests = stratified_folds(df.select(row_id, label), row_id, label, k)
    return tests.select(row_id, "fold", F.lit("test").alias("role"))


def train_numeric(train: DataFrame, val: DataFrame, row_id: str, features: Sequence[str], config: EvaluationConfig,
                  training: TrainingConfig, label: str = "label") -> tuple[Trained, DataFrame]:
    """Per model: cross-validated AUC, a fit, calibration on validation, a threshold, and its metric row."""
    folds = folds_for(train, row_id, config, label)
    keep = [row_id, label]
    table = materialise(assemble(train, features, keep).join(folds, row_id), "numeric-folds")
    single_role = table.where(F.col("role") == "train").limit(1).count() == 0
    full = assemble(train, features, keep)
    held = assemble(val, features, keep)
    n_rows = full.count()
    rows, trained = [], Trained({}, {})
    for name in training.models:
        def make(n: int, name: str = name):
            return estimator(name, training, n, "features", label, None)

        if single_role:
            scores = cross_validate(table, "fold", make, label=label)
        else:
            parts = []
            for fold in range(config.cv_folds):
                seen = table.where((F.col("fold") == fold) & (F.col("role") == "train"))
                balance = seen.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n")).first()
                if 0 < balance["pos"] < balance["n"]:
                    test = table.where((F.col("fold") == fold) & (F.col("role") == "test"))
                    parts.append(probabilities(make(balance["n"]).fit(seen), test, ["fold", label]))
            scores = materialise(reduce(DataFrame.unionByName, parts), "cv-scores")
        _, summary = cross_validation_report(scores, "fold", label)
        model = make(n_rows).fit(full)
        raw = probabilities(model, held, [label])
        calibration = calibrate(raw, config.calibration_method, label=label)
        trained.models[name], trained.views[name], trained.calibrations[name] = model, "features", calibration
        scored = materialise(
            calibration.apply(raw).select(F.col(label).alias("label"), F.col("calibrated").alias("score")), "val-scores")
        chosen = cost_guarded_threshold(scored, (), config.target_fpr, config.cost_fp, config.cost_fn,
                                        config.min_recall).first()["threshold"]
        threshold = 0.5 if chosen is None else float(chosen)
        rows.append(
            metrics_row(scored, threshold, target_fpr=config.target_fpr).withColumns({
                "model": F.lit(name), "threshold": F.lit(threshold),
                "cv_auc_mean": summary.select("roc_auc_mean").scalar(),
                "cv_auc_std": summary.select("roc_auc_std").scalar(),
            })
        )
    trained.selection = materialise(best_model(reduce(DataFrame.unionByName, rows), by="recall_at_fpr",
                                               top=len(rows)), "numeric-selection")
    winner = trained.selection.orderBy(F.desc("recall_at_fpr"), "model").first()
    trained.best_name, trained.best_threshold = winner["model"], float(winner["threshold"])
    return trained, trained.selection


@dataclass
class RunResult:
    trained: Trained
    profile: Profile
    features: list[str]
    tables: dict[str, DataFrame]


def derive_features(df: DataFrame, row_id: str) -> DataFrame:
    """Time, sender, URL and text features for the columns that are there."""
    out = temporal_features(df) if "timestamp" in df.columns else df
    sender = next((c for c in ("sender", "from_address") if c in df.columns), None)
    if sender:
        out = campaign_ids(out.withColumn("sender_domain", sender_domain(F.col(sender))), "sender_domain", row_id)
    out = basic_url_features(out) if "url" in df.columns else out
    return text_signals(out)


def run_training(splits: DataFrame, row_id: str, config: EvaluationConfig | None = None,
                 training: TrainingConfig | None = None, split: str = "split", label: str = "label",
                 bootstrap_rounds: int = 500) -> RunResult:
    """From one split-labelled table to models and result tables (numeric path).

    Features, leakage removal, cleaning profile on train, models, test metrics with intervals, robustness,
    explanation and drift baseline.
    """
    config, training = config or EvaluationConfig(), training or TrainingConfig()
    labelled = splits.withColumn(label, training_label(splits, label))
    derived = derive_features(labelled, row_id)
    kept = materialise(remove_leakage(derived, row_id, split, label), "leak-free")
    parts = {s: kept.where(F.col(split) == s) for s in ("train", "val", "test")}
    shared = set(common_columns(*parts.values(), label=label))
    numeric = [c for c in numeric_columns(kept, label) if c in shared and c != row_id]
    profile = fit_profile(parts["train"], numeric)
    others = [c for c in ("timestamp", config.group_column) if c in kept.columns]
    cleaned = {s: materialise(apply_profile(p, profile, [row_id, label, *others]), f"clean-{s}")
               for s, p in parts.items()}
    features = profile.order
    trained, selection = train_numeric(cleaned["train"], cleaned["val"], row_id, features, config, training, label)

    def scorer(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "features"]
        return trained.score(assemble(df, features, keep), keep)

    scored = materialise(scorer(cleaned["test"]).withColumnRenamed(label, "label"), "test-scores")
    best = trained.models[trained.best_name]
    spark = splits.sparkSession
    tables = {
        "validation": selection,
        "test_metrics": metrics_row(scored, trained.best_threshold, target_fpr=config.target_fpr),
        "bootstrap": bootstrap_ci(scored, trained.best_threshold, config.target_fpr, bootstrap_rounds),
        "errors": error_rows(scored, trained.best_threshold),
        "importance": model_importance(best, features, spark),
        "permutation": permutation_importance(cleaned["test"], row_id, features, scorer, label),
        "drift_baseline": establish_baseline(cleaned["train"], features),
        "label_baseline": label_shares(cleaned["train"], label),
    }
    report = robustness_report(cleaned["test"], features, scorer, row_id, trained.best_threshold, label)
    tables |= {f"robustness_{name}": table for name, table in report.items()}
    return RunResult(trained, profile, features, tables)

