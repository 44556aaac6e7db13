"""Decision thresholds per group (model), all from the distinct-score counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.probability import binary_metrics, combined_score
from .curve import grid_confusion, linspace, literal_grid, score_counts, score_curve, share, with_rates
from .ordering import exact_quantiles

METRICS = ["precision", "recall", "fpr", "f1", "accuracy", "cost"]


def _with_metrics(table: DataFrame, cost_fp: float, cost_fn: float, f1_epsilon: float = 1e-12) -> DataFrame:
    cols = binary_metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"), cost_fp, cost_fn, f1_epsilon)
    return table.withColumns(cols)


def _candidates(curve: DataFrame, group_by: Sequence[str], extra: Sequence[float]) -> DataFrame:
    """Confusion counts at every distinct score and at some extra thresholds."""
    at_scores = curve.select(
        *group_by, F.col("score").alias("threshold"), "tp", "fp",
        (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"),
    )
    fixed = grid_confusion(curve.select(*group_by, "score", "pos", "neg"), literal_grid(extra), group_by)
    return at_scores.unionByName(fixed.drop("grid_index"))


def _best(condition: Column | None, *key: Column) -> Column:
    """Threshold with the largest key; the lowest threshold of equal ones."""
    order = F.struct(*key, -F.col("threshold"))
    return F.max_by(F.struct("threshold", *METRICS), order if condition is None else F.when(condition, order))


def _chosen(picked: DataFrame, group_by: Sequence[str], levels: Sequence[tuple[str, str]]) -> DataFrame:
    """First level that found anything, its metrics, and the score that ranks models."""
    strategy, best = None, F.coalesce(*[F.col(column) for column, _ in levels])
    for column, name in levels:
        found = F.col(column).isNotNull()
        strategy = F.when(found, name) if strategy is None else strategy.when(found, name)
    out = picked.select(*group_by, strategy.alias("strategy"), best.alias("_b")).select(*group_by, "strategy", "_b.*")
    return out.withColumn(
        "combined", combined_score(*[F.col(c) for c in ("precision", "recall", "fpr", "f1", "cost")])
    )


def cost_guarded_threshold(scored: DataFrame, group_by: Sequence[str] = (), target_fpr: float = fv.TARGET_FPR,
                           cost_fp: float = fv.COST_FP, cost_fn: float = fv.COST_FN,
                           min_recall: float = fv.MIN_RECALL) -> DataFrame:
    """Threshold within the FPR limit; where its recall is too low, the cheapest of 0.01 ... 0.99."""
    curve = score_curve(scored, group_by)
    allowed = F.when(F.col("corner") & (F.col("fpr") <= target_fpr), F.struct(F.col("tpr"), F.col("score")))
    by_fpr = with_rates(curve).groupBy(*group_by).agg(
        F.max_by(F.struct(F.col("score").alias("threshold_fpr"), F.col("tpr").alias("recall_fpr")), allowed).alias("_f")
    ).select(*group_by, "_f.threshold_fpr", "_f.recall_fpr")
    grid = linspace(F.lit(0.01), F.lit(0.99), 99)
    costs = grid_confusion(curve.select(*group_by, "score", "pos", "neg"), grid, group_by)
    by_cost = costs.groupBy(*group_by).agg(
        F.min_by("threshold", F.struct(F.col("fp") * cost_fp + F.col("fn") * cost_fn, F.col("threshold")))
        .alias("threshold_cost")
    )
    both = _by_group(by_fpr, by_cost, group_by)
    # a null threshold stands for the curve's origin, where recall is 0
    keep = F.coalesce(F.col("recall_fpr"), F.lit(0.0)) >= min_recall
    return both.withColumn("threshold", F.when(keep, F.col("threshold_fpr")).otherwise(F.col("threshold_cost")))


def _by_group(left: DataFrame, right: DataFrame, group_by: Sequence[str]) -> DataFrame:
    keys = list(group_by) or ["_one"]
    if not group_by:
        left, right = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1))
    return left.join(right, keys).drop("_one")


def best_f1_threshold(scored: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Largest F1 over the distinct scores and 1.0."""
    table = _with_metrics(_candidates(score_curve(scored, group_by), group_by, [1.0]), fv.COST_FP, fv.COST_FN, 0.0)
    f1 = share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    picked = table.withColumn("f1", f1).groupBy(*group_by).agg(_best(None, F.col("f1")).alias("_b"))
    return picked.select(*group_by, "_b.threshold", "_b.f1")


def threshold_at_fpr(scored: DataFrame, group_by: Sequence[str] = (), target_fpr: float = 0.05) -> DataFrame:
    """Last ROC point within the limit; a null threshold is the origin (infinite threshold, recall 0)."""
    within = F.when(F.col("corner") & (F.col("fpr") <= target_fpr), F.col("tp") + F.col("fp"))
    picked = with_rates(score_curve(scored, group_by)).groupBy(*group_by).agg(
        F.max_by("score", within).alias("threshold"), F.max_by("tpr", within).alias("_tpr")
    )
    return picked.select(*group_by, "threshold", F.coalesce("_tpr", F.lit(0.0)).alias("tpr"))


def recall_at_precision(scored: DataFrame, group_by: Sequence[str] = (), min_precision: float = 0.88) -> DataFrame:
    """Largest recall with enough precision; the curve's end (threshold 1, recall 0, precision 1) always qualifies."""
    rated = with_rates(score_curve(scored, group_by)).withColumn(
        "precision", share(F.col("tp"), F.col("tp") + F.col("fp"))
    )
    order = F.when(F.col("precision") >= min_precision, F.struct(F.col("tpr"), -F.col("score")))
    picked = rated.groupBy(*group_by).agg(F.max_by(F.struct("score", "tpr", "precision"), order).alias("_b"))
    usable = F.col("_b").isNotNull() & (F.col("_b.tpr") > 0)
    zero = F.col("_b").isNotNull() & (F.col("_b.tpr") == 0)
    return picked.select(
        *group_by,
        F.when(usable | zero, F.col("_b.score")).otherwise(1.0).alias("threshold"),
        F.when(usable, F.col("_b.tpr")).otherwise(0.0).alias("recall"),
        F.when(usable | zero, F.col("_b.precision")).otherwise(1.0).alias("precision"),
    )


def next_after(x: Column) -> Column:
    """The next double towards 1 of a value in [0, 1]."""
    guess = F.floor(F.log2(x)).cast("double")
    low = F.when(F.pow(F.lit(2.0), guess) > x, guess - 1.0).otherwise(guess)
    exponent = F.when(F.pow(F.lit(2.0), low + 1.0) <= x, low + 1.0).otherwise(low)
    smallest = F.lit(5e-324)
    step = F.greatest(F.pow(F.lit(2.0), exponent - 52.0), smallest)
    return F.when(x <= 0, smallest).when(x >= 1, F.lit(1.0)).otherwise(x + step)


def fpr_targeted_threshold(scored: DataFrame, group_by: Sequence[str] = (), target_fpr: float = fv.TARGET_FPR,
                           cost_fp: float = fv.COST_FP, cost_fn: float = fv.COST_FN) -> DataFrame:
    """Seed at the negatives' upper quantile, a fine grid round it and a coarse one; best recall within the limit."""
    counts = score_counts(scored, group_by)
    negatives = scored.where(F.col("label") != 1).select(*group_by, "score")
    seeds = exact_quantiles(negatives, "score", [max(0.0, 1.0 - target_fpr)], group_by)
    groups = counts.select(*group_by).distinct() if group_by else counts.agg(F.count("*").alias("_any")).drop("_any")
    seeds = _left_by_group(groups, seeds, group_by)
    seed = F.coalesce(next_after(F.col("q0")), F.lit(1.0))
    grids = seeds.withColumn("_seed", seed).withColumn("_g", F.sort_array(F.array_distinct(F.concat(
        F.array("_seed"),
        linspace(F.greatest(F.lit(0.0), F.col("_seed") - 0.05), F.least(F.lit(1.0), F.col("_seed") + 0.05), 201),
        linspace(F.lit(0.0), F.lit(1.0), 101),
    )))).select(*group_by, "_g")
    gridded = _left_by_group(counts, grids, group_by)
    table = _with_metrics(grid_confusion(gridded, F.col("_g"), group_by), cost_fp, cost_fn)
    keys = [F.col("recall"), F.col("f1"), F.col("accuracy"), -F.col("cost")]
    picked = table.groupBy(*group_by).agg(
        _best(F.col("fpr") <= target_fpr + 1e-9, *keys).alias("_within"),
        _best(None, -F.col("fpr"), *keys).alias("_fallback"),
    )
    return _chosen(picked, group_by, [("_within", "fpr_quantile"), ("_fallback", "min_fpr_fallback")])


def _left_by_group(left: DataFrame, right: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Attach a one-row-per-group table (bounded: its rows are the groups)."""
    keys = list(group_by) or ["_one"]
    if not group_by:
        left, right = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1))
    return left.join(right, keys, "left").drop("_one")


def precision_floor_threshold(scored: DataFrame, group_by: Sequence[str] = (), min_precision: float = 0.96,
                              cost_fp: float = fv.COST_FP, cost_fn: float = fv.COST_FN) -> DataFrame:
    """Best F1 among thresholds that reach the precision floor; otherwise threshold 1."""
    table = _with_metrics(_candidates(score_curve(scored, group_by), group_by, [0.0, 1.0]), cost_fp, cost_fn)
    keys = [F.col("f1"), F.col("recall"), -F.col("fpr"), -F.col("cost")]
    picked = table.groupBy(*group_by).agg(
        _best(F.col("precision") >= min_precision, *keys).alias("_floor"),
        _best(F.col("threshold") == 1.0, F.lit(0.0)).alias("_fallback"),
    )
    return _chosen(picked, group_by, [("_floor", "precision_floor"), ("_fallback", "max_precision_fallback")])


def accuracy_cascade_threshold(scored: DataFrame, group_by: Sequence[str] = (), cost_fp: float = fv.COST_FP,
                               cost_fn: float = fv.COST_FN) -> DataFrame:
    """Four ever weaker demands on accuracy, recall, FPR and precision; the first that any threshold meets wins."""
    table = _with_metrics(_candidates(score_curve(scored, group_by), group_by, [1.0]), cost_fp, cost_fn)
    acc, rec, fpr, prec, f1 = (F.col(c) for c in ("accuracy", "recall", "fpr", "precision", "f1"))

    def blend(a: float, f: float, r: float) -> Column:
        return acc * a + f1 * f + rec * r + (F.lit(1.0) - fpr) * 0.10

    picked = table.groupBy(*group_by).agg(
        _best((acc >= 0.86) & (rec >= 0.85) & (fpr <= 0.12) & (prec >= 0.80), blend(0.40, 0.35, 0.15)).alias("_l1"),
        _best((acc >= 0.84) & (rec >= 0.80) & (fpr <= 0.15) & (prec >= 0.75), blend(0.35, 0.40, 0.15)).alias("_l2"),
        _best((fpr <= 0.18) & (rec >= 0.70), f1).alias("_l3"),
        _best(None, blend(0.35, 0.35, 0.20)).alias("_l4"),
    )
    return _chosen(picked, group_by, [("_l1", "accuracy_focused_l1"), ("_l2", "accuracy_focused_l2"),
                                      ("_l3", "f1_optimized_l3"), ("_l4", "balanced_l4")])


def select_threshold(scored: DataFrame, operating_point: str = "accuracy", group_by: Sequence[str] = (),
                     **options) -> DataFrame:
    """Dispatch by operating point: ``fpr``, ``precision``, ``f1`` (largest F1) or anything else: the cascade."""
    if operating_point == "fpr":
        return fpr_targeted_threshold(scored, group_by, **options)
    if operating_point == "precision":
        return precision_floor_threshold(scored, group_by, **options)
    if operating_point == "best_f1":
        return best_f1_threshold(scored, group_by)
    return accuracy_cascade_threshold(scored, group_by, **options)


def cheapest_of(scored: DataFrame, thresholds: Sequence[float], group_by: Sequence[str] = (),
                cost_fp: float = fv.COST_FP, cost_fn: float = fv.COST_FN) -> DataFrame:
    """The listed threshold with the least cost (the first of equal ones)."""
    table = grid_confusion(score_counts(scored, group_by), literal_grid(sorted(thresholds)), group_by)
    cost = F.col("fp") * cost_fp + F.col("fn") * cost_fn
    return table.withColumn("cost", cost).groupBy(*group_by).agg(
        F.min_by(F.struct("threshold", "cost"), F.struct("cost", "threshold")).alias("_b")
    ).select(*group_by, "_b.*")


def best_model(selected: DataFrame, model: str = "model", by: str = "combined", top: int = 1) -> DataFrame:
    """Models with the largest ranking value, name order breaking ties."""
    return selected.orderBy(F.desc(by), model).limit(top)


def quick_pick(ranked: DataFrame, model: str = "model", by: str = "pr_auc") -> DataFrame:
    """The model with the best average precision, at threshold 0.5."""
    best = ranked.agg(F.max_by(F.struct(model, by), F.struct(F.col(by))).alias("_b"))
    return best.select("_b.*", F.lit(0.5).alias("threshold"), F.lit("prauc@0.5").alias("strategy"))


def preferred_model(names: Sequence[str]) -> str:
    """The model taken when evaluation is skipped: the first present in the fixed order."""
    return next((n for n in fv.MODEL_PREFERENCE if n in names), sorted(names)[0])
