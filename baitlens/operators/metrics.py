"""Quality, calibration and resampling metrics of scored rows, per group (model, fold, domain ...)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.probability import clip_probability
from ..session import materialise
from .curve import grid_confusion, literal_grid, score_counts, score_curve, share, with_rates
from .ordering import pin_order


def confusion(scored: DataFrame, threshold: float | Column = 0.5, group_by: Sequence[str] = (),
              score: str = "score", label: str = "label") -> DataFrame:
    """``tp fp tn fn`` at a threshold."""
    hit = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    positive = F.col(label) == 1
    return scored.groupBy(*group_by).agg(
        F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"), F.count_if(~hit & positive).alias("fn"),
    )


def class_balance(df: DataFrame, label: str = "label", group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_by).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"), F.avg(label).alias("pos_rate"),
    )


def value_shares(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares per value."""
    counts = df.groupBy(*group_by, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if not group_by:
        return counts.withColumn("share", F.try_divide("n", df.agg(F.count("*")).scalar()))
    totals = df.groupBy(*group_by).agg(F.count("*").alias("_total"))
    return _join_groups(counts, totals, group_by).withColumn("share", F.try_divide("n", "_total")).drop("_total")


def ranking_metrics(curve: DataFrame, group_by: Sequence[str] = (), target_fpr: float = fv.TARGET_FPR) -> DataFrame:
    """Area under ROC (ties halved), step-wise average precision and both kinds of recall at an FPR limit.

    With one class only the area is 0; without negatives the interpolated recall is null.
    """
    rated = with_rates(curve)
    order = F.col("tp") + F.col("fp")
    point = F.struct("fpr", "tpr", F.col("score").alias("threshold"))
    floor = F.greatest(F.lit(target_fpr), F.try_divide(F.lit(1.0), F.col("n_neg")))
    has_neg = F.col("n_neg") > 0
    within = F.when(F.col("corner") & has_neg & (F.col("fpr") <= floor), order)
    beyond = F.when(F.col("corner") & has_neg & (F.col("fpr") > floor), order)
    step = F.when(F.col("corner") & (F.col("fpr") <= target_fpr), order)
    pairs = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    gain = share(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))
    rows = rated.groupBy(*group_by).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(pairs).alias("_pairs"), F.sum(gain).alias("_gain"),
        F.max_by("tpr", step).alias("_step"), F.max_by(point, within).alias("_a"), F.min_by(point, beyond).alias("_b"),
        F.max(F.when(has_neg, floor)).alias("_target"),
    )
    a_fpr, a_tpr = F.coalesce("_a.fpr", F.lit(0.0)), F.coalesce("_a.tpr", F.lit(0.0))
    weight = F.try_divide(F.col("_target") - a_fpr, F.col("_b.fpr") - a_fpr)
    return rows.select(
        *group_by, "n_pos", "n_neg",
        share(F.col("_pairs"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
        share(F.col("_gain"), F.col("n_pos")).alias("pr_auc"),
        F.coalesce("_step", F.lit(0.0)).alias("recall_at_fpr"),
        F.when(F.col("n_neg") > 0,
               F.when(F.col("_b").isNull(), a_tpr).otherwise(a_tpr + (F.col("_b.tpr") - a_tpr) * weight)
               ).alias("recall_at_fpr_interp"),
        F.when(F.col("_b").isNull(), F.col("_a.threshold"))
        .otherwise(F.col("_a.threshold") + (F.col("_b.threshold") - F.col("_a.threshold")) * weight)
        .alias("threshold_at_fpr_interp"),
    )


def point_metrics(table: DataFrame) -> dict[str, Column]:
    """Accuracy, precision, recall, F1, FPR and TPR of confusion columns."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "accuracy": share(tp + tn, tp + fp + tn + fn),
        "precision": share(tp, tp + fp),
        "recall": share(tp, tp + fn),
        "f1": share(2 * tp, 2 * tp + fp + fn),
        "fpr": share(fp, fp + tn),
        "tpr": share(tp, tp + fn),
    }


def metrics_row(scored: DataFrame, threshold: float | Column = 0.5, group_by: Sequence[str] = (),
                score: str = "score", label: str = "label", target_fpr: float = fv.TARGET_FPR,
                ranking: bool = True) -> DataFrame:
    """The comprehensive metric row per group.

    ``ranking=False`` leaves out the areas and the recall at an FPR, which need all distinct scores in order.
    """
    hit = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    y = F.col(label)
    positive = y == 1
    p = clip_probability(F.col(score))
    direct = scored.groupBy(*group_by).agg(
        F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & ~positive).alias("tn"), F.count_if(~hit & positive).alias("fn"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.when(positive, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))).alias("log_loss"),
    )
    if not ranking:
        return direct.withColumns(point_metrics(direct))
    ranked = ranking_metrics(score_curve(scored, group_by, score, label), group_by, target_fpr)
    ranked = ranked.drop("n_pos", "n_neg", "recall_at_fpr_interp", "threshold_at_fpr_interp")
    if group_by:
        joined = _join_groups(direct, ranked, group_by)
    else:
        joined = direct.withColumn("_k", F.lit(1)).join(ranked.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.withColumns(point_metrics(joined))


def _join_groups(left: DataFrame, right: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Join two one-row-per-group tables, null groups included."""
    renamed = right.withColumnsRenamed({g: f"_r_{g}" for g in group_by})
    condition = F.lit(True)
    for g in group_by:
        condition = condition & left[g].eqNullSafe(renamed[f"_r_{g}"])
    return left.join(renamed, condition).drop(*[f"_r_{g}" for g in group_by])


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float] | None = None, group_by: Sequence[str] = (),
                    score: str = "score", label: str = "label") -> DataFrame:
    """Metrics at every threshold of a list (default 0.1 to 0.9), from one pass over the distinct scores."""
    grid = [0.1 + i * 0.1 for i in range(9)] if thresholds is None else sorted(thresholds)
    table = grid_confusion(score_counts(scored, group_by, score, label), literal_grid(grid), group_by)
    return table.withColumns(point_metrics(table)).drop("grid_index")


def _bin(score: Column, bins: int, inner_only: bool) -> Column:
    """Number of the bin (lo, hi]; ``inner_only`` puts 0 into the first bin, otherwise 0 is in no bin."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    if inner_only:
        return F.size(F.filter(literal_grid(edges[1:-1]), lambda e: e < score)) + 1
    return F.size(F.filter(literal_grid(edges), lambda e: e < score))


def reliability_curve(scored: DataFrame, bins: int = 10, group_by: Sequence[str] = (), score: str = "score",
                      label: str = "label") -> DataFrame:
    """Share of positives and mean score of every non-empty bin."""
    return scored.groupBy(*group_by, _bin(F.col(score), bins, True).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(label).alias("frac_pos"), F.avg(score).alias("mean_pred")
    )


def calibration_error(scored: DataFrame, bins: int = 10, group_by: Sequence[str] = (), score: str = "score",
                      label: str = "label") -> DataFrame:
    """Expected and maximum calibration error over bins (lo, hi]; score 0 counts in the total only."""
    per_bin = scored.groupBy(*group_by, _bin(F.col(score), bins, False).alias("_bin")).agg(
        F.count("*").alias("_n"), F.avg(label).alias("_acc"), F.avg(score).alias("_conf")
    )
    inside = F.col("_bin").between(1, bins)
    gap = F.abs(F.col("_conf") - F.col("_acc"))
    return per_bin.groupBy(*group_by).agg(
        F.coalesce(F.sum(F.when(inside, gap * F.col("_n"))) / F.sum("_n"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.max(F.when(inside, gap)), F.lit(0.0)).alias("mce"),
    )


def fold_summary(per_fold: DataFrame, metrics: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds; a fold with a null metric is left out."""
    aggregates = [F.count("*").alias("n_folds")]
    for m in metrics:
        aggregates += [F.count(m).alias(f"{m}_folds"), F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*group_by).agg(*aggregates)


def fold_metrics(scored: DataFrame, fold: str = "fold", score: str = "score", label: str = "label") -> DataFrame:
    """Per fold AUC and interpolated recall; folds with one class only get null."""
    ranked = ranking_metrics(score_curve(scored, [fold], score, label), [fold])
    valid = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return ranked.select(
        fold, "n_pos", "n_neg", F.when(valid, F.col("roc_auc")).alias("roc_auc"),
        F.when(valid, F.col("recall_at_fpr_interp")).alias("recall_at_fpr"),
    )


def quality_grade(metrics: DataFrame, recall: str = "recall", precision: str = "precision",
                  auc: str = "roc_auc") -> DataFrame:
    """Points from recall (0-3), precision (0-2) and AUC (0-2) and the grade they add up to."""
    r, p, a = F.col(recall), F.col(precision), F.col(auc)
    points = (
        F.when(r >= 0.95, 3).when(r >= 0.90, 2).when(r >= 0.85, 1).otherwise(0)
        + F.when(p >= 0.90, 2).when(p >= 0.85, 1).otherwise(0)
        + F.when(a >= 0.95, 2).when(a >= 0.90, 1).otherwise(0)
    )
    grade = (
        F.when(F.col("quality_points") >= 6, "PRODUCTION READY").when(F.col("quality_points") >= 4, "GOOD MODEL")
        .when(F.col("quality_points") >= 2, "NEEDS IMPROVEMENT").otherwise("POOR PERFORMANCE")
    )
    return metrics.withColumn("quality_points", points).withColumn("quality_grade", grade)


def expectation_check(scored: DataFrame, verdict: str = "verdict", expected: str = "expected") -> DataFrame:
    """A verdict matches when it is 1 for PHISHING or 0 for SAFE; the uncertain -1 never matches."""
    v, e = F.col(verdict), F.col(expected)
    word = F.when(v == 1, "PHISHING").when(v == 0, "SAFE").otherwise("UNCERTAIN")
    match = ((v == 1) & (e == "PHISHING")) | ((v == 0) & (e == "SAFE"))
    return scored.withColumn("verdict_label", word).withColumn("matches", match.cast("int"))


LEAD_COLUMNS = ("pos_before", "neg_before", "n_neg")


def bootstrap_ci(scored: DataFrame, threshold: float = 0.5, target_fpr: float = fv.TARGET_FPR, n_boot: int = 500,
                 seed: int = 42, alpha: float = 0.05, score: str = "score", label: str = "label") -> DataFrame:
    """Mean and percentile interval of seven metrics over Poisson resamples.

    A resample weights every row by Poisson(1), so a distinct score with c rows gets Poisson(c). Each task walks
    its range of the sorted distinct scores twice (totals, then the metrics' additive parts); rows are never copied
    per resample. Draws are keyed by seed and score, so neither a repeated task nor another layout changes them.
    """
    pinned = pin_order(score_counts(scored, (), score, label), [F.desc("score")])

    def part_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for part, scores, pos, neg, _ in _resamples(batches, seed, n_boot):
            if state is None:
                state = [part, np.zeros((4, n_boot))]
            hit = scores >= threshold
            state[1] += np.stack([pos.sum(1), neg.sum(1), pos[:, hit].sum(1), neg[:, hit].sum(1)])
        if state is not None:
            p, n, tp, fp = state[1]
            yield pd.DataFrame({"_part": state[0], "boot": np.arange(n_boot), "pos": p, "neg": n, "tp": tp, "fp": fp})

    totals = materialise(
        pinned.select("_part", "score", "pos", "neg").mapInPandas(
            part_totals, "_part int, boot int, pos double, neg double, tp double, fp double"),
        "bootstrap-totals",
    )
    ahead = Window.partitionBy("boot").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("boot")
    offsets = totals.select(
        "_part", "boot",
        F.coalesce(F.sum("pos").over(ahead), F.lit(0.0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(ahead), F.lit(0.0)).alias("neg_before"),
        F.sum("neg").over(whole).alias("n_neg"),
    )
    per_part = offsets.groupBy("_part").agg(
        F.sort_array(F.collect_list(F.struct("boot", "pos_before", "neg_before", "n_neg"))).alias("_o")
    ).select("_part", *[_field("_o", f).alias(f) for f in LEAD_COLUMNS])
    starts = pinned.groupBy("_part").agg(F.min("_seq").alias("_first"))
    # one row of 3 * n_boot numbers per range partition, so its size follows the partition count; only the first
    # row of a partition carries the numbers into the task
    lead = F.broadcast(per_part.join(starts, "_part"))
    is_first = F.col("_seq") == F.col("_first")
    attached = pinned.join(lead, "_part").select(
        "_part", "score", "pos", "neg", *[F.when(is_first, F.col(c)).alias(c) for c in LEAD_COLUMNS]
    )

    def part_metrics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for part, _, pos, neg, lead in _resamples(batches, seed, n_boot, LEAD_COLUMNS):
            if state is None:
                state = {"part": part, "tp": lead[0].copy(), "fp": lead[1].copy(), "n_neg": lead[2],
                         "pairs": np.zeros(n_boot), "gain": np.zeros(n_boot), "best": np.zeros(n_boot)}
            tp = state["tp"][:, None] + pos.cumsum(1)
            fp = state["fp"][:, None] + neg.cumsum(1)
            state["pairs"] += (neg * (tp - pos / 2)).sum(1)
            state["gain"] += np.divide(pos * tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0).sum(1)
            allowed = fp <= target_fpr * state["n_neg"][:, None]
            state["best"] = np.maximum(state["best"], np.where(allowed, tp, 0.0).max(1))
            state["tp"], state["fp"] = tp[:, -1], fp[:, -1]
        if state is not None:
            yield pd.DataFrame({"_part": state["part"], "boot": np.arange(n_boot), "pairs": state["pairs"],
                                "gain": state["gain"], "best": state["best"]})

    parts = attached.mapInPandas(part_metrics, "_part int, boot int, pairs double, gain double, best double")
    rank_parts = parts.groupBy("boot").agg(F.sum("pairs").alias("pairs"), F.sum("gain").alias("gain"),
                                           F.max("best").alias("best"))
    counts = totals.groupBy("boot").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "tp", "fp")])
    both = counts.join(rank_parts, "boot").withColumns({
        "tn": F.col("neg") - F.col("fp"), "fn": F.col("pos") - F.col("tp"),
    })
    valid = (F.col("pos") > 0) & (F.col("neg") > 0)
    point = point_metrics(both)
    per_boot = both.select("boot", F.array(*[
        F.struct(F.lit(name).alias("metric"), col.alias("value")) for name, col in {
            "roc_auc": F.when(valid, F.try_divide("pairs", F.col("pos") * F.col("neg"))),
            "pr_auc": F.when(valid, F.try_divide("gain", "pos")),
            "recall_at_fpr": F.when(valid, F.try_divide("best", "pos")),
            "accuracy": point["accuracy"], "precision": point["precision"], "recall": point["recall"],
            "f1": point["f1"],
        }.items()
    ]).alias("_m"))
    # n_boot values per metric: the exact percentile is over a bounded set
    return (
        per_boot.select(F.explode("_m").alias("_m")).select("_m.*").groupBy("metric").agg(
            F.avg("value").alias("mean"),
            F.percentile("value", F.lit(alpha / 2)).alias("ci_low"),
            F.percentile("value", F.lit(1 - alpha / 2)).alias("ci_high"),
            F.count("value").alias("n_boot"),
        )
    )


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda o: o[name])


def _resamples(batches: Iterator[pd.DataFrame], seed: int, n_boot: int, lead_columns: Sequence[str] = (),
               chunk: int = 1000) -> Iterator[tuple]:
    """Per chunk of a task's sorted scores: the range, the scores, drawn weights (resample x score), lead numbers."""
    first, part, lead = True, 0, []
    for batch in batches:
        for start in range(0, len(batch), chunk):
            piece = batch.iloc[start:start + chunk]
            if first:
                part = int(piece["_part"].iloc[0])
                lead = [np.asarray(piece[c].iloc[0], dtype=float) for c in lead_columns]
                first = False
            scores = piece["score"].to_numpy().astype(float)
            drawn = np.stack([
                np.random.Generator(np.random.Philox(key=[seed, key])).poisson(pair, (n_boot, 2))
                for key, pair in zip((scores + 0.0).view(np.uint64).tolist(), piece[["pos", "neg"]].to_numpy().astype(float))
            ], axis=1).astype(float)
            yield part, scores, drawn[:, :, 0], drawn[:, :, 1], lead
