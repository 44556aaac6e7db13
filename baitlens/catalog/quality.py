"""Metric, threshold, calibration, decision and error queries over the stand-in scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as pr
from ..operators import curve as cv
from ..operators import explain as ex
from ..operators import metrics as mt
from ..operators import robustness as rb
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import thresholds as th
from ..session import read_table
from .base import (
    COUNTS_SQL, CURVE_SQL, SCORED_MODELS_SQL, SCORED_SQL, finish, outputs, query, scored, scored_models,
)

FPR = 0.05
BY = ["model"]

POINT_SQL = """
  CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) ELSE 0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1,
  CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS tpr"""


def confusion_sql(threshold: str = "0.5", by: str = "model", source: str = "scored") -> str:
    group = f"{by}, " if by else ""
    return (f"SELECT {group}count(*) FILTER (WHERE score >= {threshold} AND label = 1) AS tp, "
            f"count(*) FILTER (WHERE score >= {threshold} AND label <> 1) AS fp, "
            f"count(*) FILTER (WHERE score < {threshold} AND label <> 1) AS tn, "
            f"count(*) FILTER (WHERE score < {threshold} AND label = 1) AS fn FROM {source}" + (f" GROUP BY {by}" if by else ""))


@query("confusion", f"WITH {SCORED_MODELS_SQL}, c AS ({confusion_sql()}) SELECT {outputs('model:s tp:i fp:i tn:i fn:i')} FROM c")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.confusion(scored_models(spark, sf), 0.5, BY))


RANK_SQL = f"""
rank AS (
  SELECT model, max(n_pos) AS n_pos, max(n_neg) AS n_neg,
    sum(CAST(neg AS DOUBLE) * (tp - CAST(pos AS DOUBLE) / 2)) / (CAST(max(n_pos) AS DOUBLE) * max(n_neg)) AS roc_auc,
    sum(CAST(pos AS DOUBLE) / n_pos * tp / (tp + fp)) AS pr_auc,
    coalesce(max(tpr) FILTER (WHERE corner AND fpr <= {FPR}), 0) AS recall_at_fpr
  FROM curve GROUP BY model)"""


@query("metrics_row", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, {RANK_SQL}, c AS ({confusion_sql()}),
b AS (SELECT model, avg((least(greatest(score, 1e-9::DOUBLE), (1 - 1e-9)::DOUBLE) - label) ** 2) AS brier,
  avg(-CASE WHEN label = 1 THEN ln(least(greatest(score, 1e-9::DOUBLE), 1::DOUBLE - 1e-9::DOUBLE)) ELSE ln(1 - least(greatest(score, 1e-9::DOUBLE), 1::DOUBLE - 1e-9::DOUBLE)) END) AS log_loss
  FROM scored GROUP BY model),
f AS (SELECT c.*, brier, log_loss, roc_auc, pr_auc, recall_at_fpr, {POINT_SQL} FROM c JOIN b USING (model) JOIN rank USING (model))
SELECT {outputs('model:s tp:i fp:i tn:i fn:i brier:d log_loss:d roc_auc:d pr_auc:d recall_at_fpr:d accuracy:d precision:d recall:d f1:d fpr:d tpr:d')} FROM f""")
def metrics_row(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.metrics_row(scored_models(spark, sf), 0.5, BY, target_fpr=FPR))


@query("quality_grade", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, {RANK_SQL}, c AS ({confusion_sql()}), f AS (SELECT model, roc_auc, {POINT_SQL} FROM c JOIN rank USING (model)),
g AS (SELECT *, CASE WHEN recall >= 0.95 THEN 3 WHEN recall >= 0.9 THEN 2 WHEN recall >= 0.85 THEN 1 ELSE 0 END
  + CASE WHEN precision >= 0.9 THEN 2 WHEN precision >= 0.85 THEN 1 ELSE 0 END
  + CASE WHEN roc_auc >= 0.95 THEN 2 WHEN roc_auc >= 0.9 THEN 1 ELSE 0 END AS quality_points FROM f)
SELECT {outputs('model:s recall:d precision:d roc_auc:d quality_points:i')}, CASE WHEN quality_points >= 6 THEN 'PRODUCTION READY'
  WHEN quality_points >= 4 THEN 'GOOD MODEL' WHEN quality_points >= 2 THEN 'NEEDS IMPROVEMENT' ELSE 'POOR PERFORMANCE' END AS quality_grade FROM g""")
def quality_grade(spark: SparkSession, sf: str) -> DataFrame:
    rows = mt.metrics_row(scored_models(spark, sf), 0.5, BY, target_fpr=FPR)
    return finish(mt.quality_grade(rows).select("model", "recall", "precision", "roc_auc", "quality_points", "quality_grade"))


@query("roc_points", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, p AS (SELECT model, score AS threshold, fpr, tpr FROM curve WHERE corner
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 0, 0 FROM curve) SELECT {outputs('model:s threshold:d fpr:d tpr:d')} FROM p""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return finish(cv.roc_points(cv.score_curve(scored_models(spark, sf), BY), BY))


@query("pr_points", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, p AS (SELECT model, score AS threshold, CAST(tp AS DOUBLE) / (tp + fp) AS precision, tpr AS recall FROM curve)
SELECT {outputs('model:s threshold:d precision:d recall:d')} FROM p""")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return finish(cv.pr_points(cv.score_curve(scored_models(spark, sf), BY), BY))


@query("recall_at_fpr_step", f"WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, {RANK_SQL} SELECT {outputs('model:s recall_at_fpr:d')} FROM rank")
def recall_at_fpr_step(spark: SparkSession, sf: str) -> DataFrame:
    curve = cv.score_curve(scored_models(spark, sf), BY)
    return finish(mt.ranking_metrics(curve, BY, FPR).select("model", "recall_at_fpr"))


@query("recall_at_fpr_interp", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, t AS (SELECT *, greatest(CAST(0.003 AS DOUBLE), 1.0 / CAST(n_neg AS DOUBLE)) AS target FROM curve WHERE corner),
a AS (SELECT model, max(target) AS target, coalesce(max(fpr) FILTER (WHERE fpr <= target), 0) AS f0,
  coalesce(max(tpr) FILTER (WHERE fpr <= target), 0) AS t0, min(score) FILTER (WHERE fpr <= target) AS s0,
  min_by(struct_pack(f := fpr, t := tpr, s := score), tp + fp) FILTER (WHERE fpr > target) AS nxt FROM t GROUP BY model),
r AS (SELECT model, CASE WHEN nxt IS NULL THEN t0 ELSE t0 + (nxt.t - t0) * ((target - f0) / (nxt.f - f0)) END AS recall_at_fpr_interp,
  CASE WHEN nxt IS NULL THEN s0 ELSE s0 + (nxt.s - s0) * ((target - f0) / (nxt.f - f0)) END AS threshold_at_fpr_interp FROM a)
SELECT {outputs('model:s recall_at_fpr_interp:d threshold_at_fpr_interp:d')} FROM r""")
def recall_at_fpr_interp(spark: SparkSession, sf: str) -> DataFrame:
    curve = cv.score_curve(scored_models(spark, sf), BY)
    return finish(mt.ranking_metrics(curve, BY).select("model", "recall_at_fpr_interp", "threshold_at_fpr_interp"))


METRIC_SQL = """
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fpr,
  CASE WHEN tp + fp + tn + fn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) ELSE 0 END AS accuracy"""


def candidates_sql(extra: str) -> str:
    """CTE ``m``: confusion and metrics at every distinct score and some extra thresholds."""
    return f"""
cand AS (SELECT DISTINCT model, score AS threshold FROM counts UNION SELECT DISTINCT model, CAST(x AS DOUBLE) FROM counts CROSS JOIN (VALUES {extra}) AS v(x)),
conf AS (SELECT c.model, c.threshold, coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) AS tp, coalesce(sum(neg) FILTER (WHERE score >= threshold), 0) AS fp,
  coalesce(sum(neg) FILTER (WHERE score < threshold), 0) AS tn, coalesce(sum(pos) FILTER (WHERE score < threshold), 0) AS fn
  FROM cand c JOIN counts USING (model) GROUP BY c.model, c.threshold),
m0 AS (SELECT *, {METRIC_SQL}, CAST(fp * 1.0 + fn * 10.0 AS DOUBLE) AS cost FROM conf),
m AS (SELECT *, 2.0::DOUBLE * (precision * recall) / (precision + recall + 1e-12::DOUBLE) AS f1 FROM m0)"""


COMBINED_SQL = ("f1 * 0.35::DOUBLE + recall * 0.3::DOUBLE + precision * 0.15::DOUBLE + (1 - fpr) * 0.1::DOUBLE "
                "+ (1 / (1 + 0.01::DOUBLE * cost)) * 0.1::DOUBLE AS combined")
CHOSEN = "model:s strategy:s threshold:d precision:d recall:d fpr:d f1:d accuracy:d cost:d combined:d"


@query("threshold_cost", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, f AS (SELECT model, max_by(score, struct_pack(a := tpr, b := score)) FILTER (WHERE corner AND fpr <= {FPR}) AS threshold_fpr,
  max(tpr) FILTER (WHERE corner AND fpr <= {FPR}) AS recall_fpr FROM curve GROUP BY model),
g AS (SELECT DISTINCT model, CASE WHEN i = 98 THEN 0.99::DOUBLE ELSE i * ((0.99::DOUBLE - 0.01::DOUBLE) / 98) + 0.01::DOUBLE END AS th FROM counts CROSS JOIN range(99) AS r(i)),
c AS (SELECT g.model, th, sum(CASE WHEN score >= th THEN neg ELSE 10 * pos END) AS cost FROM g JOIN counts USING (model) GROUP BY g.model, th),
k AS (SELECT model, min_by(th, struct_pack(a := cost, b := th)) AS threshold_cost FROM c GROUP BY model),
x AS (SELECT *, CASE WHEN coalesce(recall_fpr, 0) >= 0.8 THEN threshold_fpr ELSE threshold_cost END AS threshold FROM f JOIN k USING (model))
SELECT {outputs('model:s threshold_fpr:d recall_fpr:d threshold_cost:d threshold:d')} FROM x""")
def threshold_cost(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.cost_guarded_threshold(scored_models(spark, sf), BY, FPR))


@query("threshold_f1", f"""
WITH {SCORED_MODELS_SQL}, {COUNTS_SQL}, {candidates_sql('(1.0)')}, z AS (SELECT model, threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1x FROM m),
x AS (SELECT model, max_by(threshold, struct_pack(a := f1x, b := -threshold)) AS threshold, max(f1x) AS f1 FROM z GROUP BY model)
SELECT {outputs('model:s threshold:d f1:d')} FROM x""")
def threshold_f1(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.select_threshold(scored_models(spark, sf), "best_f1", BY))


@query("threshold_at_fpr", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, x AS (SELECT model, min(score) FILTER (WHERE corner AND fpr <= {FPR}) AS threshold,
  coalesce(max(tpr) FILTER (WHERE corner AND fpr <= {FPR}), 0) AS tpr FROM curve GROUP BY model) SELECT {outputs('model:s threshold:d tpr:d')} FROM x""")
def threshold_at_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.threshold_at_fpr(scored_models(spark, sf), BY, FPR))


@query("threshold_recall_at_precision", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, p AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS prec FROM curve),
x AS (SELECT model, max_by(struct_pack(s := score, r := tpr, p := prec), struct_pack(a := tpr, b := -score)) FILTER (WHERE prec >= 0.9) AS b FROM p GROUP BY model),
y AS (SELECT model, coalesce(b.s, 1) AS threshold, coalesce(b.r, 0) AS recall, coalesce(b.p, 1) AS precision FROM x)
SELECT {outputs('model:s threshold:d recall:d precision:d')} FROM y""")
def threshold_recall_at_precision(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.recall_at_precision(scored_models(spark, sf), BY, 0.9))


FPR_GRID_SQL = f"""
seeds AS (SELECT model, nextafter(quantile_cont(score, CAST({1.0 - FPR} AS DOUBLE)), 1.0::DOUBLE) AS seed FROM scored WHERE label <> 1 GROUP BY model),
ends AS (SELECT model, seed, greatest(0.0::DOUBLE, seed - 0.05::DOUBLE) AS lo, least(1.0::DOUBLE, seed + 0.05::DOUBLE) AS hi FROM seeds),
grid AS (SELECT model, seed AS threshold FROM ends
  UNION SELECT model, CASE WHEN i = 200 THEN hi ELSE i * ((hi - lo) / 200.0::DOUBLE) + lo END FROM ends CROSS JOIN range(201) AS r(i)
  UNION SELECT model, CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 100) END FROM ends CROSS JOIN range(101) AS r(i)),
conf AS (SELECT c.model, c.threshold, coalesce(sum(pos) FILTER (WHERE score >= threshold), 0) AS tp, coalesce(sum(neg) FILTER (WHERE score >= threshold), 0) AS fp,
  coalesce(sum(neg) FILTER (WHERE score < threshold), 0) AS tn, coalesce(sum(pos) FILTER (WHERE score < threshold), 0) AS fn
  FROM grid c JOIN counts USING (model) GROUP BY c.model, c.threshold),
m0 AS (SELECT *, {METRIC_SQL}, CAST(fp * 1.0 + fn * 10.0 AS DOUBLE) AS cost FROM conf),
m AS (SELECT *, 2.0::DOUBLE * (precision * recall) / (precision + recall + 1e-12::DOUBLE) AS f1 FROM m0)"""


@query("threshold_fpr", f"""
WITH {SCORED_MODELS_SQL}, {COUNTS_SQL}, {FPR_GRID_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY recall DESC, f1 DESC, accuracy DESC, cost, threshold) AS rn FROM m WHERE fpr <= {FPR} + 1e-9),
x AS (SELECT *, 'fpr_quantile' AS strategy, {COMBINED_SQL} FROM r WHERE rn = 1) SELECT {outputs(CHOSEN)} FROM x""")
def threshold_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.select_threshold(scored_models(spark, sf), "fpr", BY, target_fpr=FPR))


@query("threshold_precision", f"""
WITH {SCORED_MODELS_SQL}, {COUNTS_SQL}, {candidates_sql('(0.0), (1.0)')},
a AS (SELECT *, 1 AS lvl, 'precision_floor' AS strategy, f1 AS k1, recall AS k2, -fpr AS k3, -cost AS k4 FROM m WHERE precision >= 0.96
  UNION ALL SELECT *, 2, 'max_precision_fallback', 0, 0, 0, 0 FROM m WHERE threshold = 1.0),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY lvl, k1 DESC, k2 DESC, k3 DESC, k4 DESC, threshold) AS rn FROM a),
x AS (SELECT *, {COMBINED_SQL} FROM r WHERE rn = 1) SELECT {outputs(CHOSEN)} FROM x""")
def threshold_precision(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.select_threshold(scored_models(spark, sf), "precision", BY, min_precision=0.96))


def _blend(a: str, f: str, r: str) -> str:
    return f"accuracy * {a}::DOUBLE + f1 * {f}::DOUBLE + recall * {r}::DOUBLE + (1 - fpr) * 0.1::DOUBLE"


CASCADE_SQL = f"""
a AS (SELECT *, 1 AS lvl, 'accuracy_focused_l1' AS strategy, {_blend('0.4', '0.35', '0.15')} AS k FROM m WHERE accuracy >= 0.86 AND recall >= 0.85 AND fpr <= 0.12 AND precision >= 0.8
  UNION ALL SELECT *, 2, 'accuracy_focused_l2', {_blend('0.35', '0.4', '0.15')} FROM m WHERE accuracy >= 0.84 AND recall >= 0.8 AND fpr <= 0.15 AND precision >= 0.75
  UNION ALL SELECT *, 3, 'f1_optimized_l3', f1 FROM m WHERE fpr <= 0.18 AND recall >= 0.7
  UNION ALL SELECT *, 4, 'balanced_l4', {_blend('0.35', '0.35', '0.2')} FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY lvl, k DESC, threshold) AS rn FROM a),
x AS (SELECT *, {COMBINED_SQL} FROM r WHERE rn = 1)"""


@query("threshold_accuracy_cascade", f"WITH {SCORED_MODELS_SQL}, {COUNTS_SQL}, {candidates_sql('(1.0)')}, {CASCADE_SQL} SELECT {outputs(CHOSEN)} FROM x")
def threshold_accuracy_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return finish(th.select_threshold(scored_models(spark, sf), "f1", BY))


@query("model_pick", f"""
WITH {SCORED_MODELS_SQL}, {COUNTS_SQL}, {candidates_sql('(1.0)')}, {CASCADE_SQL}
SELECT {outputs('model:s strategy:s threshold:d combined:d')} FROM x ORDER BY x.combined DESC, model LIMIT 3""")
def model_pick(spark: SparkSession, sf: str) -> DataFrame:
    chosen = th.select_threshold(scored_models(spark, sf), "accuracy", BY)
    return finish(th.best_model(chosen, top=3).select("model", "strategy", "threshold", "combined"))


@query("quick_pick", f"""
WITH {SCORED_MODELS_SQL}, {CURVE_SQL}, {RANK_SQL},
c AS (SELECT th AS cheapest_threshold, sum(CASE WHEN score >= th THEN neg ELSE 10 * pos END) AS cost FROM counts CROSS JOIN (VALUES (0.2::DOUBLE), (0.35::DOUBLE), (0.5::DOUBLE), (0.65::DOUBLE)) AS v(th)
  WHERE model = 'm1' GROUP BY th ORDER BY cost, th LIMIT 1),
x AS (SELECT model, pr_auc, 0.5 AS threshold, 'prauc@0.5' AS strategy, cheapest_threshold, cost FROM rank, c ORDER BY rank.pr_auc DESC, model LIMIT 1)
SELECT {outputs('model:s pr_auc:d threshold:d strategy:s cheapest_threshold:d cost:d')} FROM x""")
def quick_pick(spark: SparkSession, sf: str) -> DataFrame:
    curve = cv.score_curve(scored_models(spark, sf), BY)
    cheapest = th.cheapest_of(scored(spark, sf), [0.2, 0.35, 0.5, 0.65])
    picked = th.quick_pick(mt.ranking_metrics(curve, BY))
    return finish(picked.withColumn("cheapest_threshold", cheapest.select("threshold").scalar())
                  .withColumn("cost", cheapest.select("cost").scalar()))


SWEEP = "threshold:d tp:i fp:i tn:i fn:i accuracy:d precision:d recall:d f1:d fpr:d tpr:d"


def sweep_sql(grid: str) -> str:
    return f"""g AS (SELECT th AS threshold, count(*) FILTER (WHERE score >= th AND label = 1) AS tp, count(*) FILTER (WHERE score >= th AND label <> 1) AS fp,
  count(*) FILTER (WHERE score < th AND label <> 1) AS tn, count(*) FILTER (WHERE score < th AND label = 1) AS fn FROM scored CROSS JOIN ({grid}) AS v(th) GROUP BY th),
f AS (SELECT *, {POINT_SQL} FROM g)"""


@query("threshold_sweep", f"WITH {SCORED_SQL}, {sweep_sql('SELECT 0.1::DOUBLE + i * 0.1::DOUBLE FROM range(9) AS r(i)')} SELECT {outputs(SWEEP)} FROM f")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.threshold_sweep(scored(spark, sf)))


@query("threshold_sensitivity", f"WITH {SCORED_SQL}, {sweep_sql('SELECT greatest(0.01::DOUBLE, 0.5::DOUBLE * x::DOUBLE) FROM (VALUES (0.8), (0.9), (1.0), (1.1), (1.2)) AS t(x)')} SELECT {outputs(SWEEP)} FROM f")
def threshold_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return finish(rb.threshold_sensitivity(scored(spark, sf), 0.5))


@query("calibration_bins", f"""
WITH {SCORED_SQL}, b AS (SELECT *, len(list_filter([i * 0.1::DOUBLE FOR i IN range(1, 10)], lambda e: e < score)) + 1 AS bin FROM scored),
x AS (SELECT bin, count(*) AS n, avg(label) AS frac_pos, avg(score) AS mean_pred FROM b GROUP BY bin) SELECT {outputs('bin:i n:i frac_pos:d mean_pred:d')} FROM x""")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.reliability_curve(scored(spark, sf)))


@query("ece_mce", f"""
WITH {SCORED_MODELS_SQL}, b AS (SELECT *, len(list_filter([i * 0.1::DOUBLE FOR i IN range(0, 11)], lambda e: e < score)) AS bin FROM scored),
p AS (SELECT model, bin, count(*) AS n, abs(avg(score) - avg(label)) AS gap FROM b GROUP BY model, bin),
x AS (SELECT model, sum(CASE WHEN bin BETWEEN 1 AND 10 THEN gap * n ELSE 0 END) / sum(n) AS ece, max(CASE WHEN bin BETWEEN 1 AND 10 THEN gap END) AS mce FROM p GROUP BY model)
SELECT {outputs('model:s ece:d mce:d')} FROM x""")
def ece_mce(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.calibration_error(scored_models(spark, sf), group_by=BY))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.bootstrap_ci(scored(spark, sf), 0.5, FPR, 500))


TEMP_SQL = """
temp AS (SELECT t AS temperature, label, least(greatest(1 / (1 + exp(-(ln(p / (1 - p))) / t)), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS score
  FROM (SELECT label, least(greatest(score, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p FROM scored) CROSS JOIN (VALUES (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE)) AS v(t))"""


@query("temperature_sweep", f"""
WITH {SCORED_SQL}, {TEMP_SQL}, c AS ({confusion_sql('0.45', 'temperature', 'temp')}),
b AS (SELECT temperature, avg((score - label) ** 2) AS brier, avg(-CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END) AS log_loss FROM temp GROUP BY temperature),
f AS (SELECT c.*, brier, log_loss, {POINT_SQL} FROM c JOIN b USING (temperature))
SELECT {outputs('temperature:d tp:i fp:i tn:i fn:i brier:d log_loss:d accuracy:d precision:d recall:d f1:d fpr:d tpr:d')} FROM f""")
def temperature_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return finish(rb.temperature_sweep(scored(spark, sf), 0.45, ranking=False))


FOLD_SQL = "folded AS (SELECT *, (doc_id * 31 % 97) % 5 AS fold FROM scored)"


@query("fold_summary", f"""
WITH {SCORED_SQL}, {FOLD_SQL},
a AS (SELECT fold, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM folded GROUP BY fold),
p AS (SELECT x.fold, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS s FROM folded x JOIN folded y ON x.fold = y.fold AND x.label = 1 AND y.label = 0 GROUP BY x.fold),
f AS (SELECT a.fold, CAST(s AS DOUBLE) / (n_pos * n_neg) AS auc FROM a LEFT JOIN p USING (fold)),
x AS (SELECT count(*) AS n_folds, count(auc) AS roc_auc_folds, avg(auc) AS roc_auc_mean, stddev_pop(auc) AS roc_auc_std FROM f)
SELECT {outputs('n_folds:i roc_auc_folds:i roc_auc_mean:d roc_auc_std:d')} FROM x""")
def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    folded = scored(spark, sf).withColumn("fold", F.pmod(F.pmod(F.col("doc_id") * 31, F.lit(97)), F.lit(5)))
    return finish(mt.fold_summary(mt.fold_metrics(folded), ["roc_auc"]))


@query("class_balance", f"""
WITH {SCORED_SQL}, x AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg, avg(label) AS pos_rate FROM scored GROUP BY source),
w AS (SELECT count(*) / (2.0 * count(*) FILTER (WHERE label = 1)) AS weight_pos, count(*) FILTER (WHERE label = 0) / greatest(count(*) FILTER (WHERE label = 1), 1) * 0.8::DOUBLE AS scale_pos_weight,
  count(DISTINCT source) AS n_groups FROM scored)
SELECT {outputs('source:s n:i n_pos:i n_neg:i pos_rate:d weight_pos:d scale_pos_weight:d n_groups:i')} FROM x CROSS JOIN w""")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    weights = sp.class_weights(rows)
    return finish(mt.class_balance(rows, group_by=["source"]).withColumns({
        "weight_pos": weights.select("weight_pos").scalar(), "scale_pos_weight": weights.select("scale_pos_weight").scalar(),
        "n_groups": rows.agg(F.count_distinct("source")).scalar()}))


@query("value_shares", "WITH x AS (SELECT event_type AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY event_type) "
       f"SELECT {outputs('value:s n:i share:d')} FROM x")
def value_shares(spark: SparkSession, sf: str) -> DataFrame:
    return finish(mt.value_shares(read_table(spark, sf, "events"), "event_type"))


@query("group_error_stats", f"""
WITH {SCORED_SQL}, g AS (SELECT source, count(*) AS n, avg(label) AS pos_rate, count(*) FILTER (WHERE (score >= 0.5) <> (label = 1)) AS n_errors FROM scored GROUP BY source),
t AS (SELECT source, row_number() OVER (ORDER BY n_errors DESC, source) AS place FROM g WHERE n_errors > 0),
e AS (SELECT count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) AS n_all FROM scored),
x AS (SELECT g.source, n, pos_rate, CASE WHEN place <= 5 THEN n_errors END AS top_errors, fp / n_all AS fp_share, fn / n_all AS fn_share FROM g LEFT JOIN t USING (source) CROSS JOIN e)
SELECT {outputs('source:s n:i pos_rate:d top_errors:i fp_share:d fn_share:d')} FROM x""")
def group_error_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    top = ex.top_error_groups(rows, "source").withColumnRenamed("n_errors", "top_errors")
    summary = ex.error_summary(rows)
    return finish(ex.group_stats(rows, "source").join(top, "source", "left").withColumns({
        "fp_share": summary.select("fp_share").scalar(), "fn_share": summary.select("fn_share").scalar()}))


@query("error_rows", f"""
WITH {SCORED_SQL}, x AS (SELECT doc_id, label AS true_label, CAST(score >= 0.5 AS INT) AS predicted_label, score AS confidence, CASE WHEN score >= 0.5 THEN 'FP' ELSE 'FN' END AS error_kind FROM scored WHERE CAST(score >= 0.5 AS INT) <> label)
SELECT {outputs('doc_id:i true_label:i predicted_label:i confidence:d error_kind:s')} FROM x""")
def error_rows(spark: SparkSession, sf: str) -> DataFrame:
    return finish(ex.error_rows(scored(spark, sf)).select("doc_id", "true_label", "predicted_label", "confidence", "error_kind"))


@query("score_abstain", f"""
WITH {SCORED_SQL} SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN score <= 0.4::DOUBLE THEN 0 WHEN score >= 0.6::DOUBLE THEN 1 ELSE -1 END AS BIGINT) AS verdict,
  CAST(score >= 0.5 AS BIGINT) AS is_phishing FROM scored""")
def score_abstain(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sc.decide(scored(spark, sf), 0.5, 0.1).select("doc_id", "verdict", "is_phishing"))


@query("confidence_tiers", f"""
WITH {SCORED_MODELS_SQL}, s AS (SELECT model, doc_id, score, abs(score - 0.5::DOUBLE) * 2 AS d, abs(score - 0.5::DOUBLE) AS t FROM scored)
SELECT model, CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN d > 0.8 THEN 'Very High' WHEN d > 0.6 THEN 'High' WHEN d > 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_by_half,
  CASE WHEN t > 0.3 THEN 'high' WHEN t > 0.15 THEN 'medium' ELSE 'low' END AS confidence_by_threshold,
  CASE WHEN score > 0.9 OR score < 0.1 THEN 'high' ELSE 'medium' END AS confidence_by_extreme,
  CASE WHEN score > 0.9 THEN 'CRITICAL' WHEN score > 0.7 THEN 'HIGH' WHEN score > 0.5 THEN 'MEDIUM' WHEN score > 0.3 THEN 'LOW' ELSE 'SAFE' END AS risk_level FROM s""")
def confidence_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sc.decide(scored_models(spark, sf)).select(
        "model", "doc_id", "confidence_by_half", "confidence_by_threshold", "confidence_by_extreme", "risk_level"))


@query("batch_summary", f"""
WITH {SCORED_MODELS_SQL}, x AS (SELECT model, count(*) AS total, count(*) FILTER (WHERE score >= 0.5) AS phishing_count, count(*) FILTER (WHERE score < 0.5) AS safe_count,
  count(*) FILTER (WHERE score >= 0.5) * 100.0 / count(*) AS phishing_pct, avg(score) AS mean_probability FROM scored GROUP BY model)
SELECT {outputs('model:s total:i phishing_count:i safe_count:i phishing_pct:d mean_probability:d')} FROM x""")
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sc.batch_summary(scored_models(spark, sf), 0.5, BY))


@query("running_counters", """
WITH x AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS total_predictions, count(*) FILTER (WHERE event_type = 'error') AS phishing_detected,
  count(*) FILTER (WHERE event_type <> 'error') AS safe_count, avg(value) AS avg_latency, count(*) FILTER (WHERE event_type = 'error') * 100.0 / count(*) AS phishing_rate_pct FROM events GROUP BY 1) """
       f"SELECT {outputs('hour:s total_predictions:i phishing_detected:i safe_count:i avg_latency:d phishing_rate_pct:d')} FROM x")
def running_counters(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("event_type") == "error").cast("int").alias("hit"), "value")
    return finish(sc.running_counters(events, "hit", "value", ["hour"]))


@query("probability_utils", f"""
WITH {SCORED_SQL}, x AS (SELECT doc_id, 1 / (1 + exp(-least(greatest(score * 50 - 25, -20), 20))) AS squashed, least(greatest(score, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS clipped,
  CAST(score >= 0.5 AS INT) AS hit, '{{"doc_id":' || doc_id || ',"label":' || label || '}}' AS report, label AS reread FROM scored)
SELECT {outputs('doc_id:i squashed:d clipped:d hit:i report:s reread:i')} FROM x""")
def probability_utils(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf)
    p = F.col("score")
    made = rows.select("doc_id", pr.sigmoid(p * 50 - 25).alias("squashed"), pr.clip_probability(p).alias("clipped"),
                       pr.at_least(p, 0.5).alias("hit"), F.to_json(F.struct("doc_id", "label")).alias("report"))
    return finish(made.withColumn("reread", F.from_json("report", "doc_id bigint, label int")["label"]))


@query("expectation_check", f"""
WITH {SCORED_SQL}, v AS (SELECT doc_id, CASE WHEN score <= 0.45::DOUBLE THEN 0 WHEN score >= 0.55::DOUBLE THEN 1 ELSE -1 END AS verdict, CASE WHEN label = 1 THEN 'PHISHING' ELSE 'SAFE' END AS expected FROM scored),
x AS (SELECT *, CASE verdict WHEN 1 THEN 'PHISHING' WHEN 0 THEN 'SAFE' ELSE 'UNCERTAIN' END AS verdict_label, CAST((verdict = 1 AND expected = 'PHISHING') OR (verdict = 0 AND expected = 'SAFE') AS INT) AS matches FROM v)
SELECT {outputs('doc_id:i verdict:i expected:s verdict_label:s matches:i')} FROM x""")
def expectation_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("doc_id", pr.verdict(F.col("score")).alias("verdict"),
                                    F.when(F.col("label") == 1, "PHISHING").otherwise("SAFE").alias("expected"))
    return finish(mt.expectation_check(rows))


@query("group_metrics", f"""
WITH {SCORED_SQL}, c AS ({confusion_sql('0.5', 'source')}), f AS (SELECT *, {POINT_SQL} FROM c)
SELECT {outputs('source:s tp:i fp:i tn:i fn:i accuracy:d precision:d recall:d f1:d')} FROM f""")
def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return finish(rb.group_metrics(scored(spark, sf), "source", ranking=False).select(
        "source", "tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1"))
