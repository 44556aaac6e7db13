"""Drift of a new table against a frozen baseline: histograms, labels, accuracy, means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import broadcast_if_small
from .metrics import value_shares

BASELINE_SCHEMA = "feature string, counts array<bigint>, edges array<double>, mean double, std double"
LN2 = 0.6931471805599453


def feature_values(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(list(ids), list(features), "feature", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def single(value: Column) -> Column:
    """Value as kept by a single-precision histogram."""
    return value.cast("float").cast("double")


def _edges(low: Column, high: Column, bins: int) -> Column:
    widen = F.when(low == 0, F.lit(1e-6)).otherwise(F.abs(low) * 1e-6)
    lo = F.when(low == high, low - widen).otherwise(low)
    hi = F.when(low == high, high + widen).otherwise(high)
    step = (hi - lo) / F.lit(float(bins))
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, single(hi)).otherwise(single(lo + i * step))
    )


def bin_index(value: Column, edges: Column, bins: int) -> Column:
    """0-based bin [lo, hi), the last one closed; null outside the range."""
    reached = F.size(F.filter(edges, lambda e: e <= value)) - 1
    index = F.when(value == F.element_at(edges, -1), F.lit(bins - 1)).otherwise(reached)
    return F.when((index >= 0) & (index < bins) & (value <= F.element_at(edges, -1)), index)


def dense_counts(bins: int, entries: Column) -> Column:
    """Array of counts per bin from (bin, n) entries."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.aggregate(
            F.transform(F.filter(entries, lambda e: e["bin"] == i), lambda e: e["n"]),
            F.lit(0).cast("bigint"), lambda a, x: a + x),
    )


def histogram(long: DataFrame, edges: DataFrame, bins: int, group_by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin on given edges (one row per feature), with the rows outside all bins counted apart."""
    joined = long.join(broadcast_if_small(edges.select("feature", "edges")), "feature")
    binned = joined.groupBy(*group_by, "feature", bin_index(F.col("value"), F.col("edges"), bins).alias("bin")).agg(
        F.count("*").alias("n")
    )
    return binned.groupBy(*group_by, "feature").agg(
        F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))).alias("_entries"),
        F.coalesce(F.sum(F.when(F.col("bin").isNull(), F.col("n"))), F.lit(0)).alias("out_of_range"),
    ).select(*group_by, "feature", dense_counts(bins, F.col("_entries")).alias("counts"), "out_of_range")


def establish_baseline(df: DataFrame, features: Sequence[str], bins: int = fv.DRIFT_BINS) -> DataFrame:
    """One row per feature: single-precision histogram, mean and population deviation (0 becomes 1)."""
    long = feature_values(df, features)
    bounded = long.where(F.abs("value") != F.lit(float("inf")))
    as_single = bounded.withColumn("value", single(F.col("value")))
    edges = as_single.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).select(
        "feature", _edges(F.col("_lo"), F.col("_hi"), bins).alias("edges")
    )
    counts = histogram(as_single, edges, bins).drop("out_of_range")
    deviation = F.stddev_pop("value")
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias("std")
    )
    return counts.join(edges, "feature").join(stats, "feature").select("feature", "counts", "edges", "mean", "std")


def psi(expected: Column, actual: Column, epsilon: float = fv.DRIFT_EPSILON) -> Column:
    """Population stability index of two count arrays."""
    def shares(counts: Column) -> Column:
        padded = F.transform(counts, lambda c: c.cast("double") + epsilon)
        total = F.aggregate(padded, F.lit(0.0), lambda a, x: a + x)
        return F.transform(padded, lambda x: x / total)

    terms = F.zip_with(shares(expected), shares(actual), lambda p, q: (q - p) * F.ln(q / p))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def data_drift(baseline: DataFrame, new: DataFrame, bins: int = fv.DRIFT_BINS, group_by: Sequence[str] = (),
               limit: float = fv.PSI_FEATURE_LIMIT) -> DataFrame:
    """PSI per feature on the frozen bins; values outside are left out but counted."""
    features = [r["feature"] for r in baseline.select("feature").collect()]
    current = histogram(feature_values(new, [f for f in features if f in new.columns], group_by), baseline, bins, group_by)
    joined = current.withColumnRenamed("counts", "new_counts").join(broadcast_if_small(baseline), "feature")
    value = psi(F.col("counts"), F.col("new_counts"))
    return joined.select(*group_by, "feature", value.alias("psi"), "out_of_range").withColumn(
        "drifted", F.col("psi") > limit
    )


def mean_shift(baseline: DataFrame, new: DataFrame, limit: float = fv.MEAN_SHIFT_LIMIT,
               group_by: Sequence[str] = ()) -> DataFrame:
    """Distance of the new mean from the baseline mean in baseline deviations."""
    features = [r["feature"] for r in baseline.select("feature").collect()]
    means = feature_values(new, [f for f in features if f in new.columns], group_by).groupBy(*group_by, "feature").agg(
        F.avg("value").alias("new_mean")
    )
    z = F.abs(F.col("new_mean") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return means.join(broadcast_if_small(baseline), "feature").select(
        *group_by, "feature", F.col("mean").alias("baseline_mean"), "new_mean", z.alias("z_score")
    ).withColumn("shifted", F.col("z_score") > limit)


def label_shares(df: DataFrame, label: str) -> DataFrame:
    return value_shares(df, label).select("value", "share")


def label_drift(baseline_shares: DataFrame, new_shares: DataFrame, epsilon: float = fv.DRIFT_EPSILON) -> DataFrame:
    """One row: Jensen-Shannon divergence in nats over the union of the label values."""
    base = baseline_shares.select(F.col("value").alias("_bv"), F.col("share").alias("_b"))
    both = base.join(new_shares.select(F.col("value").alias("_nv"), F.col("share").alias("_n")),
                     F.col("_bv").eqNullSafe(F.col("_nv")), "full_outer")
    raw = both.select((F.coalesce("_b", F.lit(0.0)) + epsilon).alias("p"),
                      (F.coalesce("_n", F.lit(0.0)) + epsilon).alias("q"))
    whole = raw.agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    shares = raw.select(*[(F.col(c) / F.lit(whole[c])).alias(c) for c in ("p", "q")])
    middle = (F.col("p") + F.col("q")) * 0.5
    return shares.agg(
        (F.sum(F.col("p") * F.ln(F.col("p") / middle)) * 0.5 + F.sum(F.col("q") * F.ln(F.col("q") / middle)) * 0.5)
        .alias("js_divergence")
    )


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return predicted.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def drift_report(baseline: DataFrame, new: DataFrame, baseline_labels: DataFrame | None = None,
                 label: str | None = None, baseline_accuracy: Column | None = None,
                 new_accuracy: Column | None = None, alert: float = fv.DRIFT_ALERT) -> DataFrame:
    """One row: the parts, the overall score 0.5*PSI + 0.2*JS/ln2 + 0.3*accuracy loss, and the alert."""
    per_feature = data_drift(baseline, new).agg(
        F.avg("psi").alias("psi_mean"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "psi")))).alias("psi_scores"),
        F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
    )
    shifts = mean_shift(baseline, new).agg(F.sort_array(F.collect_list(F.when(
        F.col("shifted"), F.struct("feature", "z_score", "new_mean", "baseline_mean")
    ))).alias("feature_drift"))
    js = F.lit(None).cast("double")
    if baseline_labels is not None and label is not None:
        js = label_drift(baseline_labels, label_shares(new, label)).scalar()
    base_acc = F.lit(None).cast("double") if baseline_accuracy is None else baseline_accuracy
    new_acc = F.lit(None).cast("double") if new_accuracy is None else new_accuracy
    row = per_feature.withColumns({
        "feature_drift": shifts.scalar(), "js_divergence": js,
        "baseline_accuracy": base_acc, "new_accuracy": new_acc,
    }).withColumn("accuracy_degradation", F.col("baseline_accuracy") - F.col("new_accuracy"))
    overall = (
        F.lit(0.5) * F.coalesce("psi_mean", F.lit(0.0))
        + F.lit(0.2) * F.coalesce(F.col("js_divergence") / LN2, F.lit(0.0))
        + F.lit(0.3) * F.greatest(F.lit(0.0), F.coalesce("accuracy_degradation", F.lit(0.0)))
    )
    return row.withColumn("overall_drift_score", overall).withColumn(
        "alert_triggered", F.col("overall_drift_score") > alert
    )


def top_drifted(per_feature: DataFrame, top: int = 5) -> DataFrame:
    return per_feature.orderBy(F.desc("psi"), "feature").limit(top)


def history_tail(history: DataFrame, ts: str = "ts", keep: int = fv.HISTORY_LIMIT) -> DataFrame:
    """The latest records of the append-only history."""
    return history.orderBy(F.desc(ts)).limit(keep)


def last_record(history: DataFrame, ts: str = "ts") -> DataFrame:
    return history.orderBy(F.desc(ts)).limit(1)


def is_alert(report: DataFrame) -> bool:
    row = report.select("alert_triggered").first()
    return bool(row and row[0])

