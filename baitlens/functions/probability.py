"""Probability arithmetic, decisions and verdict bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def sigmoid(score: Column, bound: float = 20.0) -> Column:
    clipped = F.greatest(F.least(score, F.lit(bound)), F.lit(-bound))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def clip_probability(p: Column, epsilon: float = fv.PROBABILITY_EPSILON) -> Column:
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1.0 - epsilon))


def temperature_scale(p: Column, temperature: Column | float) -> Column:
    """Divide the logit by a temperature."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    safe = clip_probability(p)
    logit = F.ln(safe / (F.lit(1.0) - safe))
    return clip_probability(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit / t)))


def at_least(p: Column, threshold: Column | float) -> Column:
    return (p >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))).cast("int")


def verdict(p: Column, threshold: float = 0.5, band: float = 0.05) -> Column:
    """0 below, 1 above, -1 inside the abstain band."""
    low, high = max(0.0, threshold - band), min(1.0, threshold + band)
    return F.when(p <= low, 0).when(p >= high, 1).otherwise(-1)


def confidence_by_half(p: Column) -> Column:
    distance = F.abs(p - 0.5) * 2
    return (
        F.when(distance > 0.8, "Very High").when(distance > 0.6, "High").when(distance > 0.4, "Medium").otherwise("Low")
    )


def confidence_by_threshold(p: Column, threshold: float = 0.5) -> Column:
    distance = F.abs(p - F.lit(threshold))
    return F.when(distance > 0.3, "high").when(distance > 0.15, "medium").otherwise("low")


def confidence_by_extreme(p: Column) -> Column:
    return F.when((p > 0.9) | (p < 0.1), "high").otherwise("medium")


def risk_level(p: Column) -> Column:
    return (
        F.when(p > 0.9, "CRITICAL").when(p > 0.7, "HIGH").when(p > 0.5, "MEDIUM").when(p > 0.3, "LOW")
        .otherwise("SAFE")
    )


def binary_metrics(tp: Column, fp: Column, tn: Column, fn: Column, cost_fp: float = fv.COST_FP,
                   cost_fn: float = fv.COST_FN, f1_epsilon: float = 1e-12) -> dict[str, Column]:
    """Rates of a confusion table; an empty denominator gives 0."""
    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "fpr": share(fp, fp + tn),
        "f1": F.lit(2.0) * (precision * recall) / (precision + recall + F.lit(f1_epsilon))
        if f1_epsilon else share(F.lit(2.0) * precision * recall, precision + recall),
        "accuracy": share(tp + tn, tp + tn + fp + fn),
        "cost": fp * F.lit(cost_fp) + fn * F.lit(cost_fn),
    }


def combined_score(precision: Column, recall: Column, fpr: Column, f1: Column, cost: Column) -> Column:
    """Weighted score that ranks models against each other."""
    return (
        f1 * 0.35 + recall * 0.30 + precision * 0.15 + (F.lit(1.0) - fpr) * 0.10
        + (F.lit(1.0) / (F.lit(1.0) + F.lit(0.01) * cost)) * 0.10
    )
