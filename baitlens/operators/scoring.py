"""Batch scoring: verdicts, tiers, totals, and rows that cannot be scored."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability as pr


def decide(scored: DataFrame, threshold: float = 0.5, band: float = 0.05, score: str = "score") -> DataFrame:
    """Verdict with abstain band and the three confidence scales."""
    p = F.col(score)
    return scored.withColumns({
        "verdict": pr.verdict(p, threshold, band),
        "is_phishing": pr.at_least(p, threshold),
        "confidence_by_half": pr.confidence_by_half(p),
        "confidence_by_threshold": pr.confidence_by_threshold(p, threshold),
        "confidence_by_extreme": pr.confidence_by_extreme(p),
        "risk_level": pr.risk_level(p),
    })


def batch_summary(scored: DataFrame, threshold: float = 0.5, group_by: Sequence[str] = (),
                  score: str = "score") -> DataFrame:
    """Totals, share and mean probability of a scored batch."""
    hit = F.col(score) >= threshold
    return scored.groupBy(*group_by).agg(
        F.count("*").alias("total"), F.count_if(hit).alias("phishing_count"), F.count_if(~hit).alias("safe_count"),
        (F.count_if(hit) * 100.0 / F.count("*")).alias("phishing_pct"), F.avg(score).alias("mean_probability"),
    )


def running_counters(scored: DataFrame, flagged: str, latency: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Totals, both verdict counts, mean latency and positive rate in per cent."""
    return scored.groupBy(*group_by).agg(
        F.count("*").alias("total_predictions"), F.count_if(F.col(flagged) == 1).alias("phishing_detected"),
        F.count_if(F.col(flagged) == 0).alias("safe_count"), F.avg(latency).alias("avg_latency"),
        (F.count_if(F.col(flagged) == 1) * 100.0 / F.count("*")).alias("phishing_rate_pct"),
    )


def probability_column(scored: DataFrame, output: str = "score") -> DataFrame:
    """Probability of class 1, else the squashed decision value, else the hard label."""
    if "probability" in scored.columns:
        return scored.withColumn(output, vector_to_array("probability")[1])
    if "rawPrediction" in scored.columns:
        return scored.withColumn(output, pr.sigmoid(vector_to_array("rawPrediction")[1]))
    return scored.withColumn(output, F.col("prediction").cast("double"))


def score_table(df: DataFrame, model: Transformer, prepare: Callable[[DataFrame], DataFrame] | None = None,
                threshold: float = 0.5, band: float = 0.05) -> DataFrame:
    """Prepare, transform, read the probability and decide."""
    ready = prepare(df) if prepare else df
    return decide(probability_column(model.transform(ready)), threshold, band)


def mark_bad_rows(df: DataFrame, required: Sequence[str], output: str = "error") -> DataFrame:
    """An error text on rows that lack a required value; the batch goes on without them being scored."""
    reason = None
    for c in required:
        missing = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        text = F.lit(f"missing {c}")
        reason = F.when(missing, text) if reason is None else reason.when(missing, text)
    return df.withColumn(output, reason)


def score_with_errors(df: DataFrame, required: Sequence[str], scorer: Callable[[DataFrame], DataFrame],
                      score: str = "score") -> DataFrame:
    """Score the good rows and keep the bad ones with their error and no score."""
    marked = mark_bad_rows(df, required)
    good = scorer(marked.where(F.col("error").isNull()))
    return good.unionByName(marked.where(F.col("error").isNotNull()), allowMissingColumns=True)


def feature_view(model_name: str, linear: str = "features_lr", tree: str = "features_tree") -> str:
    """The linear model reads the sparse view, every other model the dense one."""
    return linear if model_name == "LR" else tree


def predictor(scorer: Callable[[DataFrame], DataFrame], threshold: float = 0.5,
              output: str = "prediction") -> Callable[[DataFrame], DataFrame]:
    """Frame to labelled frame, the form the drift report takes."""
    return lambda df: scorer(df).withColumn(output, pr.at_least(F.col("score"), threshold))
