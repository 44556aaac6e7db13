"""Perturbation sweep: every row under every perturbation in one pass, metrics grouped by perturbation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import clip_probability, temperature_scale
from .curve import grid_confusion, literal_grid, score_counts
from .metrics import metrics_row, point_metrics

Change = Callable[[Column], Column]


@dataclass(frozen=True)
class Perturbation:
    """Named change of some feature columns; columns a table lacks are left out."""

    suite: str
    name: str
    changes: dict[str, Change] = field(default_factory=dict)
    all_columns: Change | None = None


def _times(factor: float) -> Change:
    return lambda c: c * F.lit(factor)


def _set(value: float) -> Change:
    return lambda c: F.lit(value)


# --- fixed values: perturbations of the robustness suites ------------------------------------------

OBFUSCATION = [
    Perturbation("obfuscation", "homoglyphs", {
        "url_entropy": _times(1.20), "has_homograph": _set(1.0), "num_dots": lambda c: c + F.lit(1.0)}),
    Perturbation("obfuscation", "url_encoding", {"url_length": _times(1.50), "special_char_ratio": _times(2.00)}),
    Perturbation("obfuscation", "zero_width", {"char_count": _times(1.10), "text_entropy": _times(0.90)}),
    Perturbation("obfuscation", "leetspeak", {
        "text_entropy": _times(1.15), "digits_in_text": lambda c: c * F.lit(1.20) + F.lit(1.0)}),
]
TEMPORAL_FACTORS = {"current": 1.00, "1_month": 1.05, "3_months": 1.15, "6_months": 1.30}
LANGUAGE_FACTORS = {"english": 1.00, "spanish": 0.95, "arabic": 1.10, "chinese": 1.20}
TEMPERATURES = [0.8, 1.0, 1.2, 1.5]
THRESHOLD_FACTORS = [0.8, 0.9, 1.0, 1.1, 1.2]
ADVERSARIAL_COLUMNS = ["url_entropy", "num_dots", "has_homograph", "urgency_score", "char_count", "digits_in_text"]
ADVERSARIAL_STEP, OTHER_STEP = 0.10, 0.02

TEMPORAL = [Perturbation("temporal_drift", n, all_columns=_times(f)) for n, f in TEMPORAL_FACTORS.items()]
MULTILINGUAL = [Perturbation("multilingual", n, {"text_entropy": _times(f)}) for n, f in LANGUAGE_FACTORS.items()]


def _coin(row_id: str, seed: int, share: float) -> Column:
    """Reproducible coin of a row."""
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000)) / 1_000_000.0
    return F.when(draw < share, 1.0).otherwise(0.0)


def uniform(row_id: str, seed: int, *salt: str) -> Column:
    """Reproducible number in (0, 1) of a row."""
    hashed = F.pmod(F.xxhash64(F.lit(seed), *[F.lit(s) for s in salt], F.col(row_id)), F.lit(1 << 40))
    return (hashed + 0.5) / float(1 << 40)


def normal(row_id: str, seed: int, salt: str) -> Column:
    """Reproducible standard normal number of a row (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(row_id, seed, salt, "r")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(row_id, seed, salt, "a"))


def random_suites(row_id: str, features: Sequence[str], seed: int = 42) -> list[Perturbation]:
    """The perturbations that draw numbers: case variation, simulated domains, shorteners, additive noise."""
    def noise(column: str) -> Change:
        drawn = normal(row_id, seed, column)
        if column in ADVERSARIAL_COLUMNS:
            return lambda c: c + F.lit(ADVERSARIAL_STEP) * F.abs(drawn)
        return lambda c: c + F.lit(OTHER_STEP) * drawn

    short = {c: (lambda _, s=c: _coin(row_id, seed, 0.5)) for c in ("has_url_shortener", "url_shortener")}
    return [
        Perturbation("obfuscation", "case_variation", {"all_caps_ratio": lambda _: uniform(row_id, seed, "caps")}),
        Perturbation("domain_shift", "financial", {"urgency_score": _times(1.30)}),
        Perturbation("domain_shift", "ecommerce", {"has_form": _set(1.0), "form_present": _set(1.0)}),
        Perturbation("domain_shift", "social_media", {
            c: (lambda _: _coin(row_id, seed + 1, 0.3)) for c in ("has_url_shortener", "url_shortener")}),
        Perturbation("domain_shift", "government", {"has_ip_in_url": _set(0.0)}),
        Perturbation("url_shorteners", "shortened", {**short, "url_length": _times(0.30)}),
        Perturbation("adversarial", "noise", {c: noise(c) for c in features}),
    ]


DETERMINISTIC = [*OBFUSCATION, *TEMPORAL, *MULTILINGUAL]


def perturb(df: DataFrame, features: Sequence[str], perturbations: Sequence[Perturbation],
            keep: Sequence[str] = ()) -> DataFrame:
    """Rows times perturbations (a bounded list, unfolded inside the projection), plus the unchanged ``baseline``."""
    def variant(p: Perturbation) -> Column:
        changed = []
        for c in features:
            value = F.col(c).cast("double")
            change = p.changes.get(c) or p.all_columns
            changed.append((change(value) if change else value).alias(c))
        return F.struct(F.lit(p.suite).alias("suite"), F.lit(p.name).alias("perturbation"), *changed)

    variants = [variant(Perturbation("baseline", "none"))] + [variant(p) for p in perturbations]
    return df.select(*keep, F.explode(F.array(*variants)).alias("_v")).select(*keep, "_v.*")


def perturbation_sweep(df: DataFrame, features: Sequence[str], scorer: Callable[[DataFrame], DataFrame],
                       perturbations: Sequence[Perturbation] = tuple(DETERMINISTIC), threshold: float = 0.5,
                       label: str = "label", max_drop: float = 0.10, keep: Sequence[str] = (),
                       ranking: bool = True) -> DataFrame:
    """Metrics per perturbation with the accuracy lost against the baseline and the verdict.

    A perturbation that changes none of the features has the baseline's rows, which are scored once for all of these.
    """
    idle = [p for p in perturbations if not p.all_columns and not set(p.changes) & set(features)]
    scored = scorer(perturb(df, features, [p for p in perturbations if not any(p is i for i in idle)], [label, *keep]))
    scored = scored.withColumn("score", clip_probability(F.col("score")))
    table = metrics_row(scored, threshold, ["suite", "perturbation"], label=label, ranking=ranking)
    if idle:
        own = F.struct("suite", "perturbation")
        same = [F.struct(F.lit(p.suite).alias("suite"), F.lit(p.name).alias("perturbation")) for p in idle]
        baseline = (F.col("suite") == "baseline") & (F.col("perturbation") == "none")
        rows = table.withColumn("_name", F.explode(F.when(baseline, F.array(own, *same)).otherwise(F.array(own))))
        table = rows.select(*[F.col(f"_name.{c}") if c in ("suite", "perturbation") else F.col(f"`{c}`") for c in table.columns])
    # one row per perturbation
    base = F.max(F.when(F.col("suite") == "baseline", F.col("accuracy"))).over(Window.partitionBy())
    lost = table.withColumn("degradation", base - F.col("accuracy"))
    return lost.withColumn("passed", (F.col("degradation") < max_drop).cast("int"))


def group_metrics(scored: DataFrame, group: str, threshold: float = 0.5, ranking: bool = True) -> DataFrame:
    """Metrics per real sender domain or per time part."""
    return metrics_row(scored, threshold, [group], ranking=ranking)


def threshold_sensitivity(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metrics at the threshold times 0.8 ... 1.2, not below 0.01."""
    grid = sorted({max(0.01, threshold * f) for f in THRESHOLD_FACTORS})
    table = grid_confusion(score_counts(scored), literal_grid(grid))
    return table.withColumns(point_metrics(table)).drop("grid_index")


def temperature_sweep(scored: DataFrame, threshold: float = 0.5, temperatures: Sequence[float] = tuple(TEMPERATURES),
                      label: str = "label", ranking: bool = True) -> DataFrame:
    """Metrics after dividing the logits by each temperature."""
    p = clip_probability(F.col("score"))
    variants = F.array(*[
        F.struct(F.lit(float(t)).alias("temperature"), temperature_scale(p, t).alias("score")) for t in temperatures
    ])
    scaled = scored.select(label, F.explode(variants).alias("_v")).select(label, "_v.*")
    return metrics_row(scaled, threshold, ["temperature"], label=label, ranking=ranking)


def robustness_report(df: DataFrame, features: Sequence[str], scorer: Callable[[DataFrame], DataFrame], row_id: str,
                      threshold: float = 0.5, label: str = "label", group: str | None = None) -> dict[str, DataFrame]:
    """All suites as tables: the sweep, threshold and temperature sensitivity, and real groups where given."""
    extra = [row_id] + ([group] if group else [])
    every = [*DETERMINISTIC, *random_suites(row_id, features)]
    scored = scorer(df.select(label, *extra, *features))
    report = {
        "sweep": perturbation_sweep(df, features, scorer, every, threshold, label, keep=[row_id]),
        "threshold_sensitivity": threshold_sensitivity(scored.withColumnRenamed(label, "label"), threshold),
        "temperature": temperature_sweep(scored, threshold, label=label),
    }
    if group:
        report["groups"] = group_metrics(scored.withColumnRenamed(label, "label"), group, threshold)
    return report
