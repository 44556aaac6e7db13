"""Cleaning profile of numeric columns: fitted once on train, applied to anything as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ordering import exact_quantiles
from .schema import finite, numeric_columns


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``column value`` (finite doubles only)."""
    wide = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())


def column_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float],
                     accuracy: int | None = None) -> DataFrame:
    """Rows ``column q0 q1 ...``: exact and interpolated, or approximate where an accuracy is given."""
    if accuracy is None:
        return exact_quantiles(long_form(df, columns), "value", quantiles, ["column"])
    approximate = F.percentile_approx("value", F.array(*[F.lit(float(q)) for q in quantiles]), accuracy)
    return (
        long_form(df, columns).groupBy("column").agg(approximate.alias("_q"))
        .select("column", *[F.col("_q")[i].alias(f"q{i}") for i in range(len(quantiles))])
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, mean, both deviations, sample variance, minimum, maximum and bias-adjusted skewness."""
    n = F.col("n")
    per_column = long_form(df, columns).groupBy("column").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"),
        F.var_samp("value").alias("var_samp"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("_skew"),
    )
    adjusted = F.when(n >= 3, F.try_divide(F.col("_skew") * F.sqrt(n * (n - 1)), n - 2))
    return per_column.withColumn("skew", F.nanvl(adjusted, F.lit(None).cast("double"))).drop("_skew")


def low_variance(df: DataFrame, columns: Sequence[str], threshold: float = fv.LOW_VARIANCE) -> list[str]:
    """Columns whose sample variance is below the threshold or undefined (one aggregate row)."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is None or row[c] != row[c] or abs(row[c]) == float("inf")
            or row[c] < threshold]


@dataclass
class ColumnProfile:
    lower: float | None = None
    upper: float | None = None
    log_min: float | None = None
    median: float = 0.0
    mean: float = 0.0
    std: float = 1.0


@dataclass
class Profile:
    """Frozen column order with the statistics of every kept column; stored as a small table."""

    order: list[str]
    removed: list[str] = field(default_factory=list)
    columns: dict[str, ColumnProfile] = field(default_factory=dict)

    SCHEMA = "position int, column string, removed boolean, lower double, upper double, log_min double, " \
             "median double, mean double, std double"

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, False, p.lower, p.upper, p.log_min, p.median, p.mean, p.std)
                for i, c in enumerate(self.order) for p in [self.columns[c]]]
        rows += [(-1, c, True, None, None, None, None, None, None) for c in self.removed]
        return spark.createDataFrame(rows, self.SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> Profile:
        rows = table.orderBy("position", "column").collect()
        kept = [r for r in rows if not r["removed"]]
        return Profile(
            [r["column"] for r in kept], [r["column"] for r in rows if r["removed"]],
            {r["column"]: ColumnProfile(r["lower"], r["upper"], r["log_min"], r["median"], r["mean"], r["std"])
             for r in kept},
        )


def _clipped(c: Column, p: ColumnProfile) -> Column:
    return c if p.lower is None else F.greatest(F.least(c, F.lit(p.upper)), F.lit(p.lower))


def _keep_null(source: Column, value: Column) -> Column:
    return F.when(source.isNotNull(), value)


def _transformed(c: str, p: ColumnProfile, log_min: float | None) -> Column:
    """Clip and log-transform; null stays null."""
    source = finite(F.col(c).cast("double"))
    value = _clipped(source, p)
    if log_min is not None:
        value = F.log1p(value - F.lit(log_min) + F.lit(1.0))
    return _keep_null(source, value)


def _skewed(df: DataFrame, columns: dict[str, Column], limit: float) -> dict[str, float]:
    """Minimum of every column whose adjusted skewness exceeds the limit."""
    stats = moments(df.select(*[c.alias(n) for n, c in columns.items()]), list(columns)).collect()
    return {r["column"]: r["min"] for r in stats if r["skew"] is not None and abs(r["skew"]) > limit}


def fit_profile(train: DataFrame, columns: Sequence[str] | None = None, variance: float = fv.LOW_VARIANCE,
                whisker: float = 3.0, skew_limit: float = 1.0, accuracy: int | None = None) -> Profile:
    """Low-variance removal, clip bounds, log shifts, medians, mean and deviation, each on the previous step."""
    names = list(columns) if columns is not None else numeric_columns(train)
    removed = low_variance(train, names, variance)
    kept = [c for c in names if c not in removed]
    profile = Profile(kept, removed, {c: ColumnProfile() for c in kept})
    if not kept:
        return profile
    for r in column_quantiles(train, kept, [0.25, 0.75], accuracy).collect():
        if r["q0"] != r["q1"]:
            spread = r["q1"] - r["q0"]
            p = profile.columns[r["column"]]
            p.lower, p.upper = r["q0"] - whisker * spread, r["q1"] + whisker * spread
    clipped = {c: _transformed(c, profile.columns[c], None) for c in kept}
    for name, low in _skewed(train, clipped, skew_limit).items():
        profile.columns[name].log_min = low
    shaped = train.select(*[_transformed(c, p, p.log_min).alias(c) for c, p in profile.columns.items()])
    for r in column_quantiles(shaped, kept, [0.5], accuracy).collect():
        profile.columns[r["column"]].median = r["q0"]
    filled = shaped.select(*[F.coalesce(F.col(c), F.lit(profile.columns[c].median)).alias(c) for c in kept])
    aggregates = [f(c).alias(f"{n}_{c}") for c in kept for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    row = filled.agg(*aggregates).first()
    for c in kept:
        profile.columns[c].mean = row[f"avg_{c}"] or 0.0
        profile.columns[c].std = row[f"std_{c}"] or 1.0
    return profile


def apply_profile(df: DataFrame, profile: Profile, keep: Sequence[str] = (), scale: bool = True,
                  refit_skew: bool = False, skew_limit: float = 1.0) -> DataFrame:
    """One projection; ``refit_skew`` decides the log transform from the frame at hand instead of the profile."""
    present = [c for c in profile.order if c in df.columns]
    log_min = {c: profile.columns[c].log_min for c in present}
    if refit_skew:
        clipped = {c: _transformed(c, profile.columns[c], None) for c in present}
        found = _skewed(df, clipped, skew_limit)
        log_min = {c: found.get(c) for c in present}

    def final(c: str) -> Column:
        p = profile.columns[c]
        if c not in present:
            value = F.lit(0.0)
        else:
            value = F.coalesce(_transformed(c, p, log_min[c]), F.lit(p.median))
        return ((value - F.lit(p.mean)) / F.lit(p.std)) if scale else value

    return df.select(*keep, *[final(c).alias(c) for c in profile.order])


def clean(train: DataFrame, *others: DataFrame, keep: Sequence[str] = (), columns: Sequence[str] | None = None,
          **options) -> tuple[Profile, list[DataFrame]]:
    """Fit on train (exact copies removed there only) and apply to every frame."""
    unique = train.dropDuplicates()
    profile = fit_profile(unique, columns, **options)
    return profile, [apply_profile(f, profile, keep) for f in (unique, *others)]


def robust_scale(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                 fitted_on: DataFrame | None = None, accuracy: int | None = None) -> DataFrame:
    """Divide by the interquartile range without centring; a zero range divides by 1."""
    source = df if fitted_on is None else fitted_on
    widths = {r["column"]: (r["q1"] - r["q0"]) or 1.0
              for r in column_quantiles(source, columns, [0.25, 0.75], accuracy).collect()}
    return df.select(*keep, *[
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / F.lit(widths.get(c, 1.0))).alias(c) for c in columns
    ])
