"""Importance, attribution and error tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, discard, materialise
from .curve import HELD_SCORES, packed_columns, packed_ranges, range_areas
from .exchange import packed_table, shuffled_pairs
from .metrics import confusion
from .ordering import numbered


def model_importance(model, features: Sequence[str], spark, original: dict[str, str] | None = None) -> DataFrame:
    """Tree importances or absolute coefficients by feature name (renamed back where a mapping is given)."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    else:
        values = abs(model.coefficients.toArray())
    back = {new: old for old, new in (original or {}).items()}
    rows = [(back.get(f, f), float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, tree_importance double").orderBy(
        F.desc("tree_importance"), "feature")


def merge_importance(features: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left join of importance tables on the feature name, sorted by them in turn, largest first."""
    out = features.select("feature")
    for t in tables:
        out = out.join(t, "feature", "left")
    order = [c for c in ("shap_importance", "tree_importance", "permutation_importance") if c in out.columns]
    return out.orderBy(*[F.desc_nulls_last(c) for c in order], "feature")


#: Rows of a table whose shuffled orders are dealt out in one part; larger tables are dealt out in ``PARTS``, one after the other.
WHOLE_ROWS = 2_000_000
PARTS = 4
#: Rows that are put into shuffled order at once, about.
BUCKET_ROWS = 65_536
#: Features that are scored side by side in one row; of more, each has a row of its own.
SIDE_BY_SIDE = 8


def permutation_importance(df: DataFrame, row_id: str, features: Sequence[str],
                           scorer: Callable[[DataFrame], DataFrame], label: str = "label", repeats: int = 10,
                           seed: int = 42, max_rows: int | None = None, position: str | None = None) -> DataFrame:
    """Mean loss of ROC-AUC when one feature takes another row's value.

    In each repeat a row at position k of the table takes the values of the row at position k of a shuffled order;
    every feature is exchanged on its own inside one projection, so all features are scored in one pass. Repeats and parts
    of the shuffled order come one after the other, and what they wrote is released, so that the disk holds one
    repeat's scores. ``scorer`` adds the column ``score`` and keeps the others. ``position`` names a column that counts the
    rows by ``row_id`` from 1, where there is one.
    """
    spark = df.sparkSession
    rows = df.select(row_id, label, *features)
    if max_rows is not None:
        rows = rows.orderBy(row_id).limit(max_rows)
    if position is None:
        rows = numbered(rows, [row_id], "_pos")
    else:
        rows = df.select(row_id, label, *features, F.col(position).cast("long").alias("_pos"))
        rows = rows if max_rows is None else rows.where(F.col("_pos") <= max_rows)
    n = rows.count()
    bounds = _score_bounds(scorer(rows), n)

    def areas(scores: DataFrame) -> list[tuple[str, float]]:
        return [tuple(r) for r in range_areas(scores, "_feature").collect()]

    whole = scorer(rows.select(label, *features))
    before = materialise(packed_columns(whole, {"": "score"}, "_feature", bounds, label), "scores-before", "none")
    base = dict(areas(before)).get("", 0.0)
    discard(spark, before)
    packed = packed_table(rows, row_id, list(dict.fromkeys([label, *features])))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    losses = []
    for rep in range(repeats):
        stored = []
        pairs = shuffled_pairs(packed, kinds, [label, *features], features, rep, seed, n, BUCKET_ROWS, 1 if n <= WHOLE_ROWS else PARTS)
        for paired in pairs:
            stored.append(materialise(_exchanged_scores(paired, scorer, label, features, bounds), "scores", "none"))
            del paired
            if n > WHOLE_ROWS:
                discard(spark)
        if stored:
            scores = reduce(DataFrame.unionByName, stored)
            losses += [(f, base - a) for f, a in areas(scores)]
            del scores
        discard(spark, *stored)
    discard(spark, packed)
    table = spark.createDataFrame(losses, "feature string, loss double")
    return table.groupBy("feature").agg(
        F.avg("loss").alias("permutation_importance"), F.stddev_pop("loss").alias("permutation_std"),
        F.count("*").alias("repeats"),
    )


def _score_bounds(scored: DataFrame, n: int) -> list[float]:
    """Scores between which about as many rows lie; they only decide which scores a task sorts."""
    parts = min(1 + n // HELD_SCORES, 10_000)
    if parts == 1:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = scored.agg(F.percentile_approx(F.col("score").cast("double"), shares, 10 * parts)).first()[0]
    return sorted({c for c in cuts or [] if c == c})


def _exchanged_scores(paired: DataFrame, scorer: Callable[[DataFrame], DataFrame], label: str, features: Sequence[str],
                      bounds: Sequence[float]) -> DataFrame:
    """Packed scores by ``_feature``: those of the rows with this feature taken from the other row."""
    def cells(exchanged: str) -> list[Column]:
        return [F.col(f"_other_{f}" if f == exchanged else f"_own_{f}").alias(f) for f in features]

    if len(features) > SIDE_BY_SIDE:
        variants = F.array(*[F.struct(F.lit(f).alias("_feature"), *cells(f)) for f in features])
        each = paired.select(F.col(f"_own_{label}").alias(label), F.explode(variants).alias("_v")).select(label, "_v.*")
        return packed_ranges(scorer(each), "_feature", bounds, label=label)
    scored = paired.withColumnRenamed(f"_own_{label}", label)
    held = [c for c in scored.columns if c != label]
    for i, f in enumerate(features):
        done = [f"_score_{j}" for j in range(i)]
        scored = scorer(scored.select(label, *held, *done, *cells(f))).select(label, *held, *done, F.col("score").alias(f"_score_{i}"))
    return packed_columns(scored, {f: f"_score_{i}" for i, f in enumerate(features)}, "_feature", bounds, label)


def linear_attribution(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean absolute attribution coef * (x - mean) per feature of a linear model (two aggregate rows)."""
    names = list(coefficients)
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    row = df.agg(*[
        F.avg(F.abs(F.lit(coefficients[c]) * (F.col(c) - F.lit(means[c])))).alias(c) for c in names
    ])
    return row.unpivot([], names, "feature", "shap_importance").orderBy(F.desc("shap_importance"), "feature")


def array_attribution(df: DataFrame, column: str, coefficients: Sequence[float]) -> DataFrame:
    """The same for an array column: feature is the position; one without a coefficient counts as 0."""
    long = df.select(F.posexplode(column).alias("position", "value")).withColumn("value", F.col("value").cast("double"))
    means = long.groupBy("position").agg(F.avg("value").alias("_mean"))
    coefs = df.sparkSession.createDataFrame(
        [(i, float(c)) for i, c in enumerate(coefficients)], "position int, _coef double")
    # one row per array position
    stats = F.broadcast(means.join(coefs, "position", "left").fillna(0.0, ["_coef"]))
    return long.join(stats, "position").groupBy("position").agg(
        F.avg(F.abs(F.col("_coef") * (F.col("value") - F.col("_mean")))).alias("attribution")
    )


def token_contributions(weights: DataFrame, coefficients: DataFrame, doc: str, top: int = 10) -> DataFrame:
    """Per document the largest positive and negative ``weight * coef`` among the ``2 * top`` largest by size.

    ``coefficients`` has ``term coef``. Contributions of a document are kept as a bounded sorted list per task.
    """
    joined = weights.join(broadcast_if_small(coefficients), "term")
    parts = joined.select(doc, "term", (F.col("weight") * F.col("coef")).alias("contribution")).where(
        F.col("contribution") != 0)
    entry = F.struct((-F.abs("contribution")).alias("k"), "term", "contribution")
    ranked = parts.groupBy(doc).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, 2 * top).alias("_top"))

    def side(sign: int) -> Column:
        chosen = F.filter("_top", lambda e: e["contribution"] * sign > 0)
        return F.slice(chosen, 1, top)

    exploded = ranked.select(doc, F.explode(F.array(
        F.struct(F.lit("positive").alias("side"), side(1).alias("e")),
        F.struct(F.lit("negative").alias("side"), side(-1).alias("e")),
    )).alias("_s"))
    return exploded.select(doc, F.col("_s.side").alias("side"), F.posexplode("_s.e").alias("pos", "e")).select(
        doc, "side", (F.col("pos") + 1).alias("rank"), "e.term", "e.contribution")


def error_rows(scored: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "label") -> DataFrame:
    """Misclassified rows with true label, prediction, confidence and kind of error."""
    predicted = (F.col(score) >= threshold).cast("int")
    return scored.withColumn("predicted_label", predicted).where(F.col("predicted_label") != F.col(label)).withColumns({
        "true_label": F.col(label), "confidence": F.col(score),
        "error_kind": F.when(F.col("predicted_label") == 1, "FP").otherwise("FN"),
    })


def error_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: false positives and negatives and their shares."""
    table = confusion(scored, threshold)
    total = F.greatest(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"), F.lit(1))
    return table.select("fp", "fn", (F.col("fp") / total).alias("fp_share"), (F.col("fn") / total).alias("fn_share"))


def top_error_groups(scored: DataFrame, group: str, threshold: float = 0.5, top: int = 5) -> DataFrame:
    return error_rows(scored, threshold).groupBy(group).agg(F.count("*").alias("n_errors")).orderBy(
        F.desc("n_errors"), group).limit(top)


def group_stats(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows and positive rate per group, largest first."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg((F.col(label) == 1).cast("int")).alias("pos_rate")
                                 ).orderBy(F.desc("n"), group)


def explain(df: DataFrame, row_id: str, features: Sequence[str], coefficients: dict[str, float],
            scorer: Callable[[DataFrame], DataFrame], importance: DataFrame, label: str = "label",
            threshold: float = 0.5, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attribution table, merged importance table and error table."""
    attribution = linear_attribution(df, coefficients)
    permuted = permutation_importance(df, row_id, features, scorer, label, **options).select(
        "feature", "permutation_importance")
    names = importance.select("feature")
    merged = merge_importance(names, attribution, importance, permuted)
    return attribution, merged, error_rows(scorer(df), threshold, label=label)
