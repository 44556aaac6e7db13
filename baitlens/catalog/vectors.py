"""TF-IDF, dense block, oversampling, model and scoring queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import basic_url_features
from ..operators import explain as ex
from ..operators import scoring as sc
from ..operators import splits as sp
from ..operators import tfidf as tf
from ..operators import vectors as vc
from ..operators.metrics import metrics_row
from ..plans import models as ml
from ..plans.config import TrainingConfig
from ..plans.stages import Cleaning, UrlFeatures
from ..session import materialise, read_spread, read_table, scratch_path
from ..sources.writers import load_artifacts, save_artifacts
from .base import finish, outputs, query, split_column
from .splits import _grams_sql
from .texts import SPACE_SQL

BENCH_SQL = f"b AS (SELECT item_id, regexp_replace(strip_accents(lower(text)), '{SPACE_SQL}{{2,}}', ' ', 'g') AS t FROM benchmark)"


def weights_sql(source: str, key: str, tf_sql: str, min_df: str, max_df: str = "0.9") -> str:
    return f"""
tf AS ({tf_sql}), nd AS (SELECT count(*) AS n FROM {source}),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * (SELECT n FROM nd)),
raw AS (SELECT {key}, term, tf, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS r FROM tf JOIN voc USING (term) CROSS JOIN nd),
wt AS (SELECT {key}, term, tf, r / sqrt(sum(r * r) OVER (PARTITION BY {key})) AS weight FROM raw)"""


@query("tfidf_char", f"""
WITH {BENCH_SQL}, {weights_sql('b', 'item_id', _grams_sql('b', 'item_id', 3, 5), '3')}
SELECT {outputs('item_id:i term:s tf:i weight:d')} FROM wt""")
def tfidf_char(spark: SparkSession, sf: str) -> DataFrame:
    table = tf.tfidf(read_spread(spark, sf, "benchmark"), "item_id", "text", "char", 3, 5)
    return finish(table.select("item_id", "term", "tf", "weight"))


TALK_SQL = "b AS (SELECT conv_id * 1000 + turn AS row_id, strip_accents(lower(text)) AS t FROM conversations)"
WORDS_SQL = "ws AS (SELECT row_id, regexp_extract_all(t, '[\\p{L}\\p{N}_]+') AS w FROM b)"
WORD_TF_SQL = "SELECT row_id, term, count(*) AS tf FROM (" + " UNION ALL ".join(
    f"SELECT row_id, array_to_string(w[i:i + {n - 1}], ' ') AS term FROM (SELECT row_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM ws)"
    for n in (1, 2, 3)) + ") GROUP BY ALL"
WORD_SQL = f"{TALK_SQL}, {WORDS_SQL}, " + weights_sql("b", "row_id", WORD_TF_SQL, "greatest(3, (SELECT n FROM nd) // 5000)")


def talks(spark: SparkSession, sf: str) -> DataFrame:
    return read_spread(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", "role")


def word_weights(spark: SparkSession, sf: str) -> DataFrame:
    return tf.tfidf(talks(spark, sf), "row_id", "text", "word", 1, 3)


@query("tfidf_word", f"WITH {WORD_SQL} SELECT {outputs('row_id:i term:s tf:i weight:d')} FROM wt")
def tfidf_word(spark: SparkSession, sf: str) -> DataFrame:
    return finish(word_weights(spark, sf).select("row_id", "term", "tf", "weight"))


# coefficients by rule: the sign and size follow the first hexadecimal digits of the term's hash
@query("token_contributions", f"""
WITH {WORD_SQL}, c AS (SELECT term, (CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) - 8388608) / 8388608.0::DOUBLE AS coef FROM voc),
p AS (SELECT row_id, term, weight * coef AS contribution FROM wt JOIN c USING (term)),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, term) AS rn FROM p WHERE contribution <> 0),
s AS (SELECT *, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS side FROM k WHERE rn <= 20),
x AS (SELECT *, row_number() OVER (PARTITION BY row_id, side ORDER BY rn) AS rank FROM s)
SELECT {outputs('row_id:i side:s rank:i term:s contribution:d')} FROM x WHERE x.rank <= 10""")
def token_contributions(spark: SparkSession, sf: str) -> DataFrame:
    weights = word_weights(spark, sf)
    digits = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("bigint")
    coefficients = weights.select("term").distinct().withColumn("coef", (digits - 8388608) / 8388608.0)
    return finish(ex.token_contributions(weights, coefficients, "row_id", 10))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        "vec_id", vc.unit_length(F.col("embedding")).alias("unit"), (F.col("label") == 0).cast("int").alias("label"))


@query("embedding_block", """
WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label = 0 AS BIGINT) AS label, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS position, round(unnest(e) / norm, 6) + 0.0 AS value FROM n""")
def embedding_block(spark: SparkSession, sf: str) -> DataFrame:
    return finish(embeddings(spark, sf).select("vec_id", "label", F.posexplode("unit").alias("position", "value")))


@query("svd_block")
def svd_block(spark: SparkSession, sf: str) -> DataFrame:
    """Length of each projected row and the share of variance the projection keeps."""
    units = embeddings(spark, sf)
    basis, _ = vc.truncated_svd(units, "unit", 16)
    projected = materialise(vc.project(units, "unit", basis), "svd")
    kept = vc.explained_variance(projected, "unit", "svd").scalar()
    length = F.sqrt(F.aggregate("svd", F.lit(0.0), lambda a, x: a + x * x))
    return finish(projected.select("vec_id", length.alias("length"), kept.alias("explained_variance_ratio")), 4)


@query("fused_block", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) + 10 AS BIGINT) AS width, CAST(len(embedding) + 9 AS BIGINT) AS selected_width FROM embeddings""")
def fused_block(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric, embedding and constant columns fused, the constant ones dropped again."""
    units = embeddings(spark, sf)
    basis, _ = vc.truncated_svd(units, "unit", 8)
    blocks = vc.project(units, "unit", basis).withColumns({"first": F.col("unit")[0], "constant": F.lit(1.0)})
    fused = vc.fuse_blocks(blocks, ["first", "constant", "unit", "svd"])
    _, selected = vc.drop_constant(fused)
    return finish(selected.select(
        "vec_id", F.size(vector_to_array("features")).alias("width"), F.size(vector_to_array("selected")).alias("selected_width")))


@query("smote_balance")
def smote_balance(spark: SparkSession, sf: str) -> DataFrame:
    balanced = vc.smote(embeddings(spark, sf), "vec_id", "unit", "label")
    return finish(balanced.groupBy("label", "synthetic").agg(F.count("*").alias("n"), F.avg(F.col("unit")[0]).alias("mean_first")))


# --- models -----------------------------------------------------------------------------------------------

CONFIG = TrainingConfig()


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    table = embeddings(spark, sf).select("vec_id", "label", array_to_vector("unit").alias("features"),
                                         split_column("vec_id").alias("split"))
    return materialise(table, "training")


def _evaluated(model, table: DataFrame) -> DataFrame:
    # the metrics read the scores several times, and a forest is sent out each time it scores
    held = materialise(ml.probabilities(model, table.where("split <> 'train'"), ["vec_id", "split", "label"]), "held-scores")
    return finish(metrics_row(held, 0.5, ["split"]))


def _trained(spark: SparkSession, sf: str, name: str):
    table = training_table(spark, sf)
    train = ml.balanced_weights(table.where("split = 'train'"))
    return ml.estimator(name, CONFIG, train.count()).fit(train), table


@query("train_lr")
def train_lr(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(*_trained(spark, sf, "LR"))


@query("train_rf")
def train_rf(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(*_trained(spark, sf, "RF"))


@query("train_gbt")
def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    table = training_table(spark, sf)
    data = ml.positive_weight(table.where("split IN ('train', 'val')")).withColumn("held", F.col("split") == "val")
    return _evaluated(ml.estimator("GBT", CONFIG, 0, validation="held").fit(data), table)


def _calibrated(spark: SparkSession, sf: str, method: str) -> DataFrame:
    model, table = _trained(spark, sf, "LR")
    val = ml.probabilities(model, table.where("split = 'val'"), ["label"])
    test = ml.probabilities(model, table.where("split = 'test'"), ["vec_id", "label"])
    return finish(ml.calibrate(val, method).apply(test).select("vec_id", "label", "score", "calibrated"))


@query("calibrate_isotonic")
def calibrate_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "isotonic")


@query("calibrate_sigmoid")
def calibrate_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "sigmoid")


@query("stacking")
def stacking(spark: SparkSession, sf: str) -> DataFrame:
    table = training_table(spark, sf)
    train = ml.balanced_weights(table.where("split = 'train'"))
    folded = materialise(sp.stratified_folds(train, "vec_id", "label", 2), "stack-folds")
    n = folded.count()
    makers = {name: (lambda name=name: ml.estimator(name, CONFIG, n)) for name in ("RF", "LR")}
    return _evaluated(ml.fit_stack(folded, "vec_id", "fold", makers), table)


@query("group_cv")
def group_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold metrics of group-aware cross-validation; the groups are the nearest tens of ids."""
    table = embeddings(spark, sf).select("vec_id", "label", array_to_vector("unit").alias("features"),
                                         F.floor(F.col("vec_id") / 10).alias("group"))
    folded = materialise(sp.stratified_group_folds(table, "group", "label", 3), "cv-folds")
    scores = ml.cross_validate(folded, "fold", lambda n: ml.estimator("LR", CONFIG, n), weigh=ml.balanced_weights)
    per_fold, summary = ml.cross_validation_report(scores)
    return finish(per_fold.withColumns({
        "mean_auc": summary.select("roc_auc_mean").scalar(), "std_auc": summary.select("roc_auc_std").scalar()}))


@query("score_batch")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Fit, save, load and score: verdicts and tiers of every row."""
    model, table = _trained(spark, sf, "LR")
    folder = scratch_path(spark, "artifacts")
    save_artifacts(folder, PipelineModel([model]), None, {"best_threshold": 0.5, "abstain_band": 0.1}, spark=spark)
    loaded = load_artifacts(spark, folder)
    scored = sc.score_table(table.drop("split"), loaded.model, None, loaded.threshold, loaded.abstain_band)
    return finish(scored.select("vec_id", "score", "verdict", "confidence_by_half", "risk_level"))


@query("score_bad_rows", """
WITH r AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '  ' WHEN page_id % 13 = 0 THEN NULL ELSE url END AS url FROM pages)
SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'missing url' END AS error,
  CASE WHEN url IS NULL OR trim(url) = '' THEN NULL ELSE round(least(1.0, (length(url) - length(replace(url, '.', ''))) / 10.0::DOUBLE), 6) + 0.0 END AS score FROM r""")
def score_bad_rows(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    pages = read_table(spark, sf, "pages").select(
        "page_id", F.when(i % 11 == 0, "  ").when(i % 13 == 0, F.lit(None)).otherwise(F.col("url")).alias("url"))

    def scorer(df: DataFrame) -> DataFrame:
        return basic_url_features(df).withColumn("score", F.least(F.lit(1.0), F.col("num_dots") / 10.0))

    return finish(sc.score_with_errors(pages, ["url"], scorer).select("page_id", "error", "score"))


@query("feature_stages")
def feature_stages(spark: SparkSession, sf: str) -> DataFrame:
    """URL features and the cleaning profile as saved and reloaded pipeline stages."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    features = UrlFeatures(inputCol="url", advanced=False)
    made = features.transform(pages)
    cleaning = Cleaning(columns=["url_entropy", "url_length", "num_dots", "num_digits_in_url"]).fit(made)
    path = scratch_path(spark, "stages")
    PipelineModel([features, cleaning]).write().overwrite().save(path)
    return finish(PipelineModel.load(path).transform(pages).drop("url", "has_ip_in_url", "has_homograph", "has_url_shortener"))
