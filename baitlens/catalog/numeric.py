"""Profile, scaling, histogram, drift, robustness and attribution queries over numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import explain as ex
from ..operators import ordering as od
from ..operators import profile as pf
from ..operators import robustness as rb
from ..session import materialise, read_table, scratch_path
from .base import finish, outputs, query

NUMERIC_SQL = """
num AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS price,
  l_extendedprice * l_extendedprice / 1e6::DOUBLE * l_extendedprice / 1e6::DOUBLE AS heavy, l_discount AS discount, 1.5::DOUBLE AS constant FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber"]
COLUMNS = ["quantity", "price", "heavy", "discount", "constant"]
KEPT = ["quantity", "price", "heavy"]


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return read_table(spark, sf, "lineitem").select(
        *KEYS, F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"), price.alias("price"),
        (price * price / 1e6 * price / 1e6).alias("heavy"), F.col("l_discount").alias("discount"), F.lit(1.5).alias("constant"))


def _each(columns, expr: str, source: str = "num") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr.format(c=c)} FROM {source}" for c in columns)


@query("profile_low_variance", f"""
WITH {NUMERIC_SQL}, x AS ({_each(COLUMNS, 'var_samp({c}) AS var_samp')})
SELECT "column", round(var_samp, 4) + 0.0 AS var_samp, CAST(var_samp < 0.01 AS BIGINT) AS removed FROM x""")
def profile_low_variance(spark: SparkSession, sf: str) -> DataFrame:
    table = numbers(spark, sf)
    removed = pf.low_variance(table, COLUMNS)
    stats = pf.moments(table, COLUMNS).select("column", "var_samp")
    return finish(stats.withColumn("removed", F.col("column").isin(removed)), 4)


@query("profile_iqr", f"""
WITH {NUMERIC_SQL}, q AS ({_each(KEPT, 'quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3')}),
x AS (SELECT *, q1 - 3.0 * (q3 - q1) AS lower, q3 + 3.0 * (q3 - q1) AS upper FROM q)
SELECT "column", {outputs('q1:d q3:d lower:d upper:d', 4)} FROM x""")
def profile_iqr(spark: SparkSession, sf: str) -> DataFrame:
    table = numbers(spark, sf)
    fitted = pf.fit_profile(table, COLUMNS)
    bounds = fitted.to_table(spark).where("NOT removed").select("column", "lower", "upper")
    quartiles = pf.column_quantiles(table, KEPT, [0.25, 0.75]).toDF("column", "q1", "q3")
    return finish(quartiles.join(bounds, "column"), 4)


def _clip_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(least({c}, {c}_q3 + 3.0 * ({c}_q3 - {c}_q1)), "
            f"{c}_q1 - 3.0 * ({c}_q3 - {c}_q1)) END AS {c}")


CLEAN_SQL = NUMERIC_SQL + f""",
q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3' for c in KEPT)} FROM num),
cl AS (SELECT l_orderkey, l_linenumber, {', '.join(_clip_sql(c) for c in KEPT)} FROM num CROSS JOIN q),
sk AS (SELECT {', '.join(f'skewness({c}) AS {c}_s, min({c}) AS {c}_m' for c in KEPT)} FROM cl),
tr AS (SELECT l_orderkey, l_linenumber, {', '.join(f'CASE WHEN abs({c}_s) > 1 THEN ln(1 + ({c} - {c}_m + 1)) ELSE {c} END AS {c}' for c in KEPT)} FROM cl CROSS JOIN sk),
md AS (SELECT {', '.join(f'median({c}) AS {c}_d' for c in KEPT)} FROM tr),
im AS (SELECT l_orderkey, l_linenumber, {', '.join(f'coalesce({c}, {c}_d) AS {c}' for c in KEPT)} FROM tr CROSS JOIN md),
st AS (SELECT {', '.join(f'avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_p' for c in KEPT)} FROM im)"""


@query("profile_skew", f"""
WITH {CLEAN_SQL}, x AS ({_each(KEPT, '{c}_s AS skew, {c}_m AS min, CAST(abs({c}_s) > 1 AS INT) AS logged', 'sk')})
SELECT "column", {outputs('skew:d min:d logged:i', 4)} FROM x""")
def profile_skew(spark: SparkSession, sf: str) -> DataFrame:
    table = numbers(spark, sf)
    fitted = pf.fit_profile(table, COLUMNS)
    clipped = table.select(*[pf._transformed(c, fitted.columns[c], None).alias(c) for c in KEPT])
    return finish(pf.moments(clipped, KEPT).select("column", "skew", "min", (F.abs("skew") > 1).alias("logged")), 4)


@query("profile_median", f"""
WITH {CLEAN_SQL}, x AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, {c}_d AS median, {c}_a AS mean, {c}_p AS std FROM md CROSS JOIN st" for c in KEPT)})
SELECT column_name, {outputs('median:d mean:d std:d', 4)} FROM x""")
def profile_median(spark: SparkSession, sf: str) -> DataFrame:
    fitted = pf.fit_profile(numbers(spark, sf), COLUMNS)
    return finish(fitted.to_table(spark).where("NOT removed").select(
        F.col("column").alias("column_name"), "median", "mean", "std"), 4)


@query("clean_numeric", f"""
WITH {CLEAN_SQL} SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  {', '.join(f'round(({c} - {c}_a) / {c}_p, 5) + 0.0 AS {c}' for c in KEPT)} FROM im CROSS JOIN st""")
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    table = numbers(spark, sf)
    return finish(pf.apply_profile(table, pf.fit_profile(table, COLUMNS), KEYS), 5)


@query("robust_scale", """
WITH q AS (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS a, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS b FROM part)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(p_size / a, 6) + 0.0 AS p_size, round(p_retailprice / b, 6) + 0.0 AS p_retailprice FROM part CROSS JOIN q""")
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return finish(pf.robust_scale(read_table(spark, sf, "part"), ["p_size", "p_retailprice"], ["p_partkey"]))


@query("column_moments", f"""
WITH {NUMERIC_SQL}, x AS ({_each(KEPT, 'count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std_pop, var_samp({c}) AS var_samp, min({c}) AS min, max({c}) AS max, skewness({c}) AS skew')})
SELECT "column", {outputs('n:i mean:d std_pop:d var_samp:d min:d max:d skew:d', 2)} FROM x""")
def column_moments(spark: SparkSession, sf: str) -> DataFrame:
    return finish(pf.moments(numbers(spark, sf), KEPT), 2)


@query("exact_quantiles", f"""
WITH {NUMERIC_SQL}, x AS (SELECT l_linenumber, {', '.join(f'quantile_cont(price, {q}) AS q{i}' for i, q in enumerate((0.01, 0.5, 0.9, 0.999)))} FROM num GROUP BY l_linenumber)
SELECT {outputs('l_linenumber:i q0:d q1:d q2:d q3:d', 4)} FROM x""")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return finish(od.exact_quantiles(numbers(spark, sf), "price", [0.01, 0.5, 0.9, 0.999], ["l_linenumber"]), 4)


# --- drift: first half of the events against the second -------------------------------------------------

CUT = "2024-01-16"
FEATURES = ["value", "user_id", "k", "hour"]
EVENTS_SQL = f"""
ev AS (SELECT event_id, ts, event_type, value, CAST(user_id AS DOUBLE) AS user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
  CAST(hour(ts) AS DOUBLE) + CASE WHEN ts >= TIMESTAMP '{CUT}' THEN 3 ELSE 0 END AS hour FROM events),
long AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} AS value, ts, ts < TIMESTAMP '{CUT}' AS base FROM ev" for f in FEATURES)}),
rng AS (SELECT feature, min(value::FLOAT::DOUBLE) AS lo, max(value::FLOAT::DOUBLE) AS hi FROM long WHERE base GROUP BY feature),
edg AS (SELECT feature, i AS bin, (CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10.0::DOUBLE) END)::FLOAT::DOUBLE AS e FROM rng CROSS JOIN range(11) AS r(i)),
bins AS (SELECT a.feature, a.bin, a.e AS lo, b.e AS hi FROM edg a JOIN edg b ON b.feature = a.feature AND b.bin = a.bin + 1),
bc AS (SELECT b.feature, b.bin, count(l.value) AS n FROM bins b LEFT JOIN long l ON l.feature = b.feature AND l.base
  AND l.value::FLOAT::DOUBLE >= b.lo AND (l.value::FLOAT::DOUBLE < b.hi OR (b.bin = 9 AND l.value::FLOAT::DOUBLE = b.hi)) GROUP BY b.feature, b.bin),
ms AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS std FROM long WHERE base GROUP BY feature)"""


def events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUT).cast("timestamp_ntz")
    table = read_table(spark, sf, "events").select(
        "event_id", "ts", "event_type", "value", F.col("user_id").cast("double").alias("user_id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("k"),
        (F.hour("ts").cast("double") + F.when(F.col("ts") >= cut, 3.0).otherwise(0.0)).alias("hour"))
    return table.where(F.col("ts") < cut), table.where(F.col("ts") >= cut)


@query("drift_baseline", f"""
WITH {EVENTS_SQL}, x AS (SELECT feature, bin, n, lo, hi, mean, std FROM bc JOIN bins USING (feature, bin) JOIN ms USING (feature))
SELECT {outputs('feature:s bin:i n:i lo:d hi:d mean:d std:d', 4)} FROM x""")
def drift_baseline(spark: SparkSession, sf: str) -> DataFrame:
    base, _ = events(spark, sf)
    table = dr.establish_baseline(base, FEATURES)
    bins = table.select("feature", "mean", "std", "edges", F.posexplode("counts").alias("bin", "n"))
    return finish(bins.select("feature", "bin", "n", F.element_at("edges", F.col("bin") + 1).alias("lo"),
                              F.element_at("edges", F.col("bin") + 2).alias("hi"), "mean", "std"), 4)


def psi_sql(group: str = "") -> str:
    """CTE ``psi`` from ``nl``, the new rows in long form."""
    keys = f"{group}, " if group else ""
    pick = f"g.{group}, " if group else ""
    groups = f"(SELECT DISTINCT {group} FROM nl) g CROSS JOIN bins b" if group else "bins b"
    match = f" AND l.{group} = g.{group}" if group else ""
    return f"""
nc AS (SELECT {pick}b.feature, b.bin, count(l.value) AS n FROM {groups} LEFT JOIN nl l ON l.feature = b.feature{match}
  AND l.value >= b.lo AND (l.value < b.hi OR (b.bin = 9 AND l.value = b.hi)) GROUP BY {pick}b.feature, b.bin),
pq AS (SELECT {keys.replace(group, 'nc.' + group) if group else ''}nc.feature, (bc.n + 1e-10::DOUBLE) / sum(bc.n + 1e-10::DOUBLE) OVER w AS p, (nc.n + 1e-10::DOUBLE) / sum(nc.n + 1e-10::DOUBLE) OVER w AS q
  FROM nc JOIN bc ON bc.feature = nc.feature AND bc.bin = nc.bin WINDOW w AS (PARTITION BY {keys.replace(group, 'nc.' + group) if group else ''}nc.feature)),
psi AS (SELECT {keys}feature, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY {keys}feature)"""


NEW_SQL = "nl AS (SELECT * FROM long WHERE NOT base)"
OUT_SQL = ("oor AS (SELECT l.feature, count(*) AS out_of_range FROM nl l JOIN rng USING (feature) WHERE l.value < lo::FLOAT::DOUBLE OR l.value > hi::FLOAT::DOUBLE GROUP BY l.feature)")


@query("drift_psi", f"""
WITH {EVENTS_SQL}, {NEW_SQL}, {psi_sql()}, {OUT_SQL}, x AS (SELECT feature, psi, coalesce(out_of_range, 0) AS out_of_range, CAST(psi > 0.2 AS INT) AS drifted FROM psi LEFT JOIN oor USING (feature))
SELECT {outputs('feature:s psi:d out_of_range:i drifted:i')} FROM x""")
def drift_psi(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    return finish(dr.data_drift(dr.establish_baseline(base, FEATURES), new))


JS_SQL = f"""
sh AS (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '{CUT}') / (count(*) FILTER (WHERE ts < TIMESTAMP '{CUT}') + 0.0::DOUBLE) AS one FROM ev GROUP BY event_type),
lab AS (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS a, count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}' AND event_type <> 'signup') AS b FROM ev GROUP BY event_type),
lp AS (SELECT a / sum(a) OVER () + 1e-10::DOUBLE AS p0, b / sum(b) OVER () + 1e-10::DOUBLE AS q0 FROM lab),
lq AS (SELECT p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM lp),
js AS (SELECT 0.5 * sum(p * ln(p / (0.5 * (p + q)))) + 0.5 * sum(q * ln(q / (0.5 * (p + q)))) AS js_divergence FROM lq)"""


@query("drift_label_js", f"WITH {EVENTS_SQL}, {JS_SQL} SELECT {outputs('js_divergence:d')} FROM js")
def drift_label_js(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    kept = new.where(F.col("event_type") != "signup")  # a class that vanishes
    return finish(dr.label_drift(dr.label_shares(base, "event_type"), dr.label_shares(kept, "event_type")))


MEAN_SQL = ("mn AS (SELECT l.feature, mean AS baseline_mean, avg(l.value) AS new_mean, abs(avg(l.value) - mean) / std AS z_score, CAST(abs(avg(l.value) - mean) / std > 3 AS INT) AS shifted "
            "FROM nl l JOIN ms USING (feature) GROUP BY l.feature, mean, std)")


@query("drift_mean_shift", f"WITH {EVENTS_SQL}, {NEW_SQL}, {MEAN_SQL} SELECT {outputs('feature:s baseline_mean:d new_mean:d z_score:d shifted:i', 5)} FROM mn")
def drift_mean_shift(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    return finish(dr.mean_shift(dr.establish_baseline(base, FEATURES), new), 5)


@query("drift_report", f"""
WITH {EVENTS_SQL}, {NEW_SQL}, {psi_sql()}, {JS_SQL.replace(" AND event_type <> 'signup'", '')}, {MEAN_SQL},
acc AS (SELECT avg(CAST((value > 10) = (event_type = 'error') AS INT)) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS baseline_accuracy,
  avg(CAST((value > 10) = (event_type = 'error') AS INT)) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS new_accuracy FROM ev),
x AS (SELECT (SELECT avg(psi) FROM psi) AS psi_mean, (SELECT coalesce(string_agg(feature, ',' ORDER BY feature), '') FROM psi WHERE psi > 0.2) AS drifted, (SELECT count(*) FROM mn WHERE shifted = 1) AS n_shifted,
  js_divergence, baseline_accuracy, new_accuracy, baseline_accuracy - new_accuracy AS accuracy_degradation FROM js CROSS JOIN acc),
y AS (SELECT *, 0.5 * psi_mean + 0.2 * js_divergence / ln(2) + 0.3 * greatest(0, accuracy_degradation) AS overall_drift_score FROM x)
SELECT {outputs('psi_mean:d drifted:s n_shifted:i js_divergence:d baseline_accuracy:d new_accuracy:d accuracy_degradation:d overall_drift_score:d')},
  CAST(overall_drift_score > 0.1 AS BIGINT) AS alert_triggered FROM y""")
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)

    def predicted(df: DataFrame) -> DataFrame:
        return df.select((F.col("value") > 10).alias("prediction"), (F.col("event_type") == "error").alias("label"))

    report = dr.drift_report(
        dr.establish_baseline(base, FEATURES), new, dr.label_shares(base, "event_type"), "event_type",
        dr.accuracy(predicted(base)).scalar(), dr.accuracy(predicted(new)).scalar())
    return finish(report.select(
        "psi_mean", F.array_join("drifted_features", ",").alias("drifted"), F.size("feature_drift").alias("n_shifted"),
        "js_divergence", "baseline_accuracy", "new_accuracy", "accuracy_degradation", "overall_drift_score", "alert_triggered"))


DAILY_SQL = EVENTS_SQL + ", nl AS (SELECT feature, value, CAST(ts AS DATE) AS day FROM long WHERE NOT base)"


@query("drift_history_tail", f"""
WITH {DAILY_SQL}, {psi_sql('day')}, d AS (SELECT day, avg(psi) AS psi_mean, max(psi) AS psi_max FROM psi GROUP BY day)
SELECT CAST(day AS VARCHAR) AS day, round(psi_mean, 6) + 0.0 AS psi_mean, round(psi_max, 6) + 0.0 AS psi_max FROM d ORDER BY day DESC LIMIT 7""")
def drift_history_tail(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    per_day = dr.data_drift(dr.establish_baseline(base, FEATURES), new.withColumn("day", F.to_date("ts").cast("string")), group_by=["day"])
    path = scratch_path(spark, "drift-history")
    per_day.groupBy("day").agg(F.avg("psi").alias("psi_mean"), F.max("psi").alias("psi_max")).write.mode("append").json(path)
    history = spark.read.schema("day string, psi_mean double, psi_max double").json(path)
    return finish(dr.history_tail(history, "day", 7))


@query("histogram_fixed", f"""
WITH {NUMERIC_SQL}, r AS (SELECT min(price::FLOAT::DOUBLE) AS lo, max(price::FLOAT::DOUBLE) AS hi FROM num),
e AS (SELECT i AS bin, (lo + i * ((hi - lo) / 10.0::DOUBLE))::FLOAT::DOUBLE AS lo, (CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10.0::DOUBLE) END)::FLOAT::DOUBLE AS hi FROM r CROSS JOIN range(10) AS t(i)),
x AS (SELECT bin, count(price) AS n FROM e LEFT JOIN num ON price::FLOAT::DOUBLE >= lo AND (price::FLOAT::DOUBLE < hi OR (bin = 9 AND price::FLOAT::DOUBLE = hi)) GROUP BY bin) SELECT {outputs('bin:i n:i')} FROM x""")
def histogram_fixed(spark: SparkSession, sf: str) -> DataFrame:
    table = dr.establish_baseline(numbers(spark, sf), ["price"])
    return finish(table.select(F.posexplode("counts").alias("bin", "n")))


@query("histogram_frozen", f"""
WITH {EVENTS_SQL}, {NEW_SQL}, x AS (SELECT b.feature, b.bin, count(l.value) AS n FROM bins b LEFT JOIN nl l ON l.feature = b.feature AND l.value >= b.lo AND (l.value < b.hi OR (b.bin = 9 AND l.value = b.hi)) GROUP BY b.feature, b.bin)
SELECT {outputs('feature:s bin:i n:i')} FROM x""")
def histogram_frozen(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    counts = dr.histogram(dr.feature_values(new, FEATURES), dr.establish_baseline(base, FEATURES), 10)
    return finish(counts.select("feature", F.posexplode("counts").alias("bin", "n")))


# --- robustness and attribution over line items ---------------------------------------------------------

SWEEP_FEATURES = ["url_entropy", "url_length", "num_dots", "text_entropy"]
COEFFICIENTS = {"url_entropy": 0.8, "url_length": 0.02, "num_dots": -0.05, "text_entropy": 0.6}
ITEMS_SQL = """
it AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INT) AS label, l_discount * 20 AS url_entropy, l_extendedprice / 1000 AS url_length,
  l_quantity AS num_dots, l_tax * 25 AS text_entropy FROM lineitem)"""
VARIANTS = [  # suite, name, factors and addends in feature order
    ("baseline", "none", 1, 1, 1, 0, 1, 0), ("obfuscation", "homoglyphs", 1.2, 1, 1, 1, 1, 0),
    ("obfuscation", "url_encoding", 1, 1.5, 1, 0, 1, 0), ("obfuscation", "zero_width", 1, 1, 1, 0, 0.9, 0),
    ("obfuscation", "leetspeak", 1, 1, 1, 0, 1.15, 0),
    *[("temporal_drift", n, f, f, f, 0, f, 0) for n, f in rb.TEMPORAL_FACTORS.items()],
    *[("multilingual", n, 1, 1, 1, 0, f, 0) for n, f in rb.LANGUAGE_FACTORS.items()],
]


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 20).alias("url_entropy"), (F.col("l_extendedprice") / 1000).alias("url_length"),
        F.col("l_quantity").alias("num_dots"), (F.col("l_tax") * 25).alias("text_entropy"))


def linear_scorer(df: DataFrame) -> DataFrame:
    z = F.lit(-1.5)
    for name, coefficient in COEFFICIENTS.items():
        z = z + F.lit(coefficient) * F.col(name)
    return df.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


@query("perturbation_sweep", f"""
WITH {ITEMS_SQL}, v(suite, perturbation, a, b, c, d, e, f) AS (VALUES {', '.join("('" + v[0] + "', '" + v[1] + "', " + ', '.join(f'{x}::DOUBLE' for x in v[2:]) + ')' for v in VARIANTS)}),
s AS (SELECT suite, perturbation, label, 1 / (1 + exp(-(-1.5::DOUBLE + 0.8::DOUBLE * (url_entropy * a) + 0.02::DOUBLE * (url_length * b) + -0.05::DOUBLE * (num_dots * c + d) + 0.6::DOUBLE * (text_entropy * e)))) AS score FROM it CROSS JOIN v),
k AS (SELECT suite, perturbation, avg(CAST((score >= 0.5) = (label = 1) AS INT)) AS accuracy, avg((score - label) ** 2) AS brier, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp FROM s GROUP BY suite, perturbation),
x AS (SELECT *, max(accuracy) FILTER (WHERE suite = 'baseline') OVER () - accuracy AS degradation FROM k)
SELECT {outputs('suite:s perturbation:s accuracy:d brier:d tp:i degradation:d')}, CAST(degradation < 0.1 AS BIGINT) AS passed FROM x""")
def perturbation_sweep(spark: SparkSession, sf: str) -> DataFrame:
    table = rb.perturbation_sweep(items(spark, sf), SWEEP_FEATURES, linear_scorer, ranking=False)
    return finish(table.select("suite", "perturbation", "accuracy", "brier", "tp", "degradation", "passed"))


@query("perturbation_random")
def perturbation_random(spark: SparkSession, sf: str) -> DataFrame:
    """The suites that draw numbers."""
    suites = rb.random_suites("row_id", SWEEP_FEATURES)
    table = rb.perturbation_sweep(items(spark, sf), SWEEP_FEATURES, linear_scorer, suites, keep=["row_id"])
    return finish(table.select("suite", "perturbation", "accuracy", "roc_auc", "degradation", "passed"))


ATTRIBUTION_SQL = f"""
mu AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in COEFFICIENTS)} FROM it),
att AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg(abs({k}::DOUBLE * ({c} - m_{c}))) AS shap_importance FROM it CROSS JOIN mu" for c, k in COEFFICIENTS.items())})"""


@query("linear_attribution", f"WITH {ITEMS_SQL}, {ATTRIBUTION_SQL} SELECT {outputs('feature:s shap_importance:d')} FROM att")
def linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return finish(ex.linear_attribution(items(spark, sf), COEFFICIENTS))


@query("embedding_attribution", """
WITH l AS (SELECT generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE AS value FROM embeddings),
m AS (SELECT position, avg(value) AS mu FROM l GROUP BY position),
x AS (SELECT l.position, avg(abs((l.position % 7 - 3) * (value - mu))) AS attribution FROM l JOIN m ON m.position = l.position GROUP BY l.position) """
       f"SELECT {outputs('position:i attribution:d')} FROM x")
def embedding_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return finish(ex.array_attribution(read_table(spark, sf, "embeddings"), "embedding", [float(i % 7 - 3) for i in range(64)]))


@query("importance_merge", f"""
WITH {ITEMS_SQL}, {ATTRIBUTION_SQL},
tr AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, abs(corr({c}, label)) AS tree_importance FROM it" for c in list(COEFFICIENTS)[:3])}),
x AS (SELECT feature, shap_importance, tree_importance FROM att LEFT JOIN tr USING (feature) ORDER BY shap_importance DESC, tree_importance DESC, feature)
SELECT {outputs('feature:s shap_importance:d tree_importance:d')} FROM x""")
def importance_merge(spark: SparkSession, sf: str) -> DataFrame:
    table = items(spark, sf)
    shap = ex.linear_attribution(table, COEFFICIENTS)
    names = list(COEFFICIENTS)[:3]
    tree = table.agg(*[F.abs(F.corr(c, "label")).alias(c) for c in names]).unpivot([], names, "feature", "tree_importance")
    return finish(ex.merge_importance(shap.select("feature"), shap, tree))


@query("top_lists", f"""
WITH {EVENTS_SQL}, {NEW_SQL}, {psi_sql()}, x AS (SELECT feature, psi, CAST(psi > 0.2 AS INT) AS drifted FROM psi ORDER BY psi DESC, feature LIMIT 3)
SELECT {outputs('feature:s psi:d drifted:i')} FROM x""")
def top_lists(spark: SparkSession, sf: str) -> DataFrame:
    base, new = events(spark, sf)
    drifted = dr.data_drift(dr.establish_baseline(base, FEATURES), new)
    return finish(dr.top_drifted(drifted, 3).select("feature", "psi", "drifted"))


def _score_sql(exchanged: str | None = None) -> str:
    """The linear score of rows ``r``, one feature taken from the donor ``d``."""
    terms = " + ".join(f"{k}::DOUBLE * {'d' if c == exchanged else 'r'}.{c}" for c, k in COEFFICIENTS.items())
    return f"1 / (1 + exp(-(-1.5::DOUBLE + {terms})))"


@query("permutation_importance", f"""
WITH {ITEMS_SQL}, r AS (SELECT * EXCLUDE (row_id), row_number() OVER (ORDER BY row_id, label, {', '.join(SWEEP_FEATURES)}) AS pos FROM it),
o AS (SELECT rep, pos AS donor, row_number() OVER (PARTITION BY rep ORDER BY md5('42|' || rep || '|' || pos), pos) AS pos FROM r, range(10) AS t(rep)),
d AS (SELECT o.rep, o.pos, r.* EXCLUDE (pos) FROM o JOIN r ON r.pos = o.donor),
s AS (SELECT '' AS feature, 0 AS rep, label, {_score_sql()} AS score FROM r
  {' '.join(f"UNION ALL SELECT '{c}', d.rep, r.label, {_score_sql(c)} FROM r JOIN d ON r.pos = d.pos" for c in SWEEP_FEATURES)}),
g AS (SELECT feature, rep, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY feature, rep, score),
w AS (SELECT feature, rep, p, n, sum(n) OVER (PARTITION BY feature, rep ORDER BY score) - n AS below FROM g),
auc AS (SELECT feature, rep, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM w GROUP BY feature, rep),
x AS (SELECT feature, avg((SELECT auc FROM auc WHERE feature = '') - auc) AS permutation_importance, stddev_pop((SELECT auc FROM auc WHERE feature = '') - auc) AS permutation_std,
  count(*) AS repeats FROM auc WHERE feature <> '' GROUP BY feature)
SELECT {outputs('feature:s permutation_importance:d permutation_std:d repeats:i')} FROM x""")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    # order keys and line numbers repeat in the table, so the rows are numbered first
    numbered = od.numbered(items(spark, sf), ["row_id", "label", *SWEEP_FEATURES], "row_id", ["label", *SWEEP_FEATURES])
    return finish(ex.permutation_importance(numbered, "row_id", SWEEP_FEATURES, linear_scorer, position="row_id"))
