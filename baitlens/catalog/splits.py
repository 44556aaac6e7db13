"""Splits, folds, samples and leakage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as sp
from ..operators.leakage import drop_exact_matches, enforce_time_order, remove_leakage, separate_campaigns
from ..operators.similarity import drop_near_duplicates
from ..session import read_table
from .base import finish, labelled_documents, query, split_column, split_sql

LABELLED_SQL = "lab AS (SELECT l.doc_id, l.quality AS label, d.source, d.lang, d.n_chars, d.text FROM labels l JOIN documents d USING (doc_id))"


def _shuffled_sql(seed: int = 42) -> str:
    return (f"sh AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{seed}|' || doc_id), doc_id) AS pos, "
            "count(*) OVER (PARTITION BY label) AS size FROM lab)")


@query("stratified_split", f"""
WITH {LABELLED_SQL}, {_shuffled_sql()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label,
  CASE WHEN pos <= round(CAST(size AS DOUBLE) * CAST(0.7 AS DOUBLE)) THEN 'train'
       WHEN pos <= round(CAST(size AS DOUBLE) * CAST(0.85 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM sh""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.stratified_split(labelled_documents(spark, sf).select("doc_id", "label"), "doc_id", "label"))


@query("calibration_holdout", f"""
WITH {LABELLED_SQL}, {_shuffled_sql()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label,
  CASE WHEN pos <= round(CAST(size AS DOUBLE) * CAST(0.9 AS DOUBLE)) THEN 'train' ELSE 'calibration' END AS part FROM sh""")
def calibration_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.calibration_holdout(labelled_documents(spark, sf).select("doc_id", "label"), "doc_id", "label"))


@query("fold_stratified", f"""
WITH {LABELLED_SQL}, {_shuffled_sql()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label, CAST((pos - 1) % 5 AS BIGINT) AS fold FROM sh""")
def fold_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.stratified_folds(labelled_documents(spark, sf).select("doc_id", "label"), "doc_id", "label"))


@query("fold_timeseries", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos, count(*) OVER () AS n FROM events),
f AS (SELECT event_id, k.fold, pos, n - (5 - k.fold) * (n // 6) AS start, n // 6 AS size FROM r CROSS JOIN range(5) AS k(fold))
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(fold AS BIGINT) AS fold, CASE WHEN pos <= start THEN 'train' ELSE 'test' END AS role
FROM f WHERE pos <= start + size""")
def fold_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.time_series_folds(read_table(spark, sf, "events").select("event_id"), "event_id", 5))


@query("fold_group", """
WITH RECURSIVE g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT user_id, n, row_number() OVER (ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS i FROM g),
t AS (
  SELECT 0 AS i, CAST(NULL AS BIGINT) AS user_id, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(-1 AS BIGINT) AS fold
  UNION ALL
  SELECT o.i, o.user_id, list_transform(t.loads, lambda x, j: CASE WHEN j = list_position(t.loads, list_min(t.loads)) THEN x + o.n ELSE x END),
         list_position(t.loads, list_min(t.loads)) - 1
  FROM t JOIN o ON o.i = t.i + 1)
SELECT CAST(e.event_id AS BIGINT) AS event_id, CAST(e.user_id AS BIGINT) AS user_id, CAST(t.fold AS BIGINT) AS fold
FROM events e JOIN t USING (user_id)""")
def fold_group(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.group_folds(read_table(spark, sf, "events").select("event_id", "user_id"), "user_id", 5))


@query("fold_stratified_group", """
WITH RECURSIVE c AS (SELECT conv_id, concat_ws('|', role, CAST(CAST(length(text) > 300 AS INTEGER) AS VARCHAR)) AS stratum FROM conversations),
st AS (SELECT stratum, count(*) AS total, row_number() OVER (ORDER BY stratum NULLS FIRST) AS i FROM c GROUP BY stratum),
tot AS (SELECT list(total ORDER BY i) AS totals, count(*) AS s FROM st),
per AS (SELECT g.conv_id, st.i, count(c.conv_id) AS n FROM (SELECT DISTINCT conv_id FROM c) g CROSS JOIN st
  LEFT JOIN c ON c.conv_id = g.conv_id AND c.stratum IS NOT DISTINCT FROM st.stratum GROUP BY g.conv_id, st.i),
vec AS (SELECT conv_id, list(n ORDER BY i) AS v, list({'i': i, 'n': n} ORDER BY i) FILTER (n > 0) AS parts FROM per GROUP BY conv_id),
o AS (SELECT conv_id, v, row_number() OVER (ORDER BY s * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) * list_sum(v) DESC,
  parts, md5('42|' || conv_id), CAST(conv_id AS VARCHAR)) AS r FROM vec, tot),
t AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS conv_id, CAST(-1 AS BIGINT) AS fold,
    list_transform(range(5), lambda f: list_transform(totals, lambda x: CAST(0 AS BIGINT))) AS held FROM tot
  UNION ALL
  SELECT r, conv_id, fold, list_transform(held, lambda h, f: CASE WHEN f = fold + 1 THEN list_transform(h, lambda x, i: x + v[i]) ELSE h END)
  FROM (
    SELECT o.r, o.conv_id, o.v, t.held, list_sort(list_transform(range(1, 6), lambda f: {
      'score': list_sum(list_transform(tot.totals, lambda total, i: CASE WHEN o.v[i] = 0 THEN CAST(0 AS DOUBLE) ELSE
        sqrt(CAST(list_sum(list_transform(range(1, 6), lambda g: pow(
          5 * (t.held[g][i] + CASE WHEN g = f THEN o.v[i] ELSE 0 END)
          - o.v[i] - list_sum(list_transform(t.held, lambda h: h[i])), 2))) AS DOUBLE)) / total END)),
      'held_rows': list_sum(t.held[f]), 'f': f - 1}))[1].f AS fold
    FROM t JOIN o ON o.r = t.r + 1, tot)),
folded AS (SELECT c.conv_id, c.stratum, t.fold FROM c JOIN t USING (conv_id))
SELECT CAST(fold AS BIGINT) AS fold, stratum, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS straddling_groups FROM folded GROUP BY fold, stratum""")
def fold_stratified_group(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts per fold and stratum, with the number of groups seen in more than one fold (0)."""
    talks = read_table(spark, sf, "conversations").withColumn(
        "stratum", F.concat_ws("|", "role", (F.length("text") > 300).cast("int").cast("string")))
    folded = sp.stratified_group_folds(talks, "conv_id", "stratum", 5)
    straddling = folded.groupBy("conv_id").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    return finish(folded.groupBy("fold", "stratum").agg(F.count("*").alias("n")).withColumn("straddling_groups", straddling))


@query("temporal_quartiles", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN pos <= 1 + (n - 1) * CAST(0.25 AS DOUBLE) THEN 'Q1'
  WHEN pos <= 1 + (n - 1) * CAST(0.5 AS DOUBLE) THEN 'Q2' WHEN pos <= 1 + (n - 1) * CAST(0.75 AS DOUBLE) THEN 'Q3' ELSE 'Q4' END AS quartile
FROM r""")
def temporal_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.temporal_quartiles(read_table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id").drop("ts"))


@query("synthetic_time", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, TIMESTAMP '2024-01-01' + to_hours(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INTEGER)) AS timestamp
FROM documents""")
def synthetic_time(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.synthetic_time(read_table(spark, sf, "documents").select("doc_id"), "doc_id"))


@query("head_sample", "SELECT CAST(doc_id AS BIGINT) AS doc_id, source FROM documents ORDER BY doc_id LIMIT 200")
def head_sample(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.head_sample(read_table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 200))


@query("hash_sample", "SELECT CAST(event_id AS BIGINT) AS event_id, event_type FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 500")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return finish(sp.hash_sample(read_table(spark, sf, "events").select("event_id", "event_type"), "event_id", 500))


SPLIT_DOCS_SQL = f"sd AS (SELECT doc_id, text, lang, source, {split_sql('doc_id')} AS split FROM documents)"


def split_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text", "lang", "source").withColumn("split", split_column("doc_id"))


@query("exact_leakage", f"""
WITH {SPLIT_DOCS_SQL}
SELECT CAST(doc_id AS BIGINT) AS doc_id, split FROM sd s WHERE split = 'train'
  OR (split = 'val' AND NOT EXISTS (SELECT 1 FROM sd t WHERE t.split = 'train' AND t.text = s.text AND t.lang = s.lang))
  OR (split = 'test' AND NOT EXISTS (SELECT 1 FROM sd t WHERE t.split IN ('train', 'val') AND t.text = s.text AND t.lang = s.lang))""")
def exact_leakage(spark: SparkSession, sf: str) -> DataFrame:
    docs = split_documents(spark, sf).withColumn("label", F.col("source"))
    return finish(drop_exact_matches(docs, ignore=("label", "doc_id", "source")).select("doc_id", "split"))


@query("campaign_separation", f"""
WITH ev AS (SELECT event_id, user_id || '-' || event_type || '-' || CAST(floor(value) AS BIGINT) % 7 AS grp, {split_sql('event_id')} AS split FROM events)
SELECT CAST(event_id AS BIGINT) AS event_id, grp, split FROM ev WHERE split = 'train'
  OR (split = 'val' AND grp NOT IN (SELECT grp FROM ev WHERE split = 'train'))
  OR (split = 'test' AND grp NOT IN (SELECT grp FROM ev WHERE split IN ('train', 'val')))""")
def campaign_separation(spark: SparkSession, sf: str) -> DataFrame:
    bucket = (F.floor("value").cast("bigint") % 7).cast("string")
    events = read_table(spark, sf, "events").select(
        "event_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type", bucket).alias("grp"),
        split_column("event_id").alias("split"))
    return finish(separate_campaigns(events, "grp"))


TIMED_SQL = """
ev AS (SELECT event_id, ts, CASE WHEN event_id % 50 = 7 THEN 'test' WHEN ts < TIMESTAMP '2024-01-16' THEN 'train'
  WHEN ts < TIMESTAMP '2024-01-23' THEN 'val' ELSE 'test' END AS split FROM events),
a AS (SELECT max(ts) FILTER (WHERE split = 'train') AS tm FROM ev),
b AS (SELECT max(ts) AS vm FROM ev, a WHERE split = 'val' AND ts > tm)"""


@query("temporal_order", f"""
WITH {TIMED_SQL}
SELECT CAST(event_id AS BIGINT) AS event_id, split FROM ev, a, b
WHERE split = 'train' OR (split = 'val' AND ts > tm) OR (split = 'test' AND (vm IS NULL OR ts > vm))""")
def temporal_order(spark: SparkSession, sf: str) -> DataFrame:
    i, ts = F.col("event_id"), F.col("ts")
    split = (F.when(i % 50 == 7, "test").when(ts < F.lit("2024-01-16").cast("timestamp_ntz"), "train")
             .when(ts < F.lit("2024-01-23").cast("timestamp_ntz"), "val").otherwise("test"))
    events = read_table(spark, sf, "events").select("event_id", ts.alias("timestamp"), split.alias("split"))
    return finish(enforce_time_order(events).drop("timestamp"))


def _grams_sql(table: str, key: str, low: int, high: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(range(1, length(t) - {n - 2}), lambda i: substr(t, i, {n}))) AS term FROM {table}"
        for n in range(low, high + 1))
    return f"SELECT {key}, term, count(*) AS tf FROM ({parts}) GROUP BY ALL"


# conversations in full, each turn also with a small edit, so that near copies cross the splits
EDITED_SQL = f"""
base AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations
  UNION ALL SELECT 500000037 + conv_id * 1000 + turn, CASE WHEN turn % 2 = 0 THEN text || ' ok' ELSE reverse(text) END FROM conversations),
sp AS (SELECT row_id, regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g') AS t, {split_sql('row_id')} AS split FROM base)"""


def edited_turns(spark: SparkSession, sf: str) -> DataFrame:
    talks = read_table(spark, sf, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    edit = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" ok"))).otherwise(F.reverse("text"))
    both = talks.select(key.alias("row_id"), "text").unionByName(talks.select((key + 500_000_037).alias("row_id"), edit.alias("text")))
    return both.withColumn("split", split_column("row_id"))


@query("near_dup_filter", f"""
WITH {EDITED_SQL},
tf AS ({_grams_sql('sp', 'row_id', 3, 6)}),
tr AS (SELECT tf.* FROM tf JOIN sp USING (row_id) WHERE split = 'train'),
voc AS (SELECT term, ln((1.0 + (SELECT count(*) FROM sp WHERE split = 'train'))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tr GROUP BY term HAVING count(*) >= 2),
w AS (SELECT row_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY row_id)) AS w FROM tf JOIN voc USING (term)),
sim AS (SELECT a.row_id, b.row_id AS other, sum(a.w * b.w) AS s
  FROM w a JOIN sp sa ON sa.row_id = a.row_id AND sa.split <> 'train' JOIN w b ON b.term = a.term
  JOIN sp sb ON sb.row_id = b.row_id AND sb.split = 'train' GROUP BY a.row_id, b.row_id)
SELECT CAST(row_id AS BIGINT) AS row_id, split FROM sp WHERE row_id NOT IN (SELECT row_id FROM sim WHERE s >= 0.975)""")
def near_dup_filter(spark: SparkSession, sf: str) -> DataFrame:
    return finish(drop_near_duplicates(edited_turns(spark, sf), "row_id", "text").select("row_id", "split"))


def _near_sql(source: str, near: str) -> str:
    """CTEs over ``source`` (row_id, text, split): ``near`` has the rows with a training row at a cosine of 0.975.

    Pairs are looked for through each row's rarest n-grams, up to where the squared length of the rest is below 0.9. Where one
    of the two parts ends, the rest adds less than sqrt(0.9), so the parts must add the difference.
    """
    return f"""
n_text AS (SELECT row_id, split, regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]{{2,}}', ' ', 'g') AS t FROM {source}),
n_tf AS MATERIALIZED ({_grams_sql('n_text', 'row_id', 3, 6)}),
n_voc AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM n_text WHERE split = 'train'))::DOUBLE / (1 + count(*))) + 1 AS idf
  FROM n_tf JOIN n_text USING (row_id) WHERE split = 'train' GROUP BY term HAVING count(*) >= 2),
n_raw AS (SELECT row_id, term, df, tf * idf AS raw FROM n_tf JOIN n_voc USING (term)),
n_len AS (SELECT row_id, sqrt(sum(raw * raw)) AS len FROM n_raw GROUP BY row_id),
n_w AS MATERIALIZED (SELECT row_id, split, term, df, raw / len AS w FROM n_raw JOIN n_len USING (row_id) JOIN n_text USING (row_id)),
n_rare AS MATERIALIZED (SELECT * FROM (SELECT row_id, split, term, w, sum(w * w) OVER (PARTITION BY row_id ORDER BY df DESC, term DESC) AS rest FROM n_w)
  WHERE rest >= 0.9 - 1e-9),
n_pairs AS (SELECT q.row_id, b.row_id AS other FROM n_rare q JOIN n_rare b USING (term) WHERE q.split <> 'train' AND b.split = 'train'
  GROUP BY q.row_id, b.row_id HAVING sum(q.w * b.w) >= 0.975 - sqrt(0.9) - 1e-6),
{near} AS MATERIALIZED (SELECT DISTINCT row_id FROM (SELECT p.row_id, p.other, sum(a.w * b.w) AS s FROM n_pairs p JOIN n_w a ON a.row_id = p.row_id
  JOIN n_w b ON b.row_id = p.other AND b.term = a.term GROUP BY p.row_id, p.other) WHERE s >= 0.975)"""


@query("near_dup_documents", f"""
WITH src AS (SELECT doc_id AS row_id, text, {split_sql('doc_id')} AS split FROM documents), {_near_sql('src', 'near')}
SELECT CAST(row_id AS BIGINT) AS doc_id, split FROM src WHERE row_id NOT IN (SELECT row_id FROM near)""")
def near_dup_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in full: those of validation and test without a close training document."""
    kept = drop_near_duplicates(split_documents(spark, sf), "doc_id", "text")
    return finish(kept.select("doc_id", "split"))


def _chain_sql(timed: bool, near: bool) -> str:
    """The steps of the chain as CTEs that end in ``f`` (and ``b`` with the latest kept times)."""
    same = "t.text = s.text AND t.lang = s.lang AND t.sender_domain = s.sender_domain" + " AND t.timestamp = s.timestamp" * timed
    steps = f"""
c AS (SELECT d.doc_id, d.text, d.lang, d.n_chars || '-' || d.source AS sender_domain,
  TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id // 2 AS INTEGER)) AS timestamp, {split_sql('d.doc_id')} AS split FROM documents d),
x AS MATERIALIZED (SELECT * FROM c s WHERE split = 'train'
  OR (split = 'val' AND NOT EXISTS (SELECT 1 FROM c t WHERE t.split = 'train' AND {same}))
  OR (split = 'test' AND NOT EXISTS (SELECT 1 FROM c t WHERE t.split <> 'test' AND {same}))),"""
    if near:
        steps += f"""
src AS (SELECT doc_id AS row_id, trim(text, ' ') AS text, split FROM x), {_near_sql('src', 'near')},
e AS MATERIALIZED (SELECT * FROM x WHERE doc_id NOT IN (SELECT row_id FROM near)),"""
    else:
        steps += "\ne AS (SELECT * FROM x),"
    return steps + """
f AS (SELECT * FROM e WHERE split = 'train' OR (split = 'val' AND sender_domain NOT IN (SELECT sender_domain FROM e WHERE split = 'train'))
  OR (split = 'test' AND sender_domain NOT IN (SELECT sender_domain FROM e WHERE split <> 'test'))),
a AS (SELECT max(timestamp) FILTER (WHERE split = 'train') AS tm FROM f),
b AS (SELECT max(timestamp) AS vm FROM f, a WHERE split = 'val' AND timestamp > tm)"""


LAST_STEP_SQL = """
SELECT CAST(doc_id AS BIGINT) AS doc_id, split FROM f, a, b
WHERE split = 'train' OR (split = 'val' AND timestamp > tm) OR (split = 'test' AND (vm IS NULL OR timestamp > vm))"""


@query("leakage_chain", f"WITH {_chain_sql(timed=True, near=False)} {LAST_STEP_SQL}")
def leakage_chain(spark: SparkSession, sf: str) -> DataFrame:
    return finish(remove_leakage(_chain(spark, sf), "doc_id", near=False).select("doc_id", "split"))


@query("leakage_chain_near", f"WITH {_chain_sql(timed=False, near=True)} SELECT CAST(doc_id AS BIGINT) AS doc_id, split FROM f")
def leakage_chain_near(spark: SparkSession, sf: str) -> DataFrame:
    return finish(remove_leakage(_chain(spark, sf).drop("timestamp"), "doc_id", near=True).select("doc_id", "split"))


@query("leakage_chain_whole", f"WITH {_chain_sql(timed=True, near=True)} {LAST_STEP_SQL}")
def leakage_chain_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All four steps: exact copies, near copies, senders, time."""
    return finish(remove_leakage(_chain(spark, sf), "doc_id").select("doc_id", "split"))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    hours = F.make_dt_interval(F.lit(0), F.floor(F.col("doc_id") / 2).cast("int"))
    return docs.select(
        "doc_id", "text", "lang", F.concat_ws("-", F.col("n_chars").cast("string"), "source").alias("sender_domain"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("timestamp"),
        split_column("doc_id").alias("split"))
