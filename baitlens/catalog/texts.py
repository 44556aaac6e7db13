"""Message text, sender, time and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels as lb
from ..functions import text as tx
from ..functions.specs import apply_specs
from ..functions.url import host_domain, registered_domains
from ..operators.dedup import content_hash, distinct_rows, first_per_key, union_by_name
from ..operators.schema import (
    align_numeric, apply_names, basic_numeric_block, common_columns, drop_unnamed, first_of_duplicate_columns,
    freeze_numeric_block, fused_text, lower_names, normalised_text_rows, numeric_block, numeric_only, require_columns,
    sanitise_names, sanitise_names_ascii, standardise_columns, synthesise_text,
)
from ..operators.splits import campaign_ids
from ..session import read_spread, read_table
from .base import finish, outputs, query, sql_rows, sql_text
from .urls import contained_sql, entropy_sql, hits_sql

TEXT_ROWS = [
    (-1, None), (-2, ""), (-3, "   "), (-4, "a"), (-5, "aab"), (-6, "aaabbbc"), (-7, "حساب بنك abc"), (-8, "😀a"),
    (-9, "line one\n\n\tline  two"), (-10, "URGENT! Your account will be suspended!!! Act now, limited time"),
    (-11, "Dear customer, hi there: your password and your payment expire"), (-12, "عاجل تحديث حسابك كلمة المرور"),
    (-13, "Call +1 (555) 123-4567 or mail ann@example.com, https://bit.ly/x"), (-14, "DE44500105175407324931 IBAN"),
    (-15, "<a  href='x'><script>1</script><form>prize??!! WhatsApp otp two-factor</form>"),
    (-16, "pay 0x52908400098527886E0F7030069857D2E4169EE7 ‏ crypto wallet"), (-17, "تعليق فاتورة بنك بطاقة"),
    (-18, "ÉTÉ NATO naïve ÀBC xABCx"),
]
SUBJECTS = [(-10, "Action required"), (-11, "update!!"), (-12, "عاجل"), (-13, "hello")]
DOCS_SQL = f"docs AS (SELECT doc_id, text FROM documents UNION ALL VALUES {sql_rows(TEXT_ROWS)})"

SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
PUNCT_SQL = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]"
# non-ASCII letters and digits become q, other non-ASCII characters become a dot: ASCII word boundaries then suffice
def ascii_sql(col: str) -> str:
    return rf"regexp_replace(regexp_replace({col}, '[^\x00-\x{{7F}}\p{{L}}\p{{N}}]', '.', 'g'), '[^\x00-\x{{7F}}]', 'q', 'g')"


def norm_sql(col: str) -> str:
    return f"trim(regexp_replace({col}, '{SPACE_SQL}+', ' ', 'g'))"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(TEXT_ROWS, "doc_id bigint, text string")
    return read_spread(spark, sf, "documents").select("doc_id", "text").unionByName(extra)


def _urgency_sql(col: str) -> str:
    return f"least(({contained_sql(f'lower({col})', fv.URGENCY_TERMS)}) / CAST({len(fv.URGENCY_TERMS)} AS DOUBLE), 1.0)"


W = r"[\p{L}\p{N}_]"
PERSONAL_SQL = [rf"dear{SPACE_SQL}+{W}+", rf"hello{SPACE_SQL}+{W}+", rf"hi{SPACE_SQL}+{W}+", "your account",
                "your password", "your payment"]


@query("text_signals", f"""
WITH {DOCS_SQL}, t AS (SELECT doc_id, coalesce(text, '') AS t FROM docs)
SELECT CAST(doc_id AS BIGINT) AS doc_id, round({_urgency_sql('t')}, 6) + 0.0 AS urgency_score,
  CAST(least(10, {hits_sql('t', SPACE_SQL + '{2,}')} + {hits_sql('t', '[.!?]{2,}')}
    + len(regexp_extract_all({ascii_sql('t')}, '\\b[A-Z]{{3,}}\\b'))) AS BIGINT) AS grammar_errors,
  round(({' + '.join(f"CAST(regexp_matches(lower(t), '{p}') AS INT)" for p in PERSONAL_SQL)}) / CAST(6 AS DOUBLE), 6) + 0.0
    AS personalization_score,
  CAST(length(t) AS BIGINT) AS char_count
FROM t""")
def text_signals(spark: SparkSession, sf: str) -> DataFrame:
    return finish(tx.text_signals(documents(spark, sf)).drop("text"))


EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
WORDS = rf"{W}+"


def _b(col: str, pattern: str) -> str:
    return f"CAST(regexp_matches({col}, '{pattern}') AS INT)"


def _a(col: str, pattern: str) -> str:
    return f"CAST(regexp_matches({ascii_sql(col)}, '{pattern}') AS INT)"


EPS_ENTROPY = "CAST(1e-12 AS DOUBLE)"
SPEC_EMAIL_SQL = {
    "subj_len": "length(s)", "body_len": "length(b)", "subj_words": hits_sql("s", WORDS), "body_words": hits_sql("b", WORDS),
    "body_entropy": f"round({entropy_sql('b', EPS_ENTROPY)}, 6)",
    "num_urls_body": f"len(regexp_extract_all({ascii_sql('b')}, '(?i)\\bhttps?://'))",
    "num_emails_body": hits_sql("b", EMAIL),
    "num_phones_body": hits_sql("b", rf"(\+?\p{{Nd}}[\p{{Nd}}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}().-]{{7,}}\p{{Nd}})"),
    "has_html_anchor": _b("b", rf"<a{SPACE_SQL}+[^>]*href="), "has_inline_js": _a("b", r"<script\b"),
    "has_form": _a("b", r"<form\b"), "subj_has_urgent": _b("s", "(?i)urgent|immediately|action required|verify|update"),
    "subj_has_urgent_ar": _b("s", "عاجل|فوري|مطلوب إجراء|تحقق|تحديث"),
    "body_has_threat": _b("b", "(?i)suspend|suspension|disabled|limit|violation|penalty"),
    "body_has_threat_ar": _b("b", "تعليق|إيقاف|تقييد|مخالفة|عقوبة|تنبيه"),
    "body_money_terms": hits_sql("b", "(?i)invoice|payment|bank|wallet|crypto|refund|prize|lottery|transfer"),
    "body_money_terms_ar": hits_sql("b", "فاتورة|دفعة|بنك|محفظة|تحويل|جائزة|سحب|استرداد|بطاقة|رصيد"),
    "has_credentials_req": _b("b", "(?i)password|passcode|otp|two[- ]?factor|code"),
    "has_credentials_req_ar": _b("b", f"كلمة{SPACE_SQL}?المرور|المرور|رمز|توثيق|تحقق{SPACE_SQL}?ثنائي|كود"),
    "arabic_ratio_body": f"round({hits_sql('b', '[' + chr(0x600) + '-' + chr(0x6FF) + ']')} / CAST(greatest(length(b), 1) AS DOUBLE), 6)",
    "latin_ratio_body": f"round({hits_sql('b', '[A-Za-z]')} / CAST(greatest(length(b), 1) AS DOUBLE), 6)",
    "has_whatsapp": _b("b", "(?i)whatsapp|واتساب"),
    "has_crypto_addr_like": _a("b", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|\b0x[a-fA-F0-9]{40}\b"),
    "has_iban_like": _a("b", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    "subj_excess_punct": hits_sql("s", "[!?]{2,}"), "body_excess_punct": hits_sql("b", "[!?]{2,}"),
    "url_shortener_in_body": _b("b", r"(?i)(bit\.ly|t\.co|tinyurl\.com|is\.gd|cutt\.ly|rebrand\.ly|t\.ly)/"),
}


@query("spec_email_features", f"""
WITH {DOCS_SQL}, t AS (
  SELECT d.doc_id, coalesce(d.text, '') AS b, coalesce(m.subject, '') AS s
  FROM docs d LEFT JOIN (VALUES {sql_rows(SUBJECTS)}) AS m(doc_id, subject) ON m.doc_id = d.doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id,
  {', '.join(f'CAST({expr} AS DOUBLE) + 0.0 AS {name}' for name, expr in SPEC_EMAIL_SQL.items())}
FROM t""")
def spec_email_features(spark: SparkSession, sf: str) -> DataFrame:
    subjects = spark.createDataFrame(SUBJECTS, "doc_id bigint, subject string")
    mails = documents(spark, sf).withColumnRenamed("text", "body").join(F.broadcast(subjects), "doc_id", "left")
    return finish(apply_specs(mails, fv.EMAIL_SPECS, "replace", keep=["doc_id"]))


RUNS_SQL = """
ch AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM t),
runs AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g, c FROM ch),
longest AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, c, g, count(*) AS n FROM runs GROUP BY ALL) GROUP BY doc_id)"""


@query("spec_common_features", f"""
WITH {DOCS_SQL}, t AS (
  SELECT doc_id, regexp_replace(' ' || coalesce(text, '') || ' ', '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS t FROM docs),
{RUNS_SQL}
SELECT CAST(t.doc_id AS BIGINT) AS doc_id, CAST(length(t) AS DOUBLE) AS feat_len_chars,
  CAST({hits_sql('t', WORDS)} AS DOUBLE) AS feat_len_words,
  round({entropy_sql('t', EPS_ENTROPY)}, 6) + 0.0 AS feat_entropy_chars,
  round({hits_sql('t', '[' + chr(0x600) + '-' + chr(0x6FF) + ']')} / CAST(greatest(length(t), 1) AS DOUBLE), 6) AS feat_ratio_arabic,
  round({hits_sql('t', '[A-Za-z]')} / CAST(greatest(length(t), 1) AS DOUBLE), 6) AS feat_ratio_latin,
  round({hits_sql('t', chr(92) + 'p{Nd}')} / CAST(greatest(length(t), 1) AS DOUBLE), 6) AS feat_ratio_digits,
  round({hits_sql('t', PUNCT_SQL)} / CAST(greatest(length(t), 1) AS DOUBLE), 6) AS feat_ratio_punct,
  CASE WHEN t = '' THEN 0.0 ELSE CAST(len(list_distinct(string_split(t, ''))) AS DOUBLE) END AS feat_unique_char_count,
  CASE WHEN t = '' THEN 0.0 ELSE CAST(run AS DOUBLE) END AS feat_max_char_run,
  CAST(regexp_matches(t, '\\x{{200f}}|\\x{{202b}}|\\x{{202e}}') AS INT)::DOUBLE AS feat_has_rtl_marks,
  CAST({hits_sql('t', EMAIL)} AS DOUBLE) AS feat_num_emails_in_text,
  CAST(len(regexp_extract_all({ascii_sql('t')}, '(?i)\\bhttps?://')) AS DOUBLE) AS feat_num_urls_in_text
FROM t LEFT JOIN longest USING (doc_id)""".replace("CASE WHEN t = '' THEN 0.0 ELSE", "CASE WHEN t = '' THEN CAST(0 AS DOUBLE) ELSE"))
def spec_common_features(spark: SparkSession, sf: str) -> DataFrame:
    return finish(apply_specs(documents(spark, sf), fv.COMMON_SPECS, "replace", keep=["doc_id"]))


TIME_ROWS = [(-1, "2024-01-06 10:00:00"), (-2, "2024-01-05 09:00:00"), (-3, "2024-01-05 17:59:00"),
             (-4, "2024-01-05 18:00:00"), (-5, "not a time")]


@query("temporal_features", f"""
WITH e AS (SELECT event_id, ts FROM events UNION ALL
  SELECT col0, try_cast(col1 AS TIMESTAMP) FROM (VALUES {sql_rows(TIME_ROWS)}))
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(hour(ts) AS BIGINT) AS hour,
  CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(coalesce(isodow(ts) - 1 >= 5, false) AS BIGINT) AS is_weekend,
  CAST(coalesce(hour(ts) BETWEEN 9 AND 17, false) AS BIGINT) AS is_business_hours
FROM e""")
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(TIME_ROWS, "event_id bigint, timestamp string")
    events = read_table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("timestamp"))
    return finish(tx.temporal_features(events.unionByName(extra)).drop("timestamp"))


SENDER_ROWS = [(-1, "A@X.com"), (-2, "a@b@c"), (-3, "a@"), (-4, "no-at"), (-5, None)]


@query("sender_groups", f"""
WITH s AS (SELECT c_custkey AS row_id, c_name || '@' || c_mktsegment || c_nationkey || '.Example' AS sender FROM customer
  UNION ALL VALUES {sql_rows(SENDER_ROWS)}),
d AS (SELECT row_id, CASE WHEN instr(trim(sender), '@') > 0 AND length(substr(trim(sender), instr(trim(sender), '@') + 1)) > 0
        THEN lower(substr(trim(sender), instr(trim(sender), '@') + 1)) ELSE 'unknown' END AS sender_domain FROM s),
f AS (SELECT sender_domain, row_number() OVER (ORDER BY min(row_id)) - 1 AS campaign_id FROM d GROUP BY sender_domain)
SELECT {outputs('row_id:i sender_domain:s campaign_id:i')} FROM d JOIN f USING (sender_domain)""")
def sender_groups(spark: SparkSession, sf: str) -> DataFrame:
    customer = read_table(spark, sf, "customer")
    sender = F.concat("c_name", F.lit("@"), "c_mktsegment", F.col("c_nationkey").cast("string"), F.lit(".Example"))
    extra = spark.createDataFrame(SENDER_ROWS, "row_id bigint, sender string")
    rows = customer.select(F.col("c_custkey").alias("row_id"), sender.alias("sender")).unionByName(extra)
    domains = rows.select("row_id", tx.sender_domain(F.col("sender")).alias("sender_domain"))
    return finish(campaign_ids(domains, "sender_domain", "row_id"))


@query("text_normalise_filter", f"""
WITH t AS (
  SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source || '/' || lang END AS url_canon,
         CASE WHEN doc_id % 2 = 0 THEN source END AS url, lang AS email_subject, text AS email_body FROM documents
  UNION ALL SELECT doc_id, '', NULL, NULL, text FROM (VALUES {sql_rows(TEXT_ROWS)}) AS v(doc_id, text)),
f AS (SELECT row_id, {norm_sql("""CASE WHEN coalesce(nullif(url_canon, ''), nullif(url, ''), '') <> ''
  THEN coalesce(nullif(url_canon, ''), nullif(url, '')) ELSE trim(coalesce(email_subject, '') || ' ' || coalesce(email_body, '')) END""")} AS fused,
  {norm_sql("coalesce(email_body, '')")} AS body FROM t)
SELECT CAST(row_id AS BIGINT) AS row_id, fused, CAST(length(body) AS BIGINT) AS body_chars FROM f
WHERE length(fused) > 0 AND length(body) > 0""")
def text_normalise_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    rows = docs.select(
        F.col("doc_id").alias("row_id"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat_ws("/", "source", "lang")).alias("url_canon"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("url"),
        F.col("lang").alias("email_subject"), F.col("text").alias("email_body"),
    )
    extra = spark.createDataFrame([(i, "", None, None, t) for i, t in TEXT_ROWS], rows.schema)
    fused = normalised_text_rows(fused_text(rows.unionByName(extra), "fused"), "email_body")
    return finish(fused.select("row_id", "fused", F.length("email_body").alias("body_chars")))


LABEL_WORDS = ["spam", " Phishing ", "1", "1.0", "0", "not spam", "not phishing", "invalid", "unsafe", "unknown", None,
               "scam mail", "Legit", "ham_email", "malware", "good", "true"]
LABEL_ROWS = [(-i - 1, w) for i, w in enumerate(LABEL_WORDS)]
WORDS_SQL = f"""
words AS (
  SELECT event_id AS row_id, CASE event_type WHEN 'error' THEN 'Fraud attempt' WHEN 'click' THEN ' SPAM' WHEN 'view' THEN 'ham'
    WHEN 'signup' THEN 'benign' ELSE event_type END AS w FROM events UNION ALL VALUES {sql_rows(LABEL_ROWS)}),
norm AS (SELECT row_id, lower(trim(w)) AS w FROM words)"""


def label_words(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    word = (F.when(kind == "error", "Fraud attempt").when(kind == "click", " SPAM").when(kind == "view", "ham")
            .when(kind == "signup", "benign").otherwise(kind))
    extra = spark.createDataFrame(LABEL_ROWS, "row_id bigint, w string")
    return read_table(spark, sf, "events").select(F.col("event_id").alias("row_id"), word.alias("w")).unionByName(extra)


def _in(words) -> str:
    return "(" + ", ".join(sql_text(w) for w in words) + ")"


INGEST_POS = [k for k, v in fv.INGEST_LABELS.items() if v == 1]
INGEST_NEG = [k for k, v in fv.INGEST_LABELS.items() if v == 0]


@query("label_map_ingest", f"""
WITH {WORDS_SQL}, m AS (SELECT row_id, CASE WHEN w IN {_in(INGEST_POS)} THEN 1 WHEN w IN {_in(INGEST_NEG)} THEN 0
  WHEN regexp_matches(w, 'phish|spam|malicious|fraud|attack|scam|fake|decept') THEN 1
  WHEN regexp_matches(w, 'legit|ham|benign|safe|normal|clean|valid') THEN 0 END AS label FROM norm)
SELECT {outputs('row_id:i label:i')}, (SELECT count(*) FROM m WHERE label IS NULL) AS dropped FROM m WHERE label IS NOT NULL""")
def label_map_ingest(spark: SparkSession, sf: str) -> DataFrame:
    mapped = label_words(spark, sf).select("row_id", lb.ingest_label(F.col("w")).alias("label"))
    dropped = mapped.agg(F.count_if(F.col("label").isNull())).scalar()
    return finish(mapped.where("label IS NOT NULL").withColumn("dropped", dropped))


@query("label_map_training", f"""
WITH {WORDS_SQL}
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(CASE WHEN w IN {_in(fv.TRAINING_POSITIVE)} THEN 1 ELSE 0 END AS BIGINT) AS label,
  CAST(CASE WHEN row_id > 100 THEN 1 ELSE 0 END AS BIGINT) AS numeric_label
FROM norm""")
def label_map_training(spark: SparkSession, sf: str) -> DataFrame:
    words = label_words(spark, sf).withColumn("signed", F.col("row_id") - 100)
    return finish(words.select("row_id", lb.training_label(words, "w").alias("label"),
                               lb.training_label(words, "signed").alias("numeric_label")))


@query("unknown_labels", f"""
WITH {WORDS_SQL}
SELECT DISTINCT w AS unknown_label FROM norm WHERE w NOT IN {_in(fv.TRAINING_POSITIVE + fv.TRAINING_NEGATIVE)}
ORDER BY 1 LIMIT 10""")
def unknown_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lb.unknown_training_labels(label_words(spark, sf), "w")


@query("label_map_cv", f"""
WITH d AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'Phish' ELSE ' good' END AS word, CAST(toxic AS VARCHAR) || '.7' AS num FROM labels)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN lower(trim(word)) IN {_in(fv.CV_POSITIVE)} THEN 1 ELSE 0 END AS BIGINT) AS by_word,
  CAST(trunc(CAST(num AS DOUBLE)) AS BIGINT) AS by_number,
  CAST(CASE WHEN word = 'Phish' THEN 1 ELSE 0 END AS BIGINT) AS by_corpus
FROM d""")
def label_map_cv(spark: SparkSession, sf: str) -> DataFrame:
    table = read_table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "Phish").otherwise(" good").alias("label"),
        F.concat(F.col("toxic").cast("string"), F.lit(".7")).alias("num"),
        F.when(F.col("quality") == 1, "spam").otherwise("ham").alias("corpus"))
    named = lb.cv_binary(table, lb.pick_label_column(table.columns), "by_word")
    both = lb.cv_binary(named, "num", "by_number").withColumn("by_corpus", lb.corpus_label(F.col("corpus")))
    return finish(both.select("doc_id", "by_word", "by_number", "by_corpus"))


@query("union_heterogeneous", """
SELECT CAST(doc_id AS BIGINT) AS row_id, source AS label, text, lang, CAST(NULL AS VARCHAR) AS message, CAST(n_chars AS BIGINT) AS n_chars FROM documents
UNION ALL
SELECT CAST(conv_id * 1000 + turn AS BIGINT), role, text, NULL, text, NULL FROM conversations
UNION ALL
SELECT CAST(page_id AS BIGINT), NULL, html || ' ' || url, NULL, html, NULL FROM pages""")
def union_heterogeneous(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("Class "), F.col("text").alias("Body"), "lang", "n_chars")
    talks = read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("v1"), F.col("text").alias("v2"),
        F.col("text").alias("message"))
    pages = read_table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.col("html").alias("payload"), "url")
    frames = [standardise_columns(lower_names(docs)), standardise_columns(talks)]
    made = synthesise_text(pages).select("row_id", "text", F.col("payload").alias("message"))
    return finish(union_by_name(*frames, made).select("row_id", "label", "text", "lang", "message", "n_chars"))


TWICE_SQL = """
twice AS (SELECT doc_id AS row_id, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS url, lang FROM documents
  UNION ALL SELECT doc_id + 1000000000, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END, lang FROM documents)"""


def twice(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "text", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("url"), "lang")
    return docs.unionByName(docs.withColumn("row_id", F.col("row_id") + 1_000_000_000))


@query("dedupe_first_wins", f"""
WITH {TWICE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY text, url ORDER BY row_id) AS rn FROM twice)
SELECT CAST(row_id AS BIGINT) AS row_id, text, url, lang FROM r WHERE rn = 1""")
def dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return finish(first_per_key(twice(spark, sf), ["text", "url"], "row_id"))


@query("distinct_rows", f"WITH {TWICE_SQL} SELECT DISTINCT text, url, lang FROM twice")
def distinct_documents(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_rows(twice(spark, sf).drop("row_id"))


@query("schema_shaping", f"""
WITH p AS (SELECT page_id, trim(url) AS u, url FROM pages), q AS (SELECT p_partkey, p_size, p_retailprice FROM part)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(length(url) AS DOUBLE) AS url_length,
  CAST(length(url) - length(replace(url, '.', '')) AS DOUBLE) AS num_dots,
  CAST({hits_sql('url', '[0-9]')} AS DOUBLE) AS num_digits_in_url,
  round(CAST(coalesce(p_size, 0) AS DOUBLE), 6) AS p_size, round(coalesce(p_retailprice, 0), 6) AS f_2_price,
  round(coalesce(p_retailprice, 0), 6) + 0.0 AS f_2_price_2, CAST(0 AS DOUBLE) AS absent,
  substr(url, 1, 20) || CASE WHEN length(url) > 20 THEN '...' ELSE '' END AS shown,
  regexp_extract(u, '^(?:https?://)?([^/]+)', 1) AS domain,
  'p_size' AS common, 'F_2_price,F_2_price_2,a_b' AS ascii_names
FROM p LEFT JOIN q ON p_partkey = page_id""")
def schema_shaping(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", F.lit(1).alias("Unnamed: 0"), F.col("url"),
                                                  F.col("url").alias(" url "))
    pages = basic_numeric_block(first_of_duplicate_columns(drop_unnamed(pages)))
    part = read_table(spark, sf, "part").select(
        "p_partkey", "p_size", F.col("p_retailprice").alias("2 price"), F.col("p_retailprice").alias("2-price"),
        F.lit(1).alias("label"))
    frozen = freeze_numeric_block(pages.drop("page_id"))
    numbers = numeric_block(pages, frozen, keep=["page_id", "url"])
    mapping = sanitise_names(["p_size", "2 price", "2-price", "absent"])
    named = apply_names(align_numeric(numeric_only(part, keep=["p_partkey"]), ["p_partkey", "p_size", "2 price", "2-price"]),
                        mapping, keep=["p_partkey"])
    joined = numbers.join(named, numbers["page_id"] == named["p_partkey"], "left").drop("p_partkey")
    require_columns(joined.withColumn("label", F.lit(0)))
    shared = ",".join(common_columns(part, part.select("p_size", "label"), part.drop("2 price")))
    return finish(joined.select(
        "page_id", *frozen, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in mapping.values()],
        tx.preview(F.col("url"), 20).alias("shown"),
        F.regexp_extract(F.trim("url"), "^(?:https?://)?([^/]+)", 1).alias("domain"),
        F.lit(shared).alias("common"), F.lit(",".join(sanitise_names_ascii(["2 price(!", "2 price(", "a b"]))).alias("ascii_names"),
    ))


@query("group_keys", f"""
WITH r AS (
  SELECT page_id AS row_id, 'URL' AS modality, url, NULL AS body FROM pages
  UNION ALL SELECT 1000000000 + doc_id, 'Email', NULL, text FROM documents),
d AS (SELECT *, CASE WHEN url IS NOT NULL THEN nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), ':.*$', ''), '') END AS dom,
  {norm_sql("coalesce(nullif(url, ''), coalesce(body, ''))")} AS text FROM r)
SELECT CAST(row_id AS BIGINT) AS row_id, lower(modality) || ':' || coalesce(dom, 'no-domain') AS group_key,
  lower(modality) || ':' || coalesce(dom, 'nodom:' || md5({norm_sql('lower(text)')})) AS group_key_fingerprint,
  lower(modality) AS stratum
FROM d WHERE length(text) > 0""")
def group_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select(
        F.col("page_id").alias("row_id"), F.lit("URL").alias("modality"), "url", F.lit(None).cast("string").alias("email_body"))
    docs = read_table(spark, sf, "documents").select(
        (F.col("doc_id") + 1_000_000_000).alias("row_id"), F.lit("Email").alias("modality"),
        F.lit(None).cast("string").alias("url"), F.col("text").alias("email_body"))
    rows = fused_text(pages.unionByName(docs)).withColumn("domain", host_domain(F.col("url")))
    return finish(rows.select(
        "row_id", tx.group_key(F.col("modality"), F.col("domain")).alias("group_key"),
        tx.group_key(F.col("modality"), F.col("domain"), F.col("text")).alias("group_key_fingerprint"),
        F.lower("modality").alias("stratum")))


# a suffix list as long as the table: the last label of every host, and rules of each kind for two labels by their digest
SUFFIX_KINDS = [("", "0123456789"), ("*.", "789abc"), ("!", "de")]


@query("registered_domain_keys", f"""
WITH h AS (SELECT page_id, lower(nullif(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), ':.*$', ''), '')) AS host FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM h WHERE host IS NOT NULL),
two AS (SELECT DISTINCT array_to_string(labels[-2:], '.') AS t, substr(md5(array_to_string(labels[-2:], '.')), 1, 1) AS d FROM hosts WHERE len(labels) > 1),
rules AS (SELECT DISTINCT labels[-1] AS rule FROM hosts
  {" ".join(f"UNION SELECT '{mark}' || t FROM two WHERE contains('{digits}', d)" for mark, digits in SUFFIX_KINDS)}),
tails AS (SELECT host, labels, i, array_to_string(labels[i:], '.') AS tail FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i FROM hosts)),
m AS (SELECT host, any_value(labels) AS labels, coalesce(min(CASE WHEN rule = '!' || tail THEN i + 1 END),
    min(CASE WHEN rule = tail THEN i WHEN rule = '*.' || tail AND i > 1 THEN i - 1 END)) AS first
  FROM tails JOIN rules ON rule IN (tail, '*.' || tail, '!' || tail) GROUP BY host)
SELECT CAST(page_id AS BIGINT) AS page_id, h.host, CASE WHEN first > 1 THEN array_to_string(labels[first - 1:], '.') ELSE h.host END AS registered_domain,
  'url:' || coalesce(CASE WHEN first > 1 THEN array_to_string(labels[first - 1:], '.') ELSE h.host END, 'no-domain') AS group_key
FROM h LEFT JOIN m ON m.host = h.host""")
def registered_domain_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Group keys of the pages by their registered domain."""
    pages = read_table(spark, sf, "pages").select("page_id", F.lower(host_domain(F.col("url"))).alias("host"))
    labels = F.split("host", r"\.")
    hosts = pages.where("host IS NOT NULL").select("host").distinct()
    two = hosts.where(F.size(labels) > 1).select(F.array_join(F.slice(labels, -2, 2), ".").alias("t")).distinct()
    rules = hosts.select(F.element_at(labels, -1).alias("suffix"))
    for mark, digits in SUFFIX_KINDS:
        rules = rules.union(two.where(F.contains(F.lit(digits), F.substring(F.md5("t"), 1, 1))).select(F.concat(F.lit(mark), "t")))
    keyed = registered_domains(pages, "host", rules)
    return finish(keyed.withColumn("group_key", tx.group_key(F.lit("URL"), F.col("registered_domain"))))


@query("row_hashes", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, sha1(text) AS sha, md5(substr({norm_sql('lower(text)')}, 1, 256)) AS fingerprint_start,
  md5({norm_sql('lower(text)')}) AS fingerprint,
  md5('{{"source":"' || source || '","lang":"' || lang || '","n_chars":' || n_chars || '}}') AS content_hash
FROM documents""")
def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    hashed = content_hash(docs.select("doc_id", "text", "source", "lang", "n_chars"), ignore=("doc_id", "text"))
    return finish(hashed.select(
        "doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("sha"),
        tx.fingerprint(F.col("text"), 256).alias("fingerprint_start"), tx.fingerprint(F.col("text")).alias("fingerprint"),
        "content_hash"))
