"""URL queries over the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.specs import apply_specs, attach_reputation
from ..functions.url import (
    advanced_url_features, audit_domain, basic_url_features, host_domain, sample_tool_features, with_url_parts,
)
from ..operators.audit import audit, shared_domains
from ..session import read_spread, read_table
from .base import finish, outputs, query, split_column, split_sql, sql_rows

# literal rows next to the whole table, so that rare cases are met; the SQL repeats them
URL_ROWS = [
    (-1, "http://u:p@Ex.com:80/a/b?x=1#f"), (-2, "not a url"), (-3, "www.google.com/x"), (-4, "http://a_b.c.com/x?y"),
    (-5, ""), (-6, "http://192.168.1.1/admin"), (-7, "https://xn--80ak6aa92e.com/login.php?token=abcdefgh&a=1"),
    (-8, "a?x=1&y=2%&z=3"), (-9, "http://h.co/?a=&a=1&b=2"), (-10, "http://not.co/p.zip.html"),
    (-11, "https://bit.ly/3xYz"), (-12, "http://apple-support-verify.tk/login//secure/../x.exe.php"),
    (-13, "https://example.com/تسجيل/حساب?email=a@b.com"), (-14, "http://EXAMPLE.com/ABC%20def?session=0123456789#frag"),
    (-15, "http://h.example/" + "a" * 30 + "--/"), (-16, None),
]
URLS_SQL = f"urls AS (SELECT page_id, url FROM pages UNION ALL VALUES {sql_rows(URL_ROWS)})"
SPLIT_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
PARSED_SQL = URLS_SQL + f""",
split AS (
  SELECT page_id, url, coalesce(url, '') AS u,
         regexp_extract(coalesce(url, ''), '{SPLIT_RE}', 2) AS netloc,
         regexp_extract(coalesce(url, ''), '{SPLIT_RE}', 3) AS path,
         regexp_extract(coalesce(url, ''), '{SPLIT_RE}', 4) AS query
  FROM urls),
parsed AS (
  SELECT *, lower(regexp_replace(regexp_extract(netloc, '([^@]*)$', 1), ':.*$', '')) AS host FROM split)"""


def urls(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame(URL_ROWS, "page_id bigint, url string")
    return read_spread(spark, sf, "pages").select("page_id", "url").unionByName(extra)


def entropy_sql(col: str, epsilon: str = "0") -> str:
    share = f"((length({col}) - length(replace({col}, c, ''))) / CAST(length({col}) AS DOUBLE))"
    return (f"CASE WHEN length({col}) = 0 THEN 0 ELSE list_sum(list_transform(list_distinct(string_split({col}, '')), "
            f"lambda c: - {share} * log2({share} + {epsilon}))) END")


def char_sql(col: str, ch: str) -> str:
    return f"length({col}) - length(replace({col}, '{ch}', ''))"


def hits_sql(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{pattern}'))"


def contained_sql(col: str, words: list[str]) -> str:
    return " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


@query("url_basic_features", f"""
WITH {URLS_SQL}, t AS (SELECT page_id, coalesce(url, '') AS u FROM urls)
SELECT CAST(page_id AS BIGINT) AS page_id,
  CAST(regexp_matches(u, '\\d+\\.\\d+\\.\\d+\\.\\d+') AS BIGINT) AS has_ip_in_url,
  round({entropy_sql('u')}, 6) + 0.0 AS url_entropy,
  CAST(regexp_matches(lower(u), '[01@35!4]') AS BIGINT) AS has_homograph,
  CAST(regexp_matches(u, '(?i)(bit\\.ly|goo\\.gl|tinyurl|short\\.link|ow\\.ly)') AS BIGINT) AS has_url_shortener,
  CAST(length(u) AS BIGINT) AS url_length, CAST({char_sql('u', '.')} AS BIGINT) AS num_dots,
  CAST({hits_sql('u', '[0-9]')} AS BIGINT) AS num_digits_in_url
FROM t""")
def url_basic_features(spark: SparkSession, sf: str) -> DataFrame:
    return finish(basic_url_features(urls(spark, sf)).drop("url"))


@query("url_parse", f"""
WITH {PARSED_SQL}
SELECT CAST(page_id AS BIGINT) AS page_id, netloc, host, path, query,
  regexp_extract(u, '^(?:https?://)?([^/]+)', 1) AS audit_domain,
  CASE WHEN length(trim(u)) > 0 THEN nullif(regexp_replace(regexp_extract(
    CASE WHEN regexp_matches(trim(u), '^\\w+://') THEN trim(u) ELSE 'http://' || trim(u) END,
    '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), ':.*$', ''), '') END AS host_domain
FROM parsed""")
def url_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = with_url_parts(urls(spark, sf)).withColumn("u", F.coalesce("url", F.lit("")))
    return finish(df.select("page_id", "netloc", "host", "path", "query", audit_domain(F.col("u")).alias("audit_domain"),
                            host_domain(F.col("u")).alias("host_domain")))


@query("url_advanced_features", f"""
WITH {PARSED_SQL}, t AS (
  SELECT *, list_filter(regexp_split_to_array(u, '[/?&=.]'), lambda x: x <> '') AS tok,
    list_filter(string_split(query, '&'), lambda p: contains(p, '=') AND length(regexp_replace(p, '^[^=]*=', '')) > 0) AS prs
  FROM parsed),
f AS (
  SELECT page_id, u, length(u) AS url_length, {char_sql('u', '.')} AS num_dots,
    {hits_sql('u', '[0-9]')} AS num_digits_in_url, {entropy_sql('u')} AS url_entropy,
    {char_sql('u', '-')} AS num_hyphens, {char_sql('u', '_')} AS num_underscores, {char_sql('u', '/')} AS num_slashes,
    {char_sql('u', '?')} AS num_question_marks, {char_sql('u', '&')} AS num_ampersands,
    {char_sql('u', '=')} AS num_equals, {char_sql('u', '@')} AS num_at_symbols,
    {char_sql('u', '%')} AS num_percent_signs, length(netloc) AS domain_length,
    CASE WHEN contains(netloc, '.') THEN {char_sql('netloc', '.')} - 1 ELSE 0 END AS subdomain_count,
    CASE WHEN contains(netloc, '.') THEN length(string_split(netloc, '.')[-1]) ELSE 0 END AS tld_length,
    CAST(regexp_matches(lower(netloc), '\\.(tk|ml|ga|cf|gq|xyz|top|click)$') AS INT) AS has_suspicious_tld,
    length(path) AS path_length, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS num_path_tokens,
    length(query) AS query_length,
    len(list_distinct(list_transform(prs, lambda p: regexp_extract(p, '^([^=]*)', 1)))) AS num_query_params,
    CASE WHEN u = '' THEN 0 ELSE {hits_sql('u', chr(92) + 'p{Lu}')} / CAST(length(u) AS DOUBLE) END AS uppercase_ratio,
    CASE WHEN u = '' THEN 0 ELSE {hits_sql('u', '[0-9]')} / CAST(length(u) AS DOUBLE) END AS digit_ratio,
    CASE WHEN u = '' THEN 0 ELSE {hits_sql('u', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')} / CAST(length(u) AS DOUBLE) END AS special_char_ratio,
    {entropy_sql('netloc')} AS domain_entropy, {contained_sql('lower(u)', fv.PHISHING_KEYWORDS)} AS num_phishing_keywords,
    CAST(regexp_matches(u, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') AS INT) AS has_ip_address,
    CASE WHEN u = '' THEN 0 ELSE len(list_distinct(string_split(u, ''))) END AS char_variety,
    coalesce(list_avg(list_transform(tok, lambda x: length(x))), 0) AS avg_token_length,
    coalesce(list_max(list_transform(tok, lambda x: length(x))), 0) AS max_token_length
  FROM t),
g AS (
  SELECT *, least(1.0, CASE WHEN length(u) > 100 THEN 0.2 ELSE 0 END + CASE WHEN digit_ratio > 0.3 THEN 0.2 ELSE 0 END
    + CASE WHEN num_hyphens + num_underscores > 5 THEN 0.2 ELSE 0 END + CASE WHEN has_suspicious_tld = 1 THEN 0.3 ELSE 0 END
    + CASE WHEN num_phishing_keywords >= 2 THEN 0.3 ELSE 0 END) AS anomaly_score FROM f)
SELECT {outputs('page_id:i url_length:i num_dots:i num_digits_in_url:i url_entropy:d num_hyphens:i num_underscores:i '
                'num_slashes:i num_question_marks:i num_ampersands:i num_equals:i num_at_symbols:i num_percent_signs:i '
                'domain_length:i subdomain_count:i tld_length:i has_suspicious_tld:i path_length:i num_path_tokens:i '
                'query_length:i num_query_params:i uppercase_ratio:d digit_ratio:d special_char_ratio:d domain_entropy:d '
                'num_phishing_keywords:i has_ip_address:i char_variety:i avg_token_length:d max_token_length:i '
                'anomaly_score:d')}
FROM g""")
def url_advanced_features(spark: SparkSession, sf: str) -> DataFrame:
    return finish(advanced_url_features(urls(spark, sf)).drop("url"))


def _flag(col: str, pattern: str) -> str:
    return f"CAST(regexp_matches({col}, '{pattern}') AS INT)"


W = r"[\p{L}\p{N}_]"
SPEC_URL_SQL = {
    "url_len": "length(u)", "host_len": "length(host)", "path_len": "length(path)", "query_len": "length(query)",
    "num_params": f"len(regexp_extract_all(regexp_replace(u, '%[&?]', '%', 'g'), '[&?]{W}+='))",
    "num_subdomains": char_sql("host", "."), "tld_len": "length(string_split(host, '.')[-1])",
    "digits_in_host": hits_sql("host", "[0-9]"), "hyphens_in_host": char_sql("host", "-"),
    "dots_in_path": char_sql("path", "."), "slashes_count": char_sql("path", "/"),
    "has_multiple_slashes": _flag("path", "//.+/"), "has_port": _flag("host", ":[0-9]{2,5}$"),
    "has_at_symbol": _flag("u", "@"), "has_pct_encoding": _flag("u", "%[0-9A-Fa-f]{2}"),
    "has_unicode_punycode": _flag("host", "xn--"), "host_is_ipv4": _flag("host", r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    "starts_https": _flag("u", "(?i)^https://"),
    "has_ext_like_html": _flag("path", r"\.(php|asp|aspx|jsp|cfm|html?)($|[?&#])"),
    "shortener_domain": _flag("host", r"(bit\.ly|goo\.gl|t\.co|tinyurl\.com|ow\.ly|is\.gd|buff\.ly|cutt\.ly|rebrand\.ly|t\.ly)$"),
    "keyword_login": _flag("u", "(?i)login|signin|account|verify|secure"),
    "keyword_bank": _flag("u", "(?i)bank|paypal|wallet|invoice|billing|refund"),
    "keyword_arabic_sensitive": _flag("u", "تسجيل|حساب|تحقق|أمان|بطاقة|دفع|بنك|رصيد|فاتورة"),
    "query_has_token_like": _flag("query", "(?i)(token|session|auth|password|pass)=.{6,}"),
    "query_has_email": _flag("query", r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"),
    "rare_domain_flag": "CAST(rep.n <= 2 AS INT)", "top1m_umbrella": "CAST(rep.n >= 4 AS INT)",
    "top1m_majestic": "CAST(rep.n >= 6 AS INT)",
    "path_suspicious_mix": _flag("path", r"(?i)(%2e|\.|\-){2,}(/|$)|([A-Za-z0-9]{24,})"),
    "has_double_extension": _flag("path", r"\.(zip|rar|7z|exe)\.(php|html?)$"),
}


@query("spec_url_features", f"""
WITH {PARSED_SQL}, rep AS (SELECT host AS h, count(*) AS n FROM parsed GROUP BY host)
SELECT CAST(page_id AS BIGINT) AS page_id,
  {', '.join(f'CAST({expr} AS DOUBLE) + 0.0 AS {name}' for name, expr in SPEC_URL_SQL.items())}
FROM parsed JOIN rep ON rep.h = parsed.host""")
def spec_url_features(spark: SparkSession, sf: str) -> DataFrame:
    parsed = with_url_parts(urls(spark, sf)).withColumn("domain", F.col("host"))
    seen = parsed.groupBy("domain").agg(F.count("*").alias("n"))
    listed = attach_reputation(parsed, {
        "is_rare_domain": seen.where("n <= 2").select("domain"),
        "umbrella_top1m": seen.where("n >= 4").select("domain"),
        "majestic_top1m": seen.where("n >= 6").select("domain"),
    })
    return finish(apply_specs(listed, fv.URL_SPECS, "replace", keep=["page_id"]))


@query("tester_features", f"""
WITH {URLS_SQL}, t AS (
  SELECT u.page_id, coalesce(u.url, '') AS u, coalesce(regexp_extract(p.html, '<title>([^<]*)', 1), '') AS s,
         coalesce(p.html, '') AS b
  FROM urls u LEFT JOIN pages p ON p.page_id = u.page_id),
d AS (SELECT *, string_split(string_split(u, '//')[-1], '/')[1] AS domain FROM t)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(length(u) AS BIGINT) AS url_length,
  CAST({char_sql('u', '.')} AS BIGINT) AS num_dots, CAST({char_sql('u', '/')} AS BIGINT) AS num_slashes,
  CAST({hits_sql('u', '[0-9]')} AS BIGINT) AS num_digits,
  CAST(regexp_matches(string_split(domain, ':')[1], '[0-9]') AS BIGINT) AS has_ip,
  CAST(starts_with(u, 'https') AS BIGINT) AS has_https, CAST(contains(u, 'www.') AS BIGINT) AS has_www,
  CAST(length(domain) AS BIGINT) AS domain_length, CAST({char_sql('domain', '.')} AS BIGINT) AS domain_dots,
  CAST(length(s) AS BIGINT) AS subject_length, CAST(length(b) AS BIGINT) AS body_length,
  CAST({' + '.join(f"CAST(contains(lower(s), '{w}') OR contains(lower(b), '{w}') AS INT)" for w in fv.SUSPICIOUS_WORDS)} AS BIGINT)
    AS num_suspicious_words
FROM d""")
def tester_features(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    messages = urls(spark, sf).join(pages, "page_id", "left").withColumns({
        "email_subject": F.regexp_extract("html", "<title>([^<]*)", 1), "email_body": F.col("html")})
    return finish(sample_tool_features(messages).drop("url", "html", "email_subject", "email_body"))


def split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("email_subject"), F.col("html").alias("email_body"),
        split_column("page_id").alias("split"))


SPLIT_PAGES_SQL = f"""
pg AS (
  SELECT page_id, trim(url) AS url_canon, regexp_extract(trim(url), '^(?:https?://)?([^/]+)', 1) AS domain,
         regexp_extract(html, '<title>([^<]*)', 1) || ' ' || html AS txt, {split_sql('page_id')} AS split
  FROM pages)"""


def _overlap_sql(kind: str, col: str) -> str:
    pairs = []
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        pairs.append(
            f"SELECT '{a}_{b}' AS pair, '{kind}' AS kind, count(*) AS n FROM (SELECT sha1({col}) FROM pg WHERE split = '{a}' "
            f"INTERSECT SELECT sha1({col}) FROM pg WHERE split = '{b}')")
    return " UNION ALL ".join(pairs)


@query("split_audit", f"""
WITH {SPLIT_PAGES_SQL}, o AS ({_overlap_sql('url', 'url_canon')} UNION ALL {_overlap_sql('domain', 'domain')}
  UNION ALL {_overlap_sql('text', 'txt')}),
p AS (SELECT pair, max(n) FILTER (WHERE kind = 'url') AS url_overlap, max(n) FILTER (WHERE kind = 'domain') AS domain_overlap,
             max(n) FILTER (WHERE kind = 'text') AS text_overlap FROM o GROUP BY pair),
c AS (SELECT CASE WHEN sum(url_overlap + domain_overlap + text_overlap) = 0 THEN 0
             WHEN max(domain_overlap) FILTER (WHERE pair = 'train_test') > 100
               OR max(url_overlap) FILTER (WHERE pair = 'train_test') > 50 THEN 2 ELSE 1 END AS audit_code FROM p)
SELECT {outputs('pair:s url_overlap:i domain_overlap:i text_overlap:i audit_code:i')},
  CASE WHEN url_overlap + domain_overlap + text_overlap = 0 THEN 'NONE' WHEN domain_overlap > 50 THEN 'HIGH'
       WHEN domain_overlap > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM p CROSS JOIN c""")
def split_audit(spark: SparkSession, sf: str) -> DataFrame:
    return finish(audit(split_pages(spark, sf)))


@query("audit_top_domains", f"""
WITH {SPLIT_PAGES_SQL}, d AS (
  SELECT domain, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
         count(DISTINCT CASE WHEN split = 'train' THEN starts_with(url_canon, 'https') END) AS n_labels
  FROM pg GROUP BY domain)
SELECT {outputs('domain:s n_train:i n_test:i n_labels:i')}, CAST(n_train + n_test AS BIGINT) AS n_total
FROM d WHERE n_train > 0 AND n_test > 0 ORDER BY n_train + n_test DESC, domain LIMIT 10""")
def audit_top_domains(spark: SparkSession, sf: str) -> DataFrame:
    pages = split_pages(spark, sf).withColumn("label", F.col("url").startswith("https"))
    return finish(shared_domains(pages, label="label"))
