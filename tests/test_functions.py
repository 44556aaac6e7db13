"""Scalars against hand-computed values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from baitlens.functions import fixed_values as fv
from baitlens.functions import labels as lb
from baitlens.functions import probability as pr
from baitlens.functions import text as tx
from baitlens.functions.regex import unicode_pattern
from baitlens.functions.specs import apply_specs, attach_reputation, load_specs
from baitlens.functions.url import (
    advanced_url_features, basic_url_features, domain_in_list, host_domain, registered_domains, with_url_parts,
)

V = F.col("v")


@pytest.mark.parametrize("text, expected", [
    ("", 0.0), ("a", 0.0), ("aab", 0.9182958340544896), ("😀a", 1.0), ("aabb", 1.0),
])
def test_entropy(one, text, expected):
    assert one(text, tx.entropy(V)) == pytest.approx(expected, abs=1e-9)


def test_entropy_with_epsilon(one):
    p = [2 / 3, 1 / 3]
    expected = -sum(x * math.log2(x + 1e-12) for x in p)
    assert one("aab", tx.entropy(V, 1e-12)) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("text, run, unique, words", [
    ("", 0, 0, 0), ("a", 1, 1, 1), ("aaabbbc", 3, 3, 1), ("حساب بنك abc", 1, 10, 3), ("😀😀a", 2, 2, 1), ("x\n\n\ny", 3, 3, 2),
])
def test_runs_and_words(one, text, run, unique, words):
    assert one(text, tx.longest_run(V)) == run
    assert one(text, tx.distinct_characters(V)) == unique
    assert one(text, tx.word_count(V)) == words


def test_charset_ratios(one):
    text = "ab1! بن"
    assert one(text, *[tx.charset_ratio(V, c) for c in ("arabic", "latin", "digits", "punct", "other")]) == pytest.approx(
        (2 / 7, 2 / 7, 1 / 7, 1 / 7, 0.0))


def test_unicode_pattern_boundaries(one):
    shouting = unicode_pattern(r"\b[A-Z]{3,}\b")
    assert one("ABC éABC ABCé XYZ", F.regexp_count("v", F.lit(shouting))) == 2
    assert one("a b　c", F.regexp_count("v", F.lit(unicode_pattern(r"\s")))) == 2
    assert one("SUSPENDED Verify", V.rlike(unicode_pattern("(?i)suspend|verify"))) is True
    assert one("nothing", V.rlike(unicode_pattern("(?i)suspend|verify"))) is False


def test_text_signals_prefer_body(spark):
    row = tx.text_signals(spark.createDataFrame([("URGENT!! Dear bob  act now", "x")], "body string, text string")).first()
    assert row["char_count"] == 26
    assert row["urgency_score"] == pytest.approx(2 / 24)
    assert row["grammar_errors"] == 3  # doubled blank, doubled mark, capital word
    assert row["personalization_score"] == pytest.approx(1 / 6)
    assert "char_count" not in tx.text_signals(spark.range(1)).columns


@pytest.mark.parametrize("sender, domain", [
    ("A@X.com", "x.com"), ("a@b@c", "b@c"), ("a@", "unknown"), ("no-at", "unknown"), (None, "unknown"), (" a@Y.org ", "y.org"),
])
def test_sender_domain(one, sender, domain):
    assert one(sender, tx.sender_domain(V)) == domain


@pytest.mark.parametrize("stamp, expected", [
    ("2024-01-06 10:00:00", (10, 5, 1, 1)), ("2024-01-05 09:00:00", (9, 4, 0, 1)), ("2024-01-05 17:59:00", (17, 4, 0, 1)),
    ("2024-01-05 18:00:00", (18, 4, 0, 0)), ("no time", (None, None, 0, 0)), (None, (None, None, 0, 0)),
])
def test_temporal(spark, stamp, expected):
    df = spark.createDataFrame([(stamp,)], "timestamp string")
    row = tx.temporal_features(df).select("hour", "day_of_week", "is_weekend", "is_business_hours").first()
    assert tuple(row) == expected


@pytest.mark.parametrize("url, parts", [
    ("http://u:p@Ex.com:80/a/b?x=1#f", ("u:p@Ex.com:80", "ex.com", "/a/b", "x=1")),
    ("not a url", ("", "", "not a url", "")), ("www.google.com/x", ("", "", "www.google.com/x", "")),
    ("http://a_b.c.com/x?y", ("a_b.c.com", "a_b.c.com", "/x", "y")), (None, ("", "", "", "")),
    ("http://[::1]:8080/p", ("[::1]:8080", "::1", "/p", "")), ("http://[broken/p", ("", "", "", "")),
    ("//host/p", ("host", "host", "/p", "")), ("  http://h\t.co/\n", ("h.co", "h.co", "/", "")),
    ("http://h?q#f", ("h", "h", "", "q")), ("mailto:a@b.c", ("", "", "a@b.c", "")),
])
def test_url_parts(spark, url, parts):
    row = with_url_parts(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["netloc"], row["host"], row["path"], row["query"]) == parts


@pytest.mark.parametrize("url, domain", [
    ("https://a.b.com:8/x", "a.b.com"), ("a.b.com/x", "a.b.com"), ("", None), (" ", None), (None, None),
])
def test_host_domain(one, url, domain):
    assert one(url, host_domain(V)) == domain


def test_registered_domains_with_a_long_list(spark):
    """A hundred thousand rules of each kind of meaning, against a plain walk over the labels."""
    rules = {f"s{i}.zz" for i in range(99_000)} | {"zz", "com", "co.uk", "uk"} | {f"*.w{i}" for i in range(900)} | {f"!keep.w{i}" for i in range(0, 900, 3)}
    hosts = [f"a.b.s{i}.zz" for i in range(0, 300, 7)] + [f"x.{n}.w{i}" for i in range(40) for n in ("keep", "other")] + [
        "w7", "a.w7", "keep.w9", "x.co.uk", "co.uk", "uk", "Www.Shop.COM", "none.here", "zz", "a.s99999.zz"]

    def plain(host):
        labels, best = host.split("."), None
        for i in range(len(labels)):
            tail = ".".join(labels[i:]).lower()
            if "!" + tail in rules:
                return ".".join(labels[i:])
            if best is None and (tail in rules or i + 1 < len(labels) and "*." + ".".join(labels[i + 1:]).lower() in rules):
                best = i
        return ".".join(labels[best - 1:]) if best else host

    frame = spark.createDataFrame([(h,) for h in [*hosts, None]], "host string")
    got = {r["host"]: r["registered_domain"] for r in registered_domains(frame, "host", spark.createDataFrame([(r,) for r in rules], "suffix string")).collect()}
    assert got == {h: plain(h) for h in hosts} | {None: None}


def test_registered_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("com",), ("plain",), (None,)], "host string")
    suffixes = spark.createDataFrame([("co.uk",), ("uk",), ("com",)], "suffix string")
    rows = {r["host"]: r["registered_domain"] for r in registered_domains(hosts, "host", suffixes).collect()}
    assert rows == {"a.b.co.uk": "b.co.uk", "x.com": "x.com", "com": "com", "plain": "plain", None: None}


def test_domain_list_boundary(one):
    assert one("not.co", domain_in_list(V, ["t.co"])) is True
    assert one("not.co", domain_in_list(V, ["t.co"], strict=True)) is False


def test_advanced_features(spark):
    df = spark.createDataFrame([("http://Login-x.tk/a//b?a=&a=1&b=2&c%20d=3&c+d=4",)], "url string")
    row = advanced_url_features(df.withColumn("host", F.lit("kept"))).first()
    assert row["host"] == "kept"
    assert row["num_query_params"] == 3
    assert row["num_path_tokens"] == 2 and row["path_length"] == 5
    assert row["has_suspicious_tld"] == 1 and row["tld_length"] == 2 and row["subdomain_count"] == 0
    assert row["num_phishing_keywords"] == 1
    assert row["anomaly_score"] == pytest.approx(0.3)
    empty = advanced_url_features(spark.createDataFrame([(None,)], "url string")).first()
    assert empty["max_token_length"] == 0 and empty["avg_token_length"] == 0.0 and empty["char_variety"] == 0


def test_basic_features_keep_null(spark):
    row = basic_url_features(spark.createDataFrame([(None,), ], "url string")).first()
    assert (row["url_length"], row["url_entropy"], row["has_ip_in_url"]) == (0, 0.0, 0)


def test_spec_counts_and_modes(spark, tmp_path):
    assert len(load_specs()) == 69
    assert (len(fv.URL_SPECS), len(fv.EMAIL_SPECS), len(fv.COMMON_SPECS)) == (30, 27, 12)
    df = spark.createDataFrame([("a?x=1&y=2%&z=3", "urgent", "body")], "url string, subject string, body string")
    row = apply_specs(df).first()
    assert row["num_params"] == 2.0 and row["subj_has_urgent"] == 1.0 and row["body_len"] == 4.0
    assert row["feat_len_chars"] == float(len("urgent body a?x=1&y=2%&z=3"))
    assert apply_specs(df, mode="off").columns == df.columns
    assert len(apply_specs(df, mode="replace").columns) == 69
    kept = apply_specs(df.withColumn("url_len", F.lit(-1)))
    assert kept.first()["url_len"] == -1
    (tmp_path / "url_features.json").write_text(json.dumps({"features": [
        {"name": "n", "type": "len", "source": "url"}, {"name": "odd", "type": "nothing", "source": "url"}]}))
    custom = apply_specs(df, load_specs(str(tmp_path)), "replace").first()
    assert custom.asDict() == {"n": 14.0, "odd": 0.0}
    with pytest.raises(ValueError):
        apply_specs(df, mode="other")


def test_reputation_flags(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "domain string")
    listed = spark.createDataFrame([("a",), ("a",)], "name string")
    rows = {r["domain"]: r["umbrella_top1m"] for r in attach_reputation(df, {"umbrella_top1m": listed}).collect()}
    assert rows == {"a": True, "b": False, None: False}


@pytest.mark.parametrize("word, ingest, cv", [
    ("spam", 1, 1), (" Phishing ", 1, None), ("1", 1, 1), ("1.0", None, None), ("0", 0, 0), ("not spam", 0, None),
    ("not phishing", 1, None), ("invalid", 0, None), ("unsafe", 0, None), ("unknown", None, None), (None, None, None),
])
def test_label_words(one, word, ingest, cv):
    assert one(word, lb.ingest_label(V)) == ingest
    assert one(word, lb.cv_label(V)) == cv


def test_training_labels(spark):
    df = spark.createDataFrame([("malware", 3, True), ("what", -1, False), (None, None, None)], "w string, n int, b boolean")
    rows = df.select(*[lb.training_label(df, c).alias(c) for c in df.columns]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1), (0, 0, 0), (0, 0, 0)]


def test_cv_binary_paths(spark):
    words = spark.createDataFrame([("Spam",), ("ham",)], "label string")
    assert [r["y"] for r in lb.cv_binary(words, "label").collect()] == [1, 0]
    mixed = spark.createDataFrame([("1",), ("2.9",)], "label string")
    assert [r["y"] for r in lb.cv_binary(mixed, "label").collect()] == [1, 2]
    with pytest.raises(ValueError, match="odd"):
        lb.cv_binary(spark.createDataFrame([("1",), ("odd",)], "label string"), "label")
    with pytest.raises(ValueError):
        lb.pick_label_column(["a"])


def test_probability(one):
    assert one(100.0, pr.sigmoid(V), kind="double") == pytest.approx(1 / (1 + math.exp(-20)))
    assert one(0.0, pr.clip_probability(V), kind="double") == 1e-9
    assert one(0.8, pr.temperature_scale(V, 1.0), kind="double") == pytest.approx(0.8)
    assert [one(p, pr.verdict(V, 0.98, 0.05), kind="double") for p in (0.92, 0.95, 1.0)] == [0, -1, 1]
    assert [one(p, pr.risk_level(V), kind="double") for p in (0.95, 0.8, 0.6, 0.4, 0.1)] == [
        "CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE"]
    assert [one(p, pr.confidence_by_half(V), kind="double") for p in (0.95, 0.85, 0.75, 0.5)] == [
        "Very High", "High", "Medium", "Low"]


def test_group_key_and_preview(one):
    assert one("x", tx.group_key(F.lit("URL"), F.lit(None).cast("string"))) == "url:no-domain"
    assert one("a  B", tx.group_key(F.lit("Email"), F.lit(""), V)) == one("A b", tx.group_key(F.lit("email"), F.lit(None).cast("string"), V))
    assert one("abcdef", tx.preview(V, 3)) == "abc..." and one("abc", tx.preview(V, 3)) == "abc"
    assert one("a" * 300, tx.fingerprint(V, 256)) == one("a" * 256, tx.fingerprint(V)) != one("a" * 300, tx.fingerprint(V))


def test_entropy_measures_the_text_once(spark):
    # the length inside the lambda was found again for every distinct character
    df = spark.createDataFrame([("aab",)], "v string").repartition(1)
    plan = df.select(tx.entropy(F.col("v")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "length(v" in plan.split("aggregate(")[0] and "length(v" not in plan.split("aggregate(")[1]


def test_boundaries_before_word_characters(one):
    from baitlens.functions.regex import BOUNDARY, WORD
    assert BOUNDARY not in unicode_pattern(r"\b[13][a-z]+\b|\b0x").replace(f"[a-z]+{BOUNDARY}", "")
    for text in ("http://a", "xhttp://a", "_http://", "é http://", "éhttp://a", "ſhttp://a HTTP://", "", "-http://1http://"):
        slow = "(?iud)" + BOUNDARY + "https?://"
        assert one(text, F.regexp_count("v", F.lit(unicode_pattern(r"(?i)\bhttps?://")))) == one(text, F.regexp_count("v", F.lit(slow)))
    assert unicode_pattern(r"\b[A-Z]?x").count(WORD) == unicode_pattern(r"\bé").count(WORD)


def test_entropy_of_odd_texts(one):
    for text in ("", "a", "aab", "😀a\n\nb", "\x00\x00a"):
        counts = [text.count(c) / len(text) for c in sorted(set(text))] if text else []
        assert one(text, tx.entropy(F.col("v"))) == pytest.approx(-sum(p * math.log2(p) for p in counts), abs=1e-12)
