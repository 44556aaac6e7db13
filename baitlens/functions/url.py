"""URL parsing and lexical URL features as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .regex import DIGIT, unicode_pattern
from .text import contained, count_char, count_matches, distinct_characters, entropy, flag, text

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _clean(url: Column) -> Column:
    """Leading control characters and blanks, and every tab or line break, are not part of a URL."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def with_url_parts(df: DataFrame, column: str = "url") -> DataFrame:
    """Add ``netloc host path query`` (lenient split: nothing fails, missing parts are empty)."""
    head = F.substring_index(F.substring_index("_clean", "#", 1), "?", 1)
    rest = F.col("_rest")
    has_authority = rest.startswith("//")
    authority = F.substring_index(F.substring(rest, F.lit(3), F.length(rest)), "/", 1)
    after_user = F.substring_index("netloc", "@", -1)
    unbracketed = F.substring_index(after_user, ":", 1)
    bracketed = F.regexp_extract(after_user, r"^\[([^\]]*)\]", 1)
    unbalanced = F.contains("netloc", F.lit("[")) != F.contains("netloc", F.lit("]"))

    def unless_broken(col: Column) -> Column:
        return F.when(unbalanced, F.lit("")).otherwise(col)

    split = (
        df.withColumn("_clean", _clean(text(column)))
        .withColumns({"_head": head, "_nofragment": F.substring_index("_clean", "#", 1)})
        .withColumn("_rest", F.regexp_replace("_head", _SCHEME, ""))
        .withColumn("netloc", F.when(has_authority, authority).otherwise(F.lit("")))
        .withColumns({
            "path": F.when(has_authority, F.substring(rest, F.length("netloc") + 3, F.length(rest))).otherwise(rest),
            "query": F.substring(F.col("_nofragment"), F.length("_head") + 2, F.length("_nofragment")),
        })
    )
    return split.withColumns({
        "host": unless_broken(F.lower(F.when(after_user.startswith("["), bracketed).otherwise(unbracketed))),
        "path": unless_broken(F.col("path")),
        "query": unless_broken(F.col("query")),
        "netloc": unless_broken(F.col("netloc")),
    }).drop("_clean", "_head", "_nofragment", "_rest")


def host_domain(url: Column) -> Column:
    """Host without port, a scheme being assumed where none is written; null where there is no host."""
    trimmed = F.trim(url)
    full = F.when(trimmed.rlike(unicode_pattern(r"^\w+://")), trimmed).otherwise(F.concat(F.lit("http://"), trimmed))
    netloc = F.regexp_extract(_clean(full), rf"{_SCHEME}//([^/?#]*)", 1)
    return F.when(F.length(trimmed) > 0, F.nullif(F.substring_index(netloc, ":", 1), F.lit("")))


def audit_domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?([^/]+)", 1)


def registered_domains(df: DataFrame, host: str, suffixes: DataFrame, output: str = "registered_domain") -> DataFrame:
    """Registered domain of a host: one label more than its longest listed suffix, else the host itself.

    ``suffixes`` has one column ``suffix``: plain suffixes, ``*.x`` (any one label before x) and exceptions ``!y.x`` (which win,
    and make x the suffix). Distinct hosts are matched by an equi-join of their tails with the rules, whatever the length of the
    list; a hot host is looked up once.
    """
    rule = F.lower("suffix")
    kind = F.when(rule.startswith("!"), "exception").when(rule.startswith("*."), "any").otherwise("plain")
    rules = suffixes.select(kind.alias("_kind"), F.regexp_replace(rule, r"^(?:!|\*\.)", "").alias("_suffix")).distinct()
    tails = F.transform(
        F.sequence(F.lit(1), F.size("_labels")),
        lambda i: F.struct(i.alias("start"), F.lower(F.array_join(F.slice("_labels", i, F.size("_labels")), ".")).alias("tail")),
    )
    hosts = df.select(F.col(host).alias("_host")).where(F.col("_host").isNotNull()).distinct().withColumn("_labels", F.split("_host", r"\."))
    found = hosts.select("_host", F.explode(tails).alias("_tail")).join(rules, F.col("_tail.tail") == F.col("_suffix"))
    at = F.col("_tail.start")
    start = F.when(F.col("_kind") == "plain", at).when((F.col("_kind") == "any") & (at > 1), at - 1)
    matched = found.groupBy("_host").agg(
        F.min(F.when(F.col("_kind") == "exception", at + 1)).alias("_exception"), F.min(start).alias("_start"))
    labels = F.split("_host", r"\.")
    first = F.coalesce("_exception", "_start")
    matched = matched.select("_host", F.when(first > 1, F.array_join(F.slice(labels, first - 1, F.size(labels)), ".")).alias("_found"))
    joined = df.join(matched, df[host] == matched["_host"], "left").drop("_host")
    return joined.withColumn(output, F.coalesce("_found", F.col(host))).drop("_found")


def domain_in_list(host: Column, domains: list[str], strict: bool = False) -> Column:
    """Host ends with a listed name; ``strict`` also asks for a label boundary."""
    lowered = F.lower(host)
    hits = [
        (lowered == d.lower()) | lowered.endswith("." + d.lower()) if strict else lowered.endswith(d.lower())
        for d in domains
    ]
    return reduce(or_, hits, F.lit(False))


def basic_url_features(df: DataFrame, column: str = "url") -> DataFrame:
    u = text(column)
    homographs = "[" + "".join(fv.HOMOGRAPH_CHARACTERS) + "]"
    return df.withColumns({
        "has_ip_in_url": flag(u.rlike(unicode_pattern(r"\d+\.\d+\.\d+\.\d+"))),
        "url_entropy": entropy(u),
        "has_homograph": flag(F.lower(u).rlike(homographs)),
        "has_url_shortener": flag(u.rlike("(?iu)" + fv.URL_SHORTENER_PATTERN)),
        "url_length": F.length(u),
        "num_dots": count_char(u, "."),
        "num_digits_in_url": count_matches(u, rf"[{DIGIT}]"),
    })


def _missing(df: DataFrame, columns: dict[str, Column]) -> dict[str, Column]:
    return {k: v for k, v in columns.items() if k not in df.columns}


def _ratio(count: Column, col: Column) -> Column:
    return F.coalesce(F.try_divide(count, F.length(col)), F.lit(0.0))


def advanced_url_features(df: DataFrame, column: str = "url") -> DataFrame:
    """Structure, character-class, token and anomaly features; existing basic columns are kept."""
    u, netloc = F.col("_u"), F.col("_parts.netloc")
    path, query = F.col("_parts.path"), F.col("_parts.query")
    row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
    parts = with_url_parts(df.select(row, text(column).alias("_u")), "_u").select(
        "_row.*", "_u", F.struct("netloc", "path", "query").alias("_parts"))
    dotted = F.contains(netloc, F.lit("."))
    tokens = F.filter(F.split(u, r"[/?&=.]"), lambda t: t != "")
    pairs = F.filter(F.split(query, "&"), lambda p: F.length(F.regexp_replace(p, r"^[^=]*=?", "")) > 0)
    raw_key = lambda p: F.substring_index(p, "=", 1)
    keys = F.array_distinct(F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(raw_key(p)), raw_key(p))))
    tld_pattern = "(" + "|".join(t.replace(".", r"\.") for t in fv.SUSPICIOUS_TLDS) + ")$"
    first = _missing(df, {
        "url_length": F.length(u),
        "num_dots": count_char(u, "."),
        "num_digits_in_url": count_matches(u, rf"[{DIGIT}]"),
        "url_entropy": entropy(u),
    }) | {
        "num_hyphens": count_char(u, "-"),
        "num_underscores": count_char(u, "_"),
        "num_slashes": count_char(u, "/"),
        "num_question_marks": count_char(u, "?"),
        "num_ampersands": count_char(u, "&"),
        "num_equals": count_char(u, "="),
        "num_at_symbols": count_char(u, "@"),
        "num_percent_signs": count_char(u, "%"),
        "domain_length": F.length(netloc),
        "subdomain_count": F.when(dotted, count_char(netloc, ".") - 1).otherwise(0),
        "tld_length": F.when(dotted, F.length(F.substring_index(netloc, ".", -1))).otherwise(0),
        "has_suspicious_tld": flag(F.lower(netloc).rlike("(?d)" + tld_pattern)),
        "path_length": F.length(path),
        "num_path_tokens": F.size(F.filter(F.split(path, "/"), lambda t: t != "")),
        "query_length": F.length(query),
        "num_query_params": F.size(keys),
        "uppercase_ratio": _ratio(count_matches(u, r"\p{Lu}"), u),
        "digit_ratio": _ratio(count_matches(u, rf"[{DIGIT}]"), u),
        "special_char_ratio": _ratio(count_matches(u, r"[^\p{L}\p{N}]"), u),
        "domain_entropy": entropy(netloc),
        "num_phishing_keywords": contained(F.lower(u), fv.PHISHING_KEYWORDS),
        "has_ip_address": flag(u.rlike(unicode_pattern(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"))),
        "char_variety": distinct_characters(u),
        "_token_lengths": F.transform(tokens, F.length),
    }
    sizes = F.col("_token_lengths")
    total = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    second = {
        "avg_token_length": F.coalesce(F.try_divide(total, F.size(sizes)), F.lit(0.0)),
        "max_token_length": F.coalesce(F.array_max(sizes), F.lit(0)),
        "anomaly_score": F.least(
            F.lit(1.0),
            F.when(F.length(u) > 100, 0.2).otherwise(0.0)
            + F.when(F.col("digit_ratio") > 0.3, 0.2).otherwise(0.0)
            + F.when(F.col("num_hyphens") + F.col("num_underscores") > 5, 0.2).otherwise(0.0)
            + F.when(F.col("has_suspicious_tld") == 1, 0.3).otherwise(0.0)
            + F.when(F.col("num_phishing_keywords") >= 2, 0.3).otherwise(0.0),
        ),
    }
    return parts.withColumns(first).withColumns(second).drop("_u", "_parts", "_token_lengths")


def sample_tool_features(df: DataFrame, url: str = "url", subject: str = "email_subject",
                         body: str = "email_body") -> DataFrame:
    """The small twelve-column feature set; ``has_ip`` means any digit in the host part."""
    u, s, b = text(url), text(subject), text(body)
    domain = F.substring_index(F.substring_index(u, "//", -1), "/", 1)
    ls, lb = F.lower(s), F.lower(b)
    hits = [(F.contains(ls, F.lit(w)) | F.contains(lb, F.lit(w))).cast("int") for w in fv.SUSPICIOUS_WORDS]
    return df.withColumns({
        "url_length": F.length(u),
        "num_dots": count_char(u, "."),
        "num_slashes": count_char(u, "/"),
        "num_digits": count_matches(u, rf"[{DIGIT}]"),
        "has_ip": flag(F.substring_index(domain, ":", 1).rlike(rf"[{DIGIT}]")),
        "has_https": flag(u.startswith("https")),
        "has_www": flag(F.contains(u, F.lit("www."))),
        "domain_length": F.length(domain),
        "domain_dots": count_char(domain, "."),
        "subject_length": F.length(s),
        "body_length": F.length(b),
        "num_suspicious_words": reduce(lambda x, y: x + y, hits),
    })
