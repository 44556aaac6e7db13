"""Declarative features: specification rows become column expressions evaluated in one projection."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from . import text as tx
from .regex import unicode_pattern
from .url import domain_in_list, with_url_parts

SPEC_FILES = ["url_features.json", "email_features.json", "common_features.json"]
BUNDLED = {"url": fv.URL_SPECS, "email": fv.EMAIL_SPECS, "common": fv.COMMON_SPECS}

# which columns may feed a source, first non-empty one wins
SOURCES = {
    "url": ["url"], "host": ["host"], "path": ["path"], "query": ["query"], "domain": ["domain"],
    "email_subject": ["email_subject", "subject"],
    "email_body": ["email_body", "body", "text"],
}


def load_specs(folder: str | None = None) -> list[dict]:
    """Specifications of a folder of JSON files (a missing file adds none), or the bundled ones."""
    if folder is None:
        return [spec for group in BUNDLED.values() for spec in group]
    found: list[dict] = []
    for name in SPEC_FILES:
        path = Path(folder) / name
        if path.exists():
            found += json.loads(path.read_text(encoding="utf-8"))["features"]
    return found


def parsed_columns(df: DataFrame) -> DataFrame:
    """Add ``host path query`` unless all three exist; ``domain`` defaults to the host."""
    if {"host", "path", "query"} <= set(df.columns):
        return df
    kept = df.drop("host", "path", "query")
    source = kept if "url" in kept.columns else kept.withColumn("url", F.lit(""))
    had_netloc = "netloc" in df.columns
    out = with_url_parts(source.withColumnRenamed("netloc", "_given_netloc") if had_netloc else source, "url")
    out = out.drop("netloc")
    if had_netloc:
        out = out.withColumnRenamed("_given_netloc", "netloc")
    if "url" not in df.columns:
        out = out.drop("url")
    return out if "domain" in df.columns else out.withColumn("domain", F.coalesce("host", F.lit("")))


def source_text(columns: list[str], source: str) -> Column:
    """First non-empty alias of a source; ``text_joined`` is subject, body and url with blanks between."""
    if source == "text_joined":
        parts = [source_text(columns, s) for s in ("email_subject", "email_body", "url")]
        joined = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])
        return F.regexp_replace(joined, rf"^[{tx.SPACE}]+|[{tx.SPACE}]+\z", "")
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in SOURCES.get(source, []) if c in columns]
    return F.coalesce(*present, F.lit(""))


def spec_column(spec: dict, source: Column, columns: list[str], host: Column) -> Column:
    """The double-valued expression of one specification; an unknown type gives 0."""
    kind = spec["type"]
    if kind == "len":
        value = F.length(source)
    elif kind == "word_count":
        value = tx.word_count(source)
    elif kind == "entropy":
        value = tx.entropy(source, epsilon=1e-12)
    elif kind == "regex_count":
        value = tx.count_matches(source, unicode_pattern(spec["pattern"]))
    elif kind == "regex_bool":
        value = tx.flag(source.rlike(unicode_pattern(spec["pattern"])))
    elif kind == "char_ratio":
        value = tx.charset_ratio(source, spec.get("charset", "latin"))
    elif kind == "unique_chars":
        value = tx.distinct_characters(source)
    elif kind == "max_run_len":
        value = tx.longest_run(source)
    elif kind == "subdomain_count":
        value = tx.count_char(host, ".")
    elif kind == "tld_len":
        value = F.length(F.substring_index(host, ".", -1))
    elif kind == "domain_in_list":
        value = tx.flag(domain_in_list(host, spec.get("list", []), spec.get("strict", False)))
    elif kind == "lookup_bool" and spec.get("lookup") in columns:
        value = tx.flag(F.col(spec["lookup"]).cast("boolean"))
    else:
        value = F.lit(0.0)
    return value.cast("double")


def compile_specs(specs: list[dict], columns: list[str]) -> dict[str, Column]:
    """Feature name to expression, reading the source columns prepared by :func:`apply_specs`."""
    host = F.col("_src.host")
    return {
        s["name"]: spec_column(s, F.col(f"_src.{s.get('source', 'text_joined')}"), columns, host) for s in specs
    }


def apply_specs(df: DataFrame, specs: list[dict] | None = None, mode: str = "concat",
                keep: list[str] | None = None) -> DataFrame:
    """Append the features (``concat``), return only them plus ``keep`` (``replace``), or nothing (``off``)."""
    if mode == "off":
        return df
    specs = load_specs() if specs is None else specs
    parsed = parsed_columns(df)
    columns = parsed.columns
    wanted = sorted({s.get("source", "text_joined") for s in specs} | {"host"})
    sources = F.struct(*[source_text(columns, s).alias(s) for s in wanted])
    features = compile_specs(specs, columns)
    staged = parsed.withColumn("_src", sources)
    if mode == "replace":
        return staged.select(*(keep or []), *[c.alias(n) for n, c in features.items()])
    if mode != "concat":
        raise ValueError(f"unknown mode {mode!r}")
    return staged.withColumns({n: c for n, c in features.items() if n not in columns}).drop("_src")


def attach_reputation(df: DataFrame, lists: dict[str, DataFrame], column: str = "domain") -> DataFrame:
    """Boolean column per reputation list (one-column frames of domains); AQE picks the join by real size."""
    out = df
    for flag_name, listed in lists.items():
        names = listed.select(F.col(listed.columns[0]).alias("_listed")).distinct()
        out = (
            out.join(names, out[column] == names["_listed"], "left")
            .withColumn(flag_name, F.col("_listed").isNotNull())
            .drop("_listed")
        )
    return out
