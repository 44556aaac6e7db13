"""Registry of named queries with their SQL counterparts, and the shared stand-in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType

from ..session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers and flags as bigint, numbers rounded, everything else as it is."""
    def out(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (IntegralType, BooleanType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)):
            return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        return c

    return df.select(*[out(f) for f in df.schema.fields])


def outputs(spec: str, digits: int = 6) -> str:
    """SQL select list from ``name:kind`` words: i bigint, d rounded double, s as it is."""
    parts = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        if kind == "i":
            parts.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            parts.append(f"round(CAST({name} AS DOUBLE), {digits}) + 0.0 AS {name}")
        else:
            parts.append(f"{name} AS {name}")
    return ", ".join(parts)


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_rows(rows: list[tuple]) -> str:
    def cell(v) -> str:
        return sql_text(v) if v is None or isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


# --- stand-in scores: three models over the labelled documents -----------------------------------------

MODELS = [("m1", 400, 104729, 601), ("m2", 250, 611953, 751), ("m3", 100, 1299709, 901)]


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = read_table(spark, sf, "labels")
    return labels.join(docs, "doc_id").withColumnRenamed("quality", "label")


def model_score(a: int, b: int, c: int) -> Column:
    mixed = F.lit(a) * F.col("label") + F.pmod(F.col("n_chars") * 7919 + F.col("doc_id") * F.lit(b), F.lit(c))
    return mixed.cast("double") / 1000.0


def scored_models(spark: SparkSession, sf: str) -> DataFrame:
    """``model doc_id source lang label score``: a deterministic score per labelled document and model."""
    variants = F.array(*[
        F.struct(F.lit(m).alias("model"), model_score(a, b, c).alias("score")) for m, a, b, c in MODELS
    ])
    docs = labelled_documents(spark, sf)
    return docs.select("doc_id", "source", "lang", "label", F.explode(variants).alias("_v")).select(
        "_v.model", "doc_id", "source", "lang", "label", "_v.score")


def scored(spark: SparkSession, sf: str, model: str = "m1") -> DataFrame:
    _, a, b, c = next(m for m in MODELS if m[0] == model)
    return labelled_documents(spark, sf).withColumn("score", model_score(a, b, c))


SCORED_MODELS_SQL = f"""
scored AS (
  SELECT m.model, l.doc_id, d.source, d.lang, l.quality AS label,
         CAST(m.a * l.quality + ((d.n_chars * 7919 + l.doc_id * m.b) % m.c) AS DOUBLE) / 1000 AS score
  FROM labels l JOIN documents d USING (doc_id)
  CROSS JOIN (VALUES {sql_rows(MODELS)}) AS m(model, a, b, c))"""

SCORED_SQL = SCORED_MODELS_SQL.replace("scored AS", "scored_all AS") + """,
scored AS (SELECT * FROM scored_all WHERE model = 'm1')"""

COUNTS_SQL = """
counts AS (
  SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM scored GROUP BY model, score)"""

CURVE_SQL = COUNTS_SQL + """,
running AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg,
         lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS rn
  FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
curve AS (
  SELECT model, score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
         CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg,
         rn = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg AS corner,
         CASE WHEN n_neg > 0 THEN CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) ELSE 0 END AS fpr,
         CASE WHEN n_pos > 0 THEN CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) ELSE 0 END AS tpr
  FROM running)"""

# --- stand-in splits -----------------------------------------------------------------------------------

HASH_MULTIPLIER = 2654435761


def split_column(key: str) -> Column:
    bucket = F.pmod(F.col(key) * F.lit(HASH_MULTIPLIER), F.lit(100))
    return F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test")


def split_sql(key: str) -> str:
    bucket = f"(({key} * {HASH_MULTIPLIER}) % 100)"
    return f"CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 85 THEN 'val' ELSE 'test' END"


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
