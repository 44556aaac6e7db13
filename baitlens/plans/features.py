"""Feature space of a training job: scaled numeric block, TF-IDF blocks, reduced dense block."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.specs import apply_specs
from ..operators.profile import column_quantiles
from ..operators.schema import numeric_columns
from ..operators.tfidf import fit_min_df, term_counts, vocabulary
from ..operators.vectors import drop_constant, fuse_blocks
from .config import TrainingConfig
from .stages import Grams


def fit_vectorizer(train: DataFrame, row_id: str, column: str, analyzer: str, low: int, high: int, output: str,
                   min_df: int | None = None, max_df: float = 0.9, max_features: int | None = None) -> PipelineModel:
    """Fitted TF-IDF vectorizer from JVM stages: n-grams, counts, idf factors, unit length.

    The vocabulary (at most ``max_features`` terms, where given) is the only thing that reaches the driver.
    """
    n_docs = train.count()
    terms = vocabulary(
        term_counts(train, row_id, column, analyzer, low, high, accents=True), n_docs,
        fit_min_df(n_docs) if min_df is None else min_df, max_df, max_features,
    ).orderBy("term").collect()
    if not terms:
        raise ValueError(f"empty vocabulary for {column!r} ({analyzer})")
    words, grams, counts, raw = [r["term"] for r in terms], f"_{output}_grams", f"_{output}_tf", f"_{output}_raw"
    return PipelineModel([
        Grams(inputCol=column, outputCol=grams, analyzer=analyzer, low=low, high=high),
        CountVectorizerModel.from_vocabulary(words, inputCol=grams, outputCol=counts),
        ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in terms]), inputCol=counts, outputCol=raw),
        Normalizer(p=2.0, inputCol=raw, outputCol=output),
    ])


def sparse_svd(df: DataFrame, column: str, k: int) -> np.ndarray:
    """Right singular vectors (terms x k) of a vector column."""
    rows = MLUtils.convertVectorColumnsFromML(df.select(column), column)
    return RowMatrix(rows).computeSVD(k, computeU=False).V.toArray()


def project_vectors(df: DataFrame, column: str, basis: np.ndarray, output: str) -> DataFrame:
    """Vector times a small matrix, in Arrow batches over the non-zero entries."""
    matrix = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(basis, dtype=np.float32))

    @F.pandas_udf("array<double>")
    def times(indices: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([
            np.asarray(v) @ (matrix.value if i is None else matrix.value[np.asarray(i, dtype=int)])
            if len(v) else np.zeros(matrix.value.shape[1]) for i, v in zip(indices, values)
        ])

    staged = df.withColumn("_e", F.unwrap_udt(column))  # a dense vector has no indices
    return staged.withColumn(output, times("_e.indices", "_e.values")).drop("_e")


@dataclass
class FeatureSpace:
    """Frozen after :meth:`fit`; :meth:`transform` gives ``features_lr`` and ``features_tree``."""

    config: TrainingConfig
    row_id: str = "row_id"
    text: str = "text"
    numeric: list[str] = field(default_factory=list)
    widths: dict[str, float] = field(default_factory=dict)
    vectorizers: list[Transformer] = field(default_factory=list)
    basis: np.ndarray | None = None
    selector: Transformer | None = None

    def _with_numeric(self, df: DataFrame) -> DataFrame:
        return apply_specs(df) if self.config.use_specs else df

    def fit(self, train: DataFrame, exclude: Sequence[str] = ("label",)) -> DataFrame:
        """Fit every block on the training rows and return them transformed."""
        staged = self._with_numeric(train)
        skip = {*exclude, self.row_id}
        self.numeric = [c for c in numeric_columns(staged) if c not in skip]
        quartiles = column_quantiles(staged, self.numeric, [0.25, 0.75], accuracy=10_000).collect()
        self.widths = {r["column"]: (r["q1"] - r["q0"]) or 1.0 for r in quartiles}
        if self.config.use_tfidf:
            half = self.config.tfidf_max_features // 2
            self.vectorizers = [
                fit_vectorizer(train, self.row_id, self.text, "char", *self.config.char_grams, "tfidf_char",
                               max_features=half),
                fit_vectorizer(train, self.row_id, self.text, "word", *self.config.word_grams, "tfidf_word",
                               max_features=half),
            ]
        blocks = self._blocks(staged)
        if self.config.use_tfidf and self.config.use_svd:
            size = len(blocks.select("tfidf").first()["tfidf"])
            self.basis = sparse_svd(blocks, "tfidf", min(self.config.svd_components, size - 1))
        views = self._views(blocks)
        self.selector, selected = drop_constant(views, "_tree", "features_tree")
        self._sanity(train)
        return selected.drop("_tree")

    def _sanity(self, train: DataFrame) -> None:
        """The transform of a few training rows must work right after the fit."""
        self.transform(train.orderBy(self.row_id).limit(32)).select("features_lr", "features_tree").collect()

    def _blocks(self, staged: DataFrame) -> DataFrame:
        scaled = staged.withColumns({
            f"_n_{c}": (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) / F.lit(self.widths.get(c, 1.0)))
            if c in staged.columns else F.lit(0.0) for c in self.numeric
        })
        out = VectorAssembler(inputCols=[f"_n_{c}" for c in self.numeric], outputCol="numeric").transform(scaled)
        out = out.drop(*[f"_n_{c}" for c in self.numeric])
        for v in self.vectorizers:
            out = v.transform(out)
        if self.vectorizers:
            out = VectorAssembler(inputCols=["tfidf_char", "tfidf_word"], outputCol="tfidf").transform(out)
            out = out.drop(*[c for c in out.columns if c.startswith("_tfidf_")], "tfidf_char", "tfidf_word")
        return out

    def _views(self, blocks: DataFrame) -> DataFrame:
        linear = ["numeric"] + (["tfidf"] if self.vectorizers else [])
        out = VectorAssembler(inputCols=linear, outputCol="features_lr").transform(blocks)
        tree = ["numeric"]
        if self.basis is not None:
            projected = project_vectors(out, "tfidf", self.basis, "_svd")
            return fuse_blocks(projected, ["numeric", "_svd"], "_tree").drop("_svd")
        return VectorAssembler(inputCols=tree, outputCol="_tree").transform(out)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.selector.transform(self._views(self._blocks(self._with_numeric(df)))).drop("_tree")
