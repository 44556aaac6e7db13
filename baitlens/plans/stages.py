"""Pipeline stages: the column operators as Spark ML transformers and estimators."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.specs import apply_specs
from ..functions.text import text_signals
from ..functions.url import advanced_url_features, basic_url_features
from ..operators.profile import ColumnProfile, Profile, apply_profile, fit_profile
from ..operators.tfidf import char_grams, normal_text, word_grams


class UrlFeatures(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Basic and (optionally) advanced URL features of a column."""

    advanced = Param(Params._dummy(), "advanced", "add the advanced block", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol="url", advanced=True):
        super().__init__()
        self._setDefault(inputCol="url", advanced=True)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column = self.getInputCol()
        out = basic_url_features(dataset, column)
        return advanced_url_features(out, column) if self.getOrDefault(self.advanced) else out


class TextSignals(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Urgency, grammar, personalisation and length of a text column."""

    @keyword_only
    def __init__(self, inputCol="text"):
        super().__init__()
        self._setDefault(inputCol="text")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return text_signals(dataset, self.getInputCol())


class SpecFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Declarative features; ``specs`` is the JSON text of the specification list, empty for the bundled one."""

    specs = Param(Params._dummy(), "specs", "specification list as JSON", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "concat, replace or off", TypeConverters.toString)

    @keyword_only
    def __init__(self, specs="", mode="concat"):
        super().__init__()
        self._setDefault(specs="", mode="concat")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = self.getOrDefault(self.specs)
        return apply_specs(dataset, json.loads(raw) if raw else None, self.getOrDefault(self.mode))


class Grams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Character or word n-grams of a text column as an array."""

    analyzer = Param(Params._dummy(), "analyzer", "char or word", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "shortest n-gram", TypeConverters.toInt)
    high = Param(Params._dummy(), "high", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol="text", outputCol="grams", analyzer="char", low=3, high=5):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="grams", analyzer="char", low=3, high=5)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        grams = char_grams if self.getOrDefault(self.analyzer) == "char" else word_grams
        source = normal_text(F.coalesce(F.col(self.getInputCol()), F.lit("")), accents=True)
        staged = dataset.withColumn("_normal", source)
        return staged.withColumn(
            self.getOutputCol(), grams(F.col("_normal"), self.getOrDefault(self.low), self.getOrDefault(self.high))
        ).drop("_normal")


class CleaningModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted cleaning profile; replaces the profiled columns by their cleaned values."""

    profile = Param(Params._dummy(), "profile", "profile as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, profile="{}"):
        super().__init__()
        self._setDefault(profile="{}")
        self._set(**self._input_kwargs)

    def fitted(self) -> Profile:
        raw = json.loads(self.getOrDefault(self.profile))
        return Profile(raw["order"], raw["removed"], {c: ColumnProfile(**p) for c, p in raw["columns"].items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.fitted()
        gone = set(p.order) | set(p.removed)
        return apply_profile(dataset, p, [c for c in dataset.columns if c not in gone])


class Cleaning(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the cleaning profile of some numeric columns."""

    columns = Param(Params._dummy(), "columns", "columns to clean", TypeConverters.toListString)

    @keyword_only
    def __init__(self, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CleaningModel:
        p = fit_profile(dataset, self.getOrDefault(self.columns))
        state = {"order": p.order, "removed": p.removed, "columns": {c: vars(v) for c, v in p.columns.items()}}
        return CleaningModel(profile=json.dumps(state))
