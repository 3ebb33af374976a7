"""Batch and streaming scoring with a fitted bundle, and input options for forms."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.convert import blank_to_null
from tabwright.operators.features import FeaturePrep, TargetLabels

SMALL_RANGE = 15
OPTION_BINS = 8


def input_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Choices per numeric column: each value of a small whole range, else eight equal ranges."""
    aggs, cells = [], []
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        whole = (high - low <= SMALL_RANGE) & (low == F.floor(low)) & (high == F.floor(high))
        values = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda v: v.cast("string"))
        step = (high - low) / OPTION_BINS

        ranges = F.transform(F.sequence(F.lit(0), F.lit(OPTION_BINS - 1)), _range_text(low, step))
        options = F.when(whole, values).when(high > low, ranges)
        cells.append(F.struct(F.lit(c).alias("column"), options.alias("options")))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def _range_text(low: Column, step: Column) -> Callable[[Column], Column]:
    def text(k: Column) -> Column:
        return F.format_string("%.1f-%.1f", low + k * step, low + (k + 1) * step)

    return text


def probability_columns(df: DataFrame, classes: int, probability: str = "probability") -> DataFrame:
    """``prob_class_i`` columns and ``confidence`` from a probability vector."""
    p = vector_to_array(F.col(probability))
    return df.select(
        "*", *[p[i].alias(f"prob_class_{i}") for i in range(classes)], F.array_max(p).alias("confidence")
    )


def blank_inputs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Empty form values count as missing."""
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[blank_to_null(F.col(c)).alias(c) if c in columns and c in texts else F.col(c) for c in df.columns])


@dataclass
class Bundle:
    """Feature preparation, fitted model and class labels: everything scoring needs.

    ``score`` is one lazy DataFrame step, so the same call serves a file, a table and, for Spark ML
    models, a stream.
    """

    prep: FeaturePrep
    model: Any
    problem: str
    labels: TargetLabels | None = None
    algorithm: str = ""

    def score(self, df: DataFrame) -> DataFrame:
        """Input columns plus ``prediction`` (decoded), ``prob_class_i`` and ``confidence`` where known."""
        inputs = df.select("*", *[F.col(c).alias(f"__in_{c}") for c in self.prep.inputs if c in df.columns])
        ready = assemble(self.prep.transform(_as_fitted(blank_inputs(inputs, self.prep.inputs), self.prep)), self.prep)
        out = self.model.transform(ready)
        has_probability = "probability" in out.columns
        if has_probability:
            out = probability_columns(out, len(self.labels.labels) if self.labels else 2)
        value = self.labels.decode(F.col("prediction")) if self.labels else F.col("prediction")
        shown = []
        for c in df.columns:
            shown.append(F.col(f"__in_{c}").alias(c) if c in self.prep.inputs else F.col(c))
        extra = [c for c in out.columns if c.startswith("prob_class_") or c == "confidence"]
        return out.select(*shown, value.alias("prediction"), *extra)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/prep")
        kind = f"{type(self.model).__module__}:{type(self.model).__name__}"
        if hasattr(self.model, "write"):
            self.model.write().overwrite().save(f"{path}/model")
        else:
            self.model.save(f"{path}/model")
        meta = {
            "kind": kind, "problem": self.problem, "algorithm": self.algorithm,
            "labels": list(self.labels.labels) if self.labels else None,
        }
        text = spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{path}/bundle")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        meta = json.loads(spark.read.text(f"{path}/bundle").first()[0])
        module, name = meta["kind"].split(":")
        if module not in (*_SPARK_ML, *_OWN):
            raise ValueError(f"not a known model: {meta['kind']}")
        cls = getattr(importlib.import_module(module), name)
        model = cls.load(spark, f"{path}/model") if module in _OWN else cls.load(f"{path}/model")
        labels = TargetLabels(tuple(meta["labels"])) if meta["labels"] is not None else None
        return Bundle(FeaturePrep.load(spark, f"{path}/prep"), model, meta["problem"], labels, meta["algorithm"])


_SPARK_ML = ("pyspark.ml.classification", "pyspark.ml.regression")
_OWN = ("tabwright.operators.ensembles", "tabwright.operators.boosting", "tabwright.operators.kernel")


def _as_fitted(df: DataFrame, prep: FeaturePrep) -> DataFrame:
    """Text that arrives for a numeric input becomes a number where it can."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.col(c).try_cast("double").alias(c) if c in prep.medians and kinds[c] == "string" else F.col(c) for c in df.columns]
    )


def assemble(df: DataFrame, prep: FeaturePrep) -> DataFrame:
    if not prep.feature_names:
        raise ValueError("no usable features")
    # names with dots or blanks are no problem for an array
    array = F.array(*[F.col(f"`{n}`") for n in prep.feature_names])
    return df.withColumn("features", array_to_vector(array))
