"""Pipeline stages built from column expressions.

Each stage only adds a projection, so a fitted pipeline stays on the JVM and without a shuffle,
and saves with the standard ML writers.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstack.functions import sequence
from foldstack.functions.arrays import argmax

FLAT, MIXED, CONVOLVED = "flat", "mixed", "convolved"


def view(features: Column, kind: str) -> Column:
    """The numeric view of a window a model learns from."""
    if kind == FLAT:
        return features
    steps = sequence.to_steps(features)
    if kind == MIXED:
        return sequence.pool_last(sequence.time_mix(sequence.instance_norm(steps), 0.5))
    if kind == CONVOLVED:
        return sequence.pooled_conv(steps)
    raise ValueError(f"unknown view {kind!r}")


class WindowVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Array column to the ML vector of the chosen view."""

    inputCol = Param(Params._dummy(), "inputCol", "array column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "view of the window", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "values of a window", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="_vector", kind=FLAT, size=0):
        super().__init__()
        self._setDefault(size=0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw, size = F.col(self.getOrDefault(self.inputCol)), self.getOrDefault(self.size)
        if size:
            name = F.col("window_id").cast("string") if "window_id" in dataset.columns else F.lit("without id")
            told = F.concat(
                F.lit("window "),
                F.coalesce(name, F.lit("null")),
                F.lit(f": {size} values expected, found "),
                F.coalesce(F.size(raw).cast("string"), F.lit("none")),
            )
            wrong = F.raise_error(told).cast("array<double>")
            raw = F.when(F.coalesce(F.size(raw) == size, F.lit(False)), raw.cast("array<double>")).otherwise(wrong)
        values = view(raw, self.getOrDefault(self.kind))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(values))


class ClassOutput(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``proba`` array in class order and decoded ``prediction``; scratch columns go."""

    labels = Param(Params._dummy(), "labels", "sorted labels", TypeConverters.toListString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "vector", TypeConverters.toString)
    dropCols = Param(Params._dummy(), "dropCols", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labels=(), probabilityCol="_probability", dropCols=()):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source = self.getOrDefault(self.probabilityCol)
        proba = F.col(source)
        if dataset.schema[source].dataType.typeName() != "array":
            proba = vector_to_array(proba)
        names = F.array(*[F.lit(x) for x in self.getOrDefault(self.labels)])
        return (
            dataset.withColumn("proba", proba)
            .withColumn("prediction", F.get(names, argmax(F.col("proba"))))
            .drop(*self.getOrDefault(self.dropCols))
        )
