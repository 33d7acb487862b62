"""Synthetic windows whose values depend only on the seed and the id, not on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of the default table and its alternating labels.
N_SAMPLES = 1000
N_FEATURES = 10
LABELS = ("class_A", "class_B")


def _uniform(seed: int, row: Column, part: Column, draw: int) -> Column:
    """A value in (0, 1) from 48 hash bits."""
    text = F.concat_ws(":", F.lit(str(seed)), row.cast("string"), part.cast("string"), F.lit(str(draw)))
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(2**48)


def normals(seed: int, row: Column, n: int) -> Column:
    """``n`` standard normal values for a row, by the Box-Muller transform."""

    def draw(part: Column) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(_uniform(seed, row, part, 0)))
        return radius * F.cos(F.lit(2.0 * math.pi) * _uniform(seed, row, part, 1))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)


def windows_for(
    ids: DataFrame, row: str, seed: int, n_features: int = N_FEATURES, labels: tuple[str, ...] = LABELS
) -> DataFrame:
    """One window per numbered row; labels alternate with the number."""
    label = F.element_at(
        F.array(*[F.lit(x) for x in labels]), (F.col(row) % len(labels)).cast("int") + 1
    )
    return ids.select(
        F.col(row).cast("string").alias("window_id"),
        label.alias("label"),
        normals(seed, F.col(row), n_features).alias("features"),
    )


def synthetic_windows(spark: SparkSession, n: int = N_SAMPLES, seed: int = 1337, **kwargs) -> DataFrame:
    return windows_for(spark.range(n), "id", seed, **kwargs)
