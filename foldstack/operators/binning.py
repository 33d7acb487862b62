"""Features cut into bins once, for every fold, round and class that learns from them.

Bin edges are quantiles from Spark's mergeable sketch, one per feature, combined map-side; a window becomes one byte
a feature. A value belongs to the first bin whose edge is not below it, so a split at bin ``b`` is the rule
``value <= edges[b]`` and models keep no bins but edges.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256
#: The sketch's rank error is at most one in so many rows.
ACCURACY = 20_000


def bin_edges(rows: DataFrame, column: str = "features", bins: int = BINS, accuracy: int = ACCURACY) -> list[np.ndarray]:
    """Rising edges of each feature, ``bins - 1`` at most: one sketch per feature, whatever the number of rows."""
    if not 2 <= bins <= BINS:
        raise ValueError(f"bins must be between 2 and {BINS}")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cells = rows.select(F.posexplode(F.col(column).cast("array<double>")).alias("feature", "value"))
    found = cells.groupBy("feature").agg(F.percentile_approx("value", shares, F.lit(accuracy)).alias("edges"))
    edges = {r["feature"]: np.unique(np.array(r["edges"], np.float64)) for r in found.collect()}  # bins - 1 per feature
    return [edges[i] for i in range(len(edges))]


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a matrix with one row per window."""
    out = np.empty(values.shape, np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.searchsorted(e, values[:, i], side="left")
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), width)


def blocks(rows: DataFrame, edges: list[np.ndarray], column: str, partitions: int) -> RDD:
    """``{bins, y, fold, key}`` of each of so many parts of ``rows (window_id, y, fold, <column>)``.

    ``key`` hashes the id: what is drawn at random for a row depends on it alone, never on the row's place.
    """

    def run(batches):
        parts = []
        for batch in batches:
            names = {n: batch.column(n) for n in batch.schema.names}
            parts.append(
                (
                    to_bins(matrix(names["x"], len(edges)), edges),
                    names["y"].to_numpy().astype(np.int32),
                    names["fold"].to_numpy().astype(np.int32),
                    names["key"].to_numpy().view(np.uint64),
                )
            )
        if parts:
            made = dict(zip(("bins", "y", "fold", "key"), map(np.concatenate, zip(*parts))))
            yield pa.record_batch([pa.array([pickle.dumps(made)], pa.binary())], names=["block"])

    narrow = rows.select(
        F.col(column).cast("array<double>").alias("x"), F.col("y").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"),
        F.xxhash64("window_id").alias("key"),
    )
    return narrow.repartition(partitions, "key").mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


def keyed(seed: int, *numbers: int) -> np.uint64:
    """A number that stands for all of these."""
    value = np.array([seed], np.int64).view(np.uint64)
    for number in numbers:
        value = mixed(value + np.uint64(number + 1))
    return value[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers from any."""
    values = values + np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shares(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A number in [0, 1) for each key under a salt."""
    return (mixed(keys ^ salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
