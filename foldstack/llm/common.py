"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_uri

#: Stands for a missing id where the largest id of a group is wanted, so that it loses.
LOWEST = -(2**63)
#: Stands for a missing id where the smallest id of a group is wanted, so that it loses.
HIGHEST = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there and a lost executor costs no recomputation."""
    spark = frame.sparkSession
    uri = scratch_uri(spark, name)
    frame.write.parquet(uri)
    return spark.read.schema(frame.schema).parquet(uri)


def narrow(frame: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the operator's own names, whatever else the input carries."""
    return frame.select(*(F.col(f"`{c}`").alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()))


def whole(text: str) -> Column:
    """The text column, a missing text as the empty one."""
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def released(run: Callable) -> Callable:
    """``run`` over a partition's batches, handing unused memory back at its end: workers outlive their tasks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory without it
        if trim is not None:
            trim(0)

    return step


def arrow_map(frame: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``step`` to each Arrow batch of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            if out is not None:
                yield out

    return frame.mapInArrow(released(run), schema)


def sample_ids(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` values of ``id``, the first in order of a seeded hash; the same for any partitioning.

    A hash bound near the sample's share goes first, so what the tasks send for the final order stays small.
    """
    bound = (1 << 40) * min(1.0, 8 * n / max(ids.count(), 1))
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    some = ids.select("id", place.alias("place")).filter(F.col("place") < bound).filter("id is not null")
    return some.orderBy("place", "id").limit(n).select("id").distinct()


def null_as(column: str, stand_in: int) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(stand_in))


def as_null(column: str, stand_in: int) -> Column:
    return F.when(F.col(column) != stand_in, F.col(column))
