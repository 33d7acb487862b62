"""Aligning out-of-fold probabilities by key and checking their coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstack.functions.arrays import is_zero_row


def stack_matrix(oof: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(window_id, stack)``: the models' probabilities side by side, in the given order.

    One shuffle by ``window_id`` for any number of models. Buffers hold one array per model, so
    repeated rows for a key cannot grow a group.
    """
    models = list(models)
    grouped = (
        oof.where(F.col("model").isin(models))
        .groupBy("window_id")
        .agg(
            *[
                F.first(F.when(F.col("model") == m, F.col("proba")), ignorenulls=True).alias(f"_p{i}")
                for i, m in enumerate(models)
            ],
            F.count(F.lit(1)).alias("_rows"),
            F.min(F.size("proba")).alias("_narrow"),
            F.max(F.size("proba")).alias("_wide"),
        )
    )
    parts = [F.col(f"_p{i}") for i in range(len(models))]
    stack = F.concat(*parts)
    sound = (
        (F.col("_rows") == len(models))
        & stack.isNotNull()
        & (F.col("_narrow") == F.col("_wide"))
    )
    problem = F.raise_error(
        F.concat(
            F.lit(f"window without exactly one aligned row for each of {len(models)} models: "),
            F.coalesce("window_id", F.lit("null")),
        )
    )
    return grouped.select(
        "window_id",
        F.when(sound, stack).otherwise(problem.cast("array<double>")).alias("stack"),
    )


def with_labels(
    stack: DataFrame, windows: DataFrame, columns: Sequence[str] = ("label",)
) -> DataFrame:
    """Add the label (and fold, when asked) by id, reading only the columns needed."""
    return stack.join(windows.select("window_id", *columns), "window_id")


def labelled_stack(
    oof: DataFrame, folds: DataFrame, models: Sequence[str], partitions: int
) -> DataFrame:
    """``(window_id, label, fold, stack)`` for training a stacker, from one shuffle of everything.

    Split and probabilities are dealt by id into ``partitions`` together and each window is put
    together where it lies, so a training layout in as many partitions needs no shuffle of its own.
    A window of the split without exactly one row per model, or a row of an unknown window, raises.
    """
    models = list(models)
    rows = oof.where(F.col("model").isin(models)).select("window_id", "model", "proba")
    both = rows.unionByName(folds.select("window_id", "label", "fold"), allowMissingColumns=True)
    grouped = (
        both.repartition(partitions, "window_id")
        .groupBy("window_id")
        .agg(
            F.first("label", ignorenulls=True).alias("label"),
            F.first("fold", ignorenulls=True).alias("fold"),
            F.count("fold").alias("_known"),
            F.count("model").alias("_rows"),
            F.min(F.size("proba")).alias("_narrow"),
            F.max(F.size("proba")).alias("_wide"),
            *[
                F.first(F.when(F.col("model") == m, F.col("proba")), ignorenulls=True).alias(f"_p{i}")
                for i, m in enumerate(models)
            ],
        )
    )
    stack = F.concat(*[F.col(f"_p{i}") for i in range(len(models))])
    fault = (
        F.when(F.col("_known") == 0, "out-of-fold row of an unknown window: ")
        .when(F.col("_known") > 1, "window twice in the split: ")
        .when(
            (F.col("_rows") != len(models)) | stack.isNull() | (F.col("_narrow") != F.col("_wide")),
            f"window without exactly one aligned row for each of {len(models)} models: ",
        )
    )
    stop = F.raise_error(F.concat(fault, F.coalesce("window_id", F.lit("null")))).cast("array<double>")
    return grouped.select("window_id", "label", "fold", F.when(fault.isNull(), stack).otherwise(stop).alias("stack"))


def zero_rows(oof: DataFrame) -> DataFrame:
    """Per model: rows and how many of them were never filled."""
    return oof.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(is_zero_row(F.col("proba"))).alias("zero_rows")
    )


def missing_rows(folds: DataFrame, oof: DataFrame) -> DataFrame:
    """Windows of the split that have no out-of-fold row."""
    return folds.join(oof.select("window_id"), "window_id", "left_anti")


COVERAGE = ("n_rows", "zero_rows", "missing_rows", "extra_rows", "duplicate_rows")
#: What makes a stored table unfit for stacking.
GAPS = COVERAGE[1:]


def coverage(folds: DataFrame, oof: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per model: rows written, rows never filled, windows without a row, rows of unknown
    windows, rows beyond the first of a window.

    All models are counted in one pass: probabilities shrink to a flag before the only wide
    shuffle, and a window is one row of counts after it.
    """
    models = list(models)
    flags = oof.where(F.col("model").isin(models)).select(
        "window_id", "model", is_zero_row(F.col("proba")).alias("_zero")
    )
    counts = flags.groupBy("window_id").agg(
        *[F.count_if(F.col("model") == m).alias(f"_n{i}") for i, m in enumerate(models)],
        *[F.count_if((F.col("model") == m) & F.col("_zero")).alias(f"_z{i}") for i, m in enumerate(models)],
    )
    known = folds.select("window_id").distinct().withColumn("_known", F.lit(True))
    pairs = known.join(counts, "window_id", "full")
    inside, zero = F.coalesce("_known", F.lit(False)), F.lit(0).cast("long")

    def tallies(i: int) -> list[Column]:
        n = F.coalesce(f"_n{i}", zero)
        found = (
            n,
            F.coalesce(f"_z{i}", zero),
            F.when(inside & (n == 0), 1).otherwise(0).cast("long"),
            F.when(inside, zero).otherwise(n),
            F.greatest(n - 1, zero),
        )
        return [F.coalesce(F.sum(value), zero).alias(f"{name}{i}") for name, value in zip(COVERAGE, found)]

    totals = pairs.agg(*[tally for i in range(len(models)) for tally in tallies(i)])
    rows = [
        F.struct(F.lit(m).alias("model"), *[F.col(f"{name}{i}").alias(name) for name in COVERAGE])
        for i, m in enumerate(models)
    ]
    return totals.select(F.inline(F.array(*rows)))
