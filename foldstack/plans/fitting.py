"""Fitting one model per fold on a shared, laid-out training frame."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import TypeVar

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstack.operators.binning import bin_edges
from foldstack.operators.classes import MAX_CLASSES, index_labels
from foldstack.operators.splits import SEED, fit_sample, training, validation
from foldstack.plans.models import FORESTS, LONG_TASKS, FitContext, get_model, settings_for
from foldstack.sources.scratch import checkpoint_dir


# The layout depends only on the table, never on the cluster: small partitions that keep many
# cores busy, growing once their number would burden the shuffle.
MIN_PARTITIONS = 2
MANY_PARTITIONS = 16_384
SMALL_PARTITION = 16 * 1024**2
LARGE_PARTITION = 1024**3
# Fits run side by side only while the whole table is small; a large fit fills the cluster alone,
# and every learner keeps its own copy of its rows.
SIDE_BY_SIDE_BYTES = 1024**3

Result = TypeVar("Result")


@dataclass(frozen=True)
class TrainingFrame:
    """Rows ``(window_id, label, fold, y, <input>)`` plus the counts the models need.

    ``rows`` are learned from, ``every`` is scored; they differ only where ``fit_rows`` bounds the
    sample. ``counts[fold][code]`` is the number of rows; it holds one number per fold and class.
    """

    rows: DataFrame
    every: DataFrame
    labels: list[str]
    counts: dict[int, dict[int, int]]
    n_features: int
    input_col: str
    _edges: dict[int, list[np.ndarray]] = field(default_factory=dict)
    _finding: Lock = field(default_factory=Lock)

    def edges(self, bins: int) -> list[np.ndarray]:
        """Bin edges of the features, found once for all models, folds and rounds."""
        with self._finding:
            if bins not in self._edges:
                self._edges[bins] = bin_edges(self.rows, self.input_col, bins)
            return self._edges[bins]

    def class_sizes(self, without: int | None = None) -> dict[int, int]:
        sizes: dict[int, int] = {}
        for fold, per_class in self.counts.items():
            if fold != without:
                for code, n in per_class.items():
                    sizes[code] = sizes.get(code, 0) + n
        return sizes

    def parallelism(self, asked: int | None) -> int:
        if asked is not None:
            return max(1, asked)
        n_bytes = sum(self.class_sizes().values()) * self.n_features * 8
        return 4 if n_bytes <= SIDE_BY_SIDE_BYTES else 1


def _fold_counts(df: DataFrame) -> tuple[list[str], dict[int, dict[int, int]]]:
    """Sorted labels and rows per fold and class code, from a scan of the narrow columns."""
    per_fold = df.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))
    folds = per_fold.groupBy("label").agg(
        F.collect_list(F.struct("fold", "n")).alias("folds")
    )
    rows = folds.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} distinct labels: not a class column")
    if not rows:
        raise ValueError("no training rows")
    labels = sorted(r["label"] for r in rows)
    code = {label: i for i, label in enumerate(labels)}
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        for part in r["folds"]:
            counts.setdefault(part["fold"], {})[code[r["label"]]] = part["n"]
    return labels, counts


def layout_partitions(n_bytes: int) -> int:
    small = math.ceil(n_bytes / SMALL_PARTITION)
    large = math.ceil(n_bytes / LARGE_PARTITION)
    return max(MIN_PARTITIONS, min(small, max(MANY_PARTITIONS, large)))


@contextmanager
def training_frame(
    df: DataFrame,
    input_col: str = "features",
    partitions: int | None = None,
    folds: DataFrame | None = None,
    width: int | None = None,
    fit_rows: int | None = None,
) -> Iterator[TrainingFrame]:
    """Lay the rows out once for all fits and release them afterwards.

    Rows are hashed by id into a number of partitions that depends on the table alone and sorted
    inside them, so sums of floating-point losses meet in the same order on any cluster. That one
    shuffle serves all k fits, each of which passes over the rows many times. The layout is kept in
    memory and on disk; lost blocks are rebuilt from the input.

    Rows per fold and the input width are looked up first. Callers whose ``df`` is costly to
    compute pass a ``folds`` table with the same rows and the expected ``width`` instead; a row
    of another width, or without input, raises.

    ``fit_rows`` bounds the rows learned from: of a larger table only about so many are laid out, an
    exact stratified sample in which each class and fold keeps its share and none is lost (see
    :func:`foldstack.operators.splits.fit_sample`). Trees cost a pass over the layout per level and
    round, and forests of unlimited depth grow with its rows, so very large tables should set it.
    Everything is scored all the same, from the input and without a shuffle.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    labels, counts = _fold_counts(df if folds is None else folds)
    n_rows = sum(n for per_class in counts.values() for n in per_class.values())
    sampled = None
    if fit_rows is not None and n_rows > fit_rows:
        sampled = fit_sample(df if folds is None else folds, fit_rows)
        code = {label: i for i, label in enumerate(labels)}
        counts = {}
        for (fold, label), n in sampled.quotas.items():
            counts.setdefault(fold, {})[code[label]] = n
        n_rows = sum(sampled.quotas.values())
    values = F.col(input_col).cast("array<double>")
    if width is None:
        width = df.select(F.size(values).alias("n")).first()["n"]
    if partitions is None:
        partitions = layout_partitions(n_rows * width * 8)
    ragged = F.raise_error(F.concat(F.lit("missing or ragged features in window "), F.col("window_id")))
    even = F.when(F.size(values) == width, values).otherwise(ragged.cast("array<double>"))
    every = index_labels(df.select("window_id", "label", "fold", even.alias(input_col)), labels)
    laid_out = (
        (every if sampled is None else sampled.take(every))
        .repartition(partitions, "window_id")
        .sortWithinPartitions("window_id")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        yield TrainingFrame(laid_out, laid_out if sampled is None else every, labels, counts, width, input_col)
    finally:
        laid_out.unpersist()


def fit_folds(
    frame: TrainingFrame,
    name: str,
    folds: Sequence[int | None],
    seed: int = SEED,
    size: str = "full",
    parallelism: int | None = None,
    **overrides,
) -> list[PipelineModel]:
    """One model per entry of ``folds``, fitted on every row outside that fold, or on all rows for None.

    Learners that can (``fit_many``) fit all of them in the same passes over features binned once; the others are
    fitted one by one, small ones side by side.
    """

    def built(without: int | None) -> Pipeline:
        sizes = frame.class_sizes(without)
        context = FitContext(
            labels=frame.labels,
            n_rows=sum(sizes.values()),
            n_features=frame.n_features,
            seed=seed,
            input_col=frame.input_col,
            settings=settings_for(name, size, **overrides),
        )
        return get_model(name, context)

    def fit(without: int | None) -> PipelineModel:
        return built(without).fit(frame.rows if without is None else training(frame.rows, without))

    vector, learner, output = built(None).getStages()
    if hasattr(learner, "fit_many"):
        n_rows = sum(frame.class_sizes().values())
        found = learner.fit_many(frame.rows, frame.input_col, folds, n_rows, frame.edges(learner.bins))
        return [PipelineModel([vector, model, output]) for model in found]
    threads = min(frame.parallelism(parallelism), len(folds))
    if threads > 1:
        frame.rows.count()  # fill the cache once, before the fits race for it
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(frame.rows.sparkSession)(fit), folds)


def each_model(frame: TrainingFrame, names: Sequence[str], run: Callable[[str], Result]) -> list[Result]:
    """``run(name)`` for each model, in the order of ``names``.

    On a small table boosting is a task a fold that runs for all rounds, so it goes beside the other models and does
    not leave the rest of the cluster idle. Of these, forests come last: their many tasks would keep the short jobs of
    the others waiting.
    """
    lanes = [[n for n in names if n in LONG_TASKS], sorted((n for n in names if n not in LONG_TASKS), key=FORESTS.__contains__)]
    if not all(lanes) or frame.parallelism(None) == 1:
        return [run(n) for n in names]
    frame.rows.count()  # fill the cache once, before the models race for it
    with ThreadPool(len(lanes)) as pool:
        target = inheritable_thread_target(frame.rows.sparkSession)(lambda lane: [(n, run(n)) for n in lane])
        found = dict(x for lane in pool.map(target, lanes, chunksize=1) for x in lane)
    return [found[n] for n in names]


def fit_model(
    frame: TrainingFrame,
    name: str,
    seed: int = SEED,
    without: int | None = None,
    size: str = "full",
    parallelism: int | None = None,
    **overrides,
) -> PipelineModel:
    """Fit on every row outside fold ``without``, or on all rows."""
    return fit_folds(frame, name, [without], seed, size, parallelism, **overrides)[0]


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Held-out rows in the shape the metrics read."""
    return model.transform(rows).select(
        "window_id",
        F.col("fold").cast("int").alias("fold"),
        F.col("label").alias("actual"),
        F.col("prediction").alias("predicted"),
        "y",
        "proba",
    )


def cross_validate(
    frame: TrainingFrame, name: str, seed: int = SEED, size: str = "full", parallelism: int | None = None, **overrides
) -> DataFrame:
    """Score each fold with a model that never saw it."""
    folds = sorted(frame.counts)
    models = fit_folds(frame, name, folds, seed, size, parallelism, **overrides)
    scored = [score(m, validation(frame.every, f)) for f, m in zip(folds, models)]
    return reduce(DataFrame.unionByName, scored)
