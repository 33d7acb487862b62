"""The seven user-level jobs, each reading and writing tables under one base URI."""

from __future__ import annotations

import time
from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstack.functions.arrays import argmax, utc_stamp
from foldstack.operators import contract, metrics, splits, stacking
from foldstack.operators.classes import class_list, index_labels, label_distribution
from foldstack.operators.splits import FOLDS, SEED, RankedSplit, Split
from foldstack.plans.fitting import cross_validate, each_model, fit_model, layout_partitions, training_frame
from foldstack.plans.forest import ForestTrees
from foldstack.plans.models import BASE_MODELS, STACKER, check_name
from foldstack.sources import artifacts, tables
from foldstack.sources.synthetic import synthetic_windows


def ingest(
    spark: SparkSession,
    base: str,
    source: str | DataFrame | None = None,
    fmt: str = "parquet",
    seed: int = SEED,
) -> DataFrame:
    """Validate and land the training table; returns its label distribution.

    Without a source a synthetic table is landed. The source is read once: rows are staged as
    parsed, the contract is checked on the staged columns, and only a sound table is promoted. A
    broken source is read again to tell what is wrong with it.
    """
    if source is None:
        raw = synthetic_windows(spark, seed=seed)
    elif isinstance(source, DataFrame):
        raw = source
    else:
        raw = tables.read_dataset(spark, source, fmt)
    staged = tables.staging_path(base)
    try:
        contract.conformed(contract.parsed(raw)).write.parquet(staged)
        landed = spark.read.schema(contract.WINDOW_SCHEMA).parquet(staged)
        if not contract.is_sound(landed):
            contract.validate(raw)
            raise contract.ContractError("the source changed while it was read")
    except BaseException:
        tables.discard(spark, staged)
        raise
    tables.promote(spark, staged, base)
    return label_distribution(tables.read_windows(spark, base))


def get_or_create_split(
    spark: SparkSession, base: str, seed: int = SEED, k: int = FOLDS
) -> Split | RankedSplit:
    """The stored split for (seed, k), made on first use and anew for another version of the table."""
    windows, version = tables.windows_and_version(spark, base)
    if tables.marked_version(spark, base, tables.split_key(seed, k)) == version:
        return tables.load_split(spark, base, seed, k)
    tables.save_split(splits.fit_split(windows, seed, k), windows, base, version)
    return tables.load_split(spark, base, seed, k)


def _current_folds(spark: SparkSession, base: str, seed: int, k: int) -> DataFrame:
    tables.require_version(spark, base, tables.split_key(seed, k))
    return tables.load_folds(spark, base, seed, k)


def _current_oof(spark: SparkSession, base: str, models: Sequence[str], seed: int) -> DataFrame:
    for name in models:
        tables.require_version(spark, base, tables.oof_key(name, seed))
    return tables.load_oof(spark, base, list(models), seed)


def train(
    spark: SparkSession,
    base: str,
    name: str | Sequence[str] = "logreg",
    seed: int = SEED,
    size: str = "full",
    fit_rows: int | None = None,
    partitions: int | None = None,
    **overrides,
) -> DataFrame:
    """Fit one or several models on a stratified 80 % and save them.

    ``fit_rows``, here and in the other jobs that fit, bounds the rows learned from, and
    ``partitions`` is the number of pieces of the training layout; without it the table's size
    decides (see :func:`foldstack.plans.fitting.training_frame`). Both parts are scored whole. Returns ``(model, part, accuracy, n)`` for both parts; all models share one laid-out table.
    """
    names = [name] if isinstance(name, str) else list(name)
    for n in names:
        check_name(n)
    windows, version = tables.windows_and_version(spark, base)
    held_out = splits.fit_holdout_split(windows, seed).assign(windows)
    with training_frame(held_out, partitions=partitions, fit_rows=fit_rows) as frame:

        def fitted(n: str) -> pa.Table:
            model = fit_model(frame, n, seed, without=0, size=size, **overrides)
            tables.save_model(model, base, n, version)
            scored = model.transform(frame.every).select(
                F.lit(n).alias("model"),
                F.when(F.col("fold") == 0, "test").otherwise("train").alias("part"),
                F.col("prediction").alias("predicted"),
                F.col("label").alias("actual"),
            )
            # Two rows per model, computed before the layout is released.
            return metrics.accuracy(scored, ["model", "part"]).toArrow()

        reports = each_model(frame, names, fitted)
    return spark.createDataFrame(pa.concat_tables(reports))


def out_of_bag(spark: SparkSession, base: str, name: str = "rf", seed: int = SEED) -> DataFrame:
    """``(window_id, label, prediction, trees, proba)`` of the rows that :func:`train` fitted a forest on.

    Each row is voted on by the trees that did not draw it, in one pass without a shuffle; a row that
    every tree drew has zero trees and no prediction. Of a forest fitted with ``fit_rows`` the rows
    it never saw are voted on by all trees that would not have drawn them.
    """
    check_name(name)
    tables.require_version(spark, base, tables.model_key(name))
    model = tables.load_model(spark, base, name)
    learner, labels = model.stages[1], model.stages[-1].getOrDefault("labels")
    if not isinstance(learner, ForestTrees):
        raise ValueError(f"{name} is no forest: only forests have rows out of their bags")
    windows = tables.read_windows(spark, base)
    learned = splits.fit_holdout_split(windows, seed).assign(windows).where("fold = 1")
    voted = learner.out_of_bag(index_labels(learned, labels))
    names = F.array(*[F.lit(x) for x in labels])
    return voted.select(
        "window_id", F.get(names, F.col("y")).alias("label"), F.get(names, argmax(F.col("proba"))).alias("prediction"), "trees", "proba"
    )


def _cross_validated(cells: DataFrame, average: str, name: str, seed: int, k: int) -> DataFrame:
    """Metrics record of a cross-validation: fold means, each fold counting once, and details."""
    names = ("accuracy", "precision", "recall", "f1")
    return (
        metrics.report_by_fold(cells, average)
        .agg(
            *[F.avg(m).alias(m) for m in (*names, "macro_f1")],
            F.sort_array(F.collect_list(F.struct("fold", *names))).alias("fold_details"),
        )
        .select(
            "*",
            F.lit(name).alias("model"),
            F.lit(seed).alias("seed"),
            F.lit(k).alias("cv_folds"),
            utc_stamp().alias("timestamp"),
        )
    )


def _stored_predictions(spark: SparkSession, base: str, name: str, seed: int, k: int) -> DataFrame:
    """Cross-validated predictions read back from the out-of-fold table.

    A window without a stored row, a row without a window or a second row for one stops the
    evaluation, as does a table made from another version of the training table.
    """
    folds = _current_folds(spark, base, seed, k)
    labels = F.array(*[F.lit(x) for x in class_list(folds)])
    rows = _current_oof(spark, base, [name], seed).groupBy("window_id").agg(
        F.first("proba").alias("proba"), F.count(F.lit(1)).alias("_rows")
    )
    guess = F.get(labels, argmax(F.col("proba")))
    fault = (
        F.when(F.col("_rows").isNull(), "no out-of-fold row for window ")
        .when(F.col("fold").isNull(), "out-of-fold row of an unknown window ")
        .when(F.col("_rows") > 1, "several out-of-fold rows for window ")
    )
    stop = F.raise_error(F.concat(fault, F.coalesce("window_id", F.lit("null")))).cast("string")
    return folds.join(rows, "window_id", "full").select(
        "fold",
        F.col("label").alias("actual"),
        F.when(fault.isNull(), guess).otherwise(stop).alias("predicted"),
    )


def evaluate(
    spark: SparkSession,
    base: str,
    name: str = "logreg",
    seed: int = SEED,
    k: int = FOLDS,
    run_id: str = "dev",
    git_sha: str = "unknown",
    size: str = "full",
    parallelism: int | None = None,
    from_oof: bool = False,
    fit_rows: int | None = None,
    partitions: int | None = None,
    **overrides,
) -> DataFrame:
    """Stratified k-fold evaluation; writes metrics, confusion matrices and a run row.

    Precision, recall and F1 are weighted by support; the macro F1 is stored beside them so that
    the audit compares like with like. ``from_oof`` reads the predictions stored by :func:`oof`
    for the same seed and folds instead of fitting the same models again.
    """
    check_name(name)
    started = time.monotonic()
    if from_oof:
        _save_evaluation(_stored_predictions(spark, base, name, seed, k), base, name, seed, k)
    else:
        split = get_or_create_split(spark, base, seed, k)
        windows = split.assign(tables.read_windows(spark, base))
        with training_frame(windows, partitions=partitions, fit_rows=fit_rows) as frame:
            pred = cross_validate(frame, name, seed, size, parallelism, **overrides)
            _save_evaluation(pred, base, name, seed, k)
    saved = tables.load_metrics(spark, base, [name])
    run = saved.select(
        F.lit(run_id).alias("run_id"),
        "model",
        F.lit(git_sha).alias("git_sha"),
        "accuracy",
        "f1",
        F.lit(time.monotonic() - started).alias("duration"),
    )
    tables.append_run(run, base)
    return saved


def _save_evaluation(pred: DataFrame, base: str, name: str, seed: int, k: int) -> None:
    """Score once; every metric and matrix is computed from the few cells that remain."""
    cells = metrics.confusion_counts(pred, ["fold"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tables.save_metrics(_cross_validated(cells, "weighted", name, seed, k), base, name)
        seen = F.explode(F.array("actual", "predicted")).alias("label")
        classes = class_list(cells.select(seen))
        names = [f"pred_{i}" for i in range(len(classes))]
        tables.save_confusion(metrics.cells_wide(cells, classes, names=names), base, name)
    finally:
        cells.unpersist()


def generate_oof(
    windows: DataFrame,
    split: Split,
    names: Sequence[str],
    base: str,
    seed: int = SEED,
    size: str = "full",
    parallelism: int | None = None,
    fit_rows: int | None = None,
    partitions: int | None = None,
    version: str | None = None,
    **overrides,
) -> DataFrame:
    """Store out-of-fold probabilities of each model; all models share one laid-out table.

    ``version`` is that of the training table the windows were read from.
    """
    for name in names:
        check_name(name)
    with training_frame(split.assign(windows), partitions=partitions, fit_rows=fit_rows) as frame:

        def stored(name: str) -> None:
            pred = cross_validate(frame, name, seed, size, parallelism, **overrides)
            tables.save_oof(
                pred.select(
                    "window_id",
                    "fold",
                    "proba",
                    F.lit(name).alias("model"),
                    F.lit(seed).cast("long").alias("seed"),
                ),
                base,
                version,
            )

        each_model(frame, names, stored)
    return tables.load_oof(windows.sparkSession, base, list(names), seed)


def oof(
    spark: SparkSession,
    base: str,
    name: str | Sequence[str],
    seed: int = SEED,
    k: int = FOLDS,
    size: str = "full",
    parallelism: int | None = None,
    fit_rows: int | None = None,
    partitions: int | None = None,
    **overrides,
) -> DataFrame:
    """Generate and store the out-of-fold table of one or several models; returns the coverage.

    ``(model, n_rows, zero_rows, missing_rows, extra_rows, duplicate_rows)``, see
    :func:`foldstack.operators.stacking.coverage`.
    """
    names = [name] if isinstance(name, str) else list(name)
    split = get_or_create_split(spark, base, seed, k)
    windows, version = tables.windows_and_version(spark, base)
    generate_oof(windows, split, names, base, seed, size, parallelism, fit_rows, partitions, version, **overrides)
    folds = tables.load_folds(spark, base, seed, k)
    return stacking.coverage(folds, tables.load_oof(spark, base, names, seed), names)


def stack_train(
    spark: SparkSession,
    base: str,
    seed: int = SEED,
    k: int = FOLDS,
    models: Sequence[str] = BASE_MODELS,
    stacker: str = STACKER,
    git_sha: str = "unknown",
    size: str = "full",
    parallelism: int | None = None,
    fit_rows: int | None = None,
    partitions: int | None = None,
    **overrides,
) -> DataFrame:
    """Cross-validate and fit the stacker on stored out-of-fold tables."""
    check_name(stacker)
    models = list(models)
    base_oof = _current_oof(spark, base, models, seed)
    folds = _current_folds(spark, base, seed, k)
    width = len(models) * folds.select("label").distinct().count()
    partitions = partitions or layout_partitions(folds.count() * width * 8)
    labelled = stacking.labelled_stack(base_oof, folds, models, partitions)
    with training_frame(labelled, "stack", partitions, folds, width, fit_rows) as frame:
        pred = cross_validate(frame, stacker, seed, size, parallelism, **overrides)
        pred = pred.persist(StorageLevel.MEMORY_AND_DISK)  # scored once, read by both aggregates
        try:
            pooled = metrics.metric_bundle(pred).first()
            cells = metrics.confusion_counts(pred, ["fold"])
            record = _cross_validated(cells, "macro", STACKER, seed, k).select(
                "*",
                F.lit(pooled["ece"]).alias("ece"),
                F.lit(pooled["logloss"]).cast("double").alias("logloss"),
            )
            tables.save_metrics(record, base, STACKER)
        finally:
            pred.unpersist()
        final = fit_model(frame, stacker, seed, None, size, parallelism, **overrides)
        tables.save_model(final, base, STACKER)
    saved = tables.load_metrics(spark, base, [STACKER])
    scores = saved.select("f1", "ece").first()
    header, entries = artifacts.create_manifest(
        spark,
        base,
        [*models, STACKER],
        git_sha,
        {"seed": seed, "cv_folds": k, "stack_f1": scores["f1"], "stack_ece": scores["ece"]},
    )
    artifacts.write_manifest(header, entries, base)
    return saved


def stack_scores(
    spark: SparkSession, base: str, windows: DataFrame, models: Sequence[str] = BASE_MODELS
) -> DataFrame:
    """All base models applied to the same rows, their probabilities joined into ``stack``."""
    scored, known = windows, None
    for i, name in enumerate(models):
        model = tables.load_model(spark, base, name)
        labels = model.stages[-1].getOrDefault("labels")
        if known is not None and labels != known:
            raise ValueError(f"{name} was fitted on other labels than {models[0]}: train the base models together")
        known = labels
        scored = model.transform(scored).withColumnRenamed("proba", f"_base{i}").drop("prediction")
    parts = [f"_base{i}" for i in range(len(models))]
    return scored.withColumn("stack", F.concat(*parts)).drop(*parts)


def prediction_table(scored: DataFrame, n_classes: int) -> DataFrame:
    """``[window_id,] prediction, prob_class_0 ..``."""
    key = ["window_id"] if "window_id" in scored.columns else []
    return scored.select(
        *key,
        "prediction",
        *[F.get("proba", F.lit(i)).alias(f"prob_class_{i}") for i in range(n_classes)],
    )


def predict(
    spark: SparkSession,
    base: str,
    name: str,
    source: str | DataFrame,
    output: str | None = None,
    models: Sequence[str] = BASE_MODELS,
) -> DataFrame:
    """Score a table with one model or the stack: a narrow plan from scan to write.

    A window of another width than the model was fitted on stops the scoring and is named. With an
    ``output`` the written table is returned, so nothing is scored twice.
    """
    check_name(name)
    raw = source if isinstance(source, DataFrame) else tables.read_dataset(spark, source)
    rows = contract.with_features(raw)
    if name == STACKER:
        rows = stack_scores(spark, base, rows, models)
    model = tables.load_model(spark, base, name)
    labels = model.stages[-1].getOrDefault("labels")
    if name == STACKER:
        base_labels = tables.load_model(spark, base, models[0]).stages[-1].getOrDefault("labels")
        if base_labels != labels:
            raise ValueError("the stacker was fitted on other labels than the base models: train it again")
    result = prediction_table(model.transform(rows), len(labels))
    return result if output is None else tables.write_predictions(result, output)
