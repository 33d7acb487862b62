"""Queries that fit models or fingerprint files.

Each query builds what it reports under a base URI of its own; every model runs at its default
settings. SQL checks everything about a result that does not depend on the fitted numbers: ids,
folds, counts, widths, sums and ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstack.operators import metrics, stacking
from foldstack.operators.splits import FOLDS, SEED
from foldstack.plans import audit as checks
from foldstack.plans import jobs
from foldstack.plans.models import BASE_MODELS, STACKER
from foldstack.queries import fixtures as fx
from foldstack.sources import artifacts, scratch, tables

Query = Callable[[SparkSession, str], DataFrame]


def _landed(spark: SparkSession, sf: str, windows: DataFrame | None = None) -> str:
    """A base URI of the query's own, holding the embeddings (or other windows) as training table."""
    base = scratch.scratch_uri(spark, "workspace")
    jobs.ingest(spark, base, fx.windows(spark, sf) if windows is None else windows)
    return base


def _with_oof(spark: SparkSession, base: str, names: Sequence[str]) -> DataFrame:
    """Out-of-fold rows of the models under ``base``; returns their coverage."""
    return jobs.oof(spark, base, names)


def _with_stack(spark: SparkSession, base: str, models: Sequence[str]) -> None:
    """Base models, their out-of-fold rows and the stacker under ``base``."""
    # Neither reads what the other writes.
    steps = [lambda: _with_oof(spark, base, models), lambda: jobs.train(spark, base, models)]
    with ThreadPool(len(steps)) as pool:
        pool.map(inheritable_thread_target(spark)(lambda step: step()), steps, chunksize=1)
    jobs.stack_train(spark, base, models=models)


def _sound(proba: Column, width: int, within: float = 1e-9) -> Column:
    """A probability row: so many values, none negative, summing to one."""
    total = F.aggregate(proba, F.lit(0.0), lambda a, v: a + v)
    return (F.size(proba) == width) & (F.abs(total - 1) < within) & ~F.exists(proba, lambda v: v < 0)


def _oof(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        base = _landed(spark, sf)
        _with_oof(spark, base, [name])
        rows = tables.load_oof(spark, base, [name], SEED)
        return rows.select("window_id", "fold", "model", _sound(F.col("proba"), fx.N_CLASSES).alias("sound"))

    query.__name__ = f"oof_{name}"
    return query


def oof_large(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold rows of logistic regression at its defaults over every line item."""
    base = _landed(spark, sf, fx.large_windows(spark, sf))
    _with_oof(spark, base, ["logreg"])
    rows = tables.load_oof(spark, base, ["logreg"], SEED)
    return rows.select("window_id", "fold", _sound(F.col("proba"), 3).alias("sound"))


def oof_boosted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two classes need one booster: out-of-fold rows over the line items that were returned or accepted."""
    two = fx.large_windows(spark, sf).where("label in ('A', 'R')")
    base = _landed(spark, sf, two)
    _with_oof(spark, base, ["xgb"])
    rows = tables.load_oof(spark, base, ["xgb"], SEED)
    return rows.select("window_id", "fold", _sound(F.col("proba"), 2).alias("sound"))


def cross_validated_report(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and macro F1 per fold of cross-validated logistic regression."""
    base = _landed(spark, sf)
    windows = tables.read_windows(spark, base)
    split = jobs.get_or_create_split(spark, base)
    with jobs.training_frame(split.assign(windows)) as frame:
        pred = jobs.cross_validate(frame, "logreg", SEED)
        path = scratch.scratch_uri(spark, "cells")
        metrics.confusion_counts(pred, ["fold"]).write.parquet(path)
    report = metrics.report_by_fold(spark.read.parquet(path), "macro")
    return report.select("fold", "accuracy", "macro_f1", "n")


def _unit(*names: str) -> Column:
    """All named metrics lie in [0, 1]."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(n).between(0.0, 1.0), F.lit(False)) for n in names])


def oof_fold_report(spark: SparkSession, sf: str) -> DataFrame:
    report = cross_validated_report(spark, sf)
    return report.select("fold", "n", _unit("accuracy", "macro_f1").alias("in_range"))


def oof_stored_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage of the stored out-of-fold rows of all base models."""
    base = _landed(spark, sf)
    _with_oof(spark, base, BASE_MODELS)
    folds = tables.load_folds(spark, base, SEED, FOLDS)
    return stacking.coverage(folds, tables.load_oof(spark, base, list(BASE_MODELS), SEED), BASE_MODELS)


def train_model(spark: SparkSession, sf: str) -> DataFrame:
    """Three models on 80 %; on the rows it was fitted on each must beat naming the largest class."""
    base = _landed(spark, sf)
    sizes = tables.read_windows(spark, base).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n") / F.sum("n")).first()[0]
    report = jobs.train(spark, base, ["logreg", "rf", "xgb"])
    learned = (F.col("part") == "test") | (F.col("accuracy") > F.lit(largest))
    return report.select("model", "part", "n", _unit("accuracy").alias("in_range"), learned.alias("learned"))


def forest_out_of_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a forest learned from, those that some tree did not draw, and sound votes among them."""
    base = _landed(spark, sf)
    jobs.train(spark, base, "rf")
    rows = jobs.out_of_bag(spark, base, "rf")
    known = F.col("label").isin(fx.CLASSES) & F.col("prediction").isin(fx.CLASSES)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("window_id").alias("n_windows"),
        F.count_if(F.col("trees") > 0).alias("n_voted"),
        F.count_if(known & _sound(F.col("proba"), fx.N_CLASSES, 1e-6)).alias("n_sound"),
    )


def train_large(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression at its defaults on 80 % of the line items."""
    report = jobs.train(spark, _landed(spark, sf, fx.large_windows(spark, sf)), "logreg")
    return report.select("model", "part", "n", _unit("accuracy").alias("in_range"))


def _evaluation(record: DataFrame) -> DataFrame:
    """A stored record by fold: which metrics exist and lie in range, and the shape of its stamp."""
    names = ("accuracy", "precision", "recall", "f1")
    stamp = F.col("timestamp").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+]00:00)$")
    wide = record.select("model", "seed", "cv_folds", _unit(*names, "macro_f1").alias("in_range"), stamp.alias("stamped"), F.inline("fold_details"))
    inside = _unit(*names)
    return wide.select("model", "seed", "cv_folds", "fold", "stamped", (F.col("in_range") & inside).alias("in_range"))


def evaluate_model(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(jobs.evaluate(spark, _landed(spark, sf), "logreg"))


def evaluate_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation from stored out-of-fold rows, without refitting."""
    base = _landed(spark, sf)
    _with_oof(spark, base, ["rwkv_ts"])
    return _evaluation(jobs.evaluate(spark, base, "rwkv_ts", from_oof=True))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Two evaluations of one base append two rows; as exported, with the shape of their numbers."""
    base = _landed(spark, sf)
    _with_oof(spark, base, ["logreg"])
    for run in ("first", "second"):
        jobs.evaluate(spark, base, "logreg", run_id=run, git_sha="abc1234", from_oof=True)
    runs = tables.runs_as_text(tables.read_runs(spark, base))
    four, two = "^[01][.][0-9]{4}$", "^[0-9]+[.][0-9]{2}$"
    shaped = F.col("accuracy").rlike(four) & F.col("f1").rlike(four) & F.col("duration").rlike(two)
    n_windows = F.lit(tables.load_folds(spark, base, SEED, FOLDS).count())
    return runs.select("run_id", "model", "git_sha", shaped.alias("shaped"), n_windows.alias("n_windows"))


def split_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Folds from the stored split, made on first use and read on the second."""
    base = _landed(spark, sf)
    jobs.get_or_create_split(spark, base)
    split = jobs.get_or_create_split(spark, base)
    return split.assign(tables.read_windows(spark, base)).select("window_id", "label", "fold")


def split_renewed(spark: SparkSession, sf: str) -> DataFrame:
    """A table landed anew has its own split: half the windows first, then all of them."""
    base = _landed(spark, sf, fx.windows(spark, sf).where("label in ('c0', 'c1', 'c2')"))
    jobs.get_or_create_split(spark, base)
    jobs.ingest(spark, base, fx.windows(spark, sf))
    jobs.get_or_create_split(spark, base)
    return tables.load_folds(spark, base, SEED, FOLDS)


def stack_train(spark: SparkSession, sf: str) -> DataFrame:
    base = _landed(spark, sf)
    _with_oof(spark, base, BASE_MODELS)
    return _evaluation(jobs.stack_train(spark, base, models=BASE_MODELS))


def _predictions(result: DataFrame) -> DataFrame:
    proba = F.array(*[F.col(f"prob_class_{i}") for i in range(fx.N_CLASSES)])
    known = F.col("prediction").isin(fx.CLASSES)
    return result.select("window_id", known.alias("known_class"), _sound(proba, fx.N_CLASSES).alias("sound"))


def predict_model(spark: SparkSession, sf: str) -> DataFrame:
    base = _landed(spark, sf)
    jobs.train(spark, base, "logreg")
    return _predictions(jobs.predict(spark, base, "logreg", fx.windows(spark, sf)))


def predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written as CSV and read back."""
    base = _landed(spark, sf)
    jobs.train(spark, base, "cnn_transformer")
    path = scratch.scratch_uri(spark, "predictions")
    return _predictions(jobs.predict(spark, base, "cnn_transformer", fx.windows(spark, sf), path))


def stack_predict(spark: SparkSession, sf: str) -> DataFrame:
    base = _landed(spark, sf)
    _with_stack(spark, base, BASE_MODELS)
    return _predictions(jobs.predict(spark, base, STACKER, fx.windows(spark, sf), models=BASE_MODELS))


def predicted_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Every window scored by the stack: rows, and how many probability rows sum to one."""
    scored = stack_predict(spark, sf)
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("window_id").alias("n_windows"),
        F.count_if("sound").alias("n_normalised"),
    )


def audit_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every check over a base where all jobs ran; whether the stack is accepted depends on the fits."""
    base = _landed(spark, sf)
    _with_stack(spark, base, BASE_MODELS)
    for name in BASE_MODELS:
        jobs.evaluate(spark, base, name, from_oof=True)
    found = checks.audit(spark, base, "all", models=BASE_MODELS)
    return found.select("section", "check", (F.col("status") != "fail").alias("passed"))


def _files_by_label(spark: SparkSession, sf: str) -> str:
    """The line items written as one file per label.

    A file is written by one task, as its rows reach it: they are neither sorted nor held.
    """
    root = scratch.scratch_uri(spark, "manifest")
    rows = fx.large_windows(spark, sf)
    for label in [r["label"] for r in rows.select("label").distinct().collect()]:  # the few flags
        some = rows.where(F.col("label").eqNullSafe(F.lit(label))).drop("label").repartition(1)
        folder = tables.escaped(label) if label else "__HIVE_DEFAULT_PARTITION__"
        some.write.mode("append").parquet(f"{root}/windows/label={folder}")
    return root


def artifact_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files and distinct hashes below a folder with a file per label, one by one and streamed."""
    root = _files_by_label(spark, sf)
    sides = [
        artifacts.artifact_hashes(spark, root, whole_bytes=limit).withColumn("way", F.lit(way))
        for way, limit in (("whole", artifacts.WHOLE_BYTES), ("streamed", 0))
    ]
    return reduce(DataFrame.unionByName, sides).groupBy("way").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_distinct("rel_path").alias("n_paths"),
        F.count_distinct("sha256").alias("n_hashes"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )


def manifest_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest written, one label's file written anew with other rows, and checked: files by result."""
    root = _files_by_label(spark, sf)
    header, entries = artifacts.create_manifest(spark, root, metadata={"seed": SEED})
    artifacts.write_manifest(header, entries, root)
    other = fx.large_windows(spark, sf).where("label = 'R'").select("window_id").coalesce(1)
    other.write.mode("overwrite").parquet(f"{root}/windows/label=R")
    return artifacts.verify_manifest(spark, root).groupBy("ok").agg(F.count(F.lit(1)).alias("n_files"))


def manifest_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A digest tree of a file per label, one file written anew: whole files by ranges, and which have changed."""
    root, size = _files_by_label(spark, sf), 4096
    header, entries = artifacts.create_manifest(spark, root)
    artifacts.write_manifest(header, entries, root, artifacts.range_digests(spark, root, range_bytes=size))
    other = fx.large_windows(spark, sf).where("label = 'R'").select("window_id").coalesce(1)
    other.write.mode("overwrite").parquet(f"{root}/windows/label=R")
    checked = artifacts.verify_ranges(spark, root, size)
    label = F.regexp_extract("rel_path", "label=(.)", 1).alias("label")
    return checked.groupBy(label).agg(
        (F.count(F.lit(1)) > 1).alias("several"),
        (F.max(F.col("start") + F.col("length")) == F.sum("length")).alias("gapless"),
        (~F.every("ok")).alias("changed"),
    )


def verify_one_file(spark: SparkSession, sf: str) -> DataFrame:
    """Each file against its own hash and against another one."""
    root = _files_by_label(spark, sf)
    rows = artifacts.artifact_hashes(spark, root).orderBy("rel_path").collect()  # one row per label
    found = [
        (
            r["rel_path"].split("label=")[1][:1],
            artifacts.verify_file(spark, root, r["rel_path"], r["sha256"]),
            artifacts.verify_file(spark, root, r["rel_path"], "0" * 64),
        )
        for r in rows
    ]
    return spark.createDataFrame(found, "label string, own boolean, other boolean")


QUERIES: dict[str, Query] = {
    "oof_logreg": _oof("logreg"),
    "oof_rf": _oof("rf"),
    "oof_gbt": _oof("xgb"),
    "oof_seq_shift": _oof("rwkv_ts"),
    "oof_seq_conv": _oof("cnn_transformer"),
    "oof_large": oof_large,
    "oof_boosted_pairs": oof_boosted_pairs,
    "oof_fold_report": oof_fold_report,
    "oof_stored_coverage": oof_stored_coverage,
    "split_reuse": split_reuse,
    "split_renewed": split_renewed,
    "train_model": train_model,
    "forest_out_of_bag": forest_out_of_bag,
    "train_large": train_large,
    "evaluate_model": evaluate_model,
    "evaluate_stored": evaluate_stored,
    "run_log": run_log,
    "stack_train": stack_train,
    "predict_model": predict_model,
    "predictions_csv": predictions_csv,
    "stack_predict": stack_predict,
    "predicted_totals": predicted_totals,
    "audit_all": audit_all,
    "artifact_manifest": artifact_manifest,
    "manifest_verify": manifest_verify,
    "manifest_ranges": manifest_ranges,
    "verify_one_file": verify_one_file,
}
