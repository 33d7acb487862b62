"""Queries with an exact SQL twin: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstack.functions import arrays, sequence
from foldstack.operators import classes, contract, metrics, splits, stacking
from foldstack.plans.audit import FAIL, OK, verdict
from foldstack.plans import jobs
from foldstack.queries import fixtures as fx
from foldstack.queries.fixtures import round6
from foldstack.sources import artifacts, scratch, tables
from foldstack.sources.synthetic import windows_for

Query = Callable[[SparkSession, str], DataFrame]
MIX = 0.3


def _totals(df: DataFrame) -> DataFrame:
    """Conformed windows in comparable form: size and sum of the features."""
    return df.select(
        "window_id",
        "label",
        F.size("features").alias("n_features"),
        round6(arrays.array_sum(F.col("features"))).alias("total"),
    )


def label_distribution(spark, sf):
    return classes.label_distribution(fx.large_windows(spark, sf))


def dataset_profile(spark, sf):
    return contract.profile(fx.large_windows(spark, sf))


def dataset_expectations(spark, sf):
    return contract.expectations(
        fx.windows(spark, sf), num_rows=500, num_cols=3, columns=("window_id", "label", "features")
    )


def class_list(spark, sf):
    return classes.class_summary(fx.windows(spark, sf))


def windows_conformed(spark, sf):
    raw = fx.windows(spark, sf).withColumn("window_id", F.col("window_id").cast("long"))
    return _totals(contract.conform(raw))


def contract_violations(spark, sf):
    return contract.violations(fx.json_events(spark, sf))


def violation_counts(spark, sf):
    return contract.violation_counts(fx.json_events(spark, sf))


def duplicate_ids(spark, sf):
    """Orders holding several line items, seen as a repeated id."""
    return contract.duplicate_ids(
        fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("window_id"))
    )


def wide_to_features(spark, sf):
    gathered = contract.wide_to_features(fx.wide_windows(spark, sf))
    return gathered.select(
        "window_id", "label", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(4)]
    )


def json_features(spark, sf):
    text = fx.windows(spark, sf).withColumn("features", F.to_json("features"))
    return _totals(contract.conform(text))


def csv_round_trip(spark, sf):
    path = scratch.scratch_uri(spark, "csv")
    tables.write_dataset(fx.windows(spark, sf), path, "csv")
    return _totals(contract.conform(tables.read_dataset(spark, path, "csv")))


def json_round_trip(spark, sf):
    path = scratch.scratch_uri(spark, "json")
    tables.write_dataset(fx.large_windows(spark, sf), path, "json")
    return _totals(contract.conform(tables.read_dataset(spark, path, "json")))


def feature_dimension(spark, sf):
    return contract.feature_dimension(fx.windows(spark, sf))


def vector_round_trip(spark, sf):
    vectors = fx.windows(spark, sf).withColumn("features", array_to_vector("features"))
    return _totals(contract.conform(vectors))


def label_codes(spark, sf):
    coded = classes.label_codes(fx.large_windows(spark, sf))
    return coded.select("window_id", "label", F.col("code").cast("int").alias("code"))


def label_decode(spark, sf):
    pred = fx.multiclass_predictions(spark, sf)
    names = classes.class_list(pred)
    coded = pred.select("window_id", arrays.argmax(F.col("proba")).cast("double").alias("guess"))
    decoded = classes.decode_labels(coded, names, "guess", "decoded")
    return decoded.select("window_id", F.col("guess").cast("int").alias("guess"), "decoded")


def label_index(spark, sf):
    rows = fx.windows(spark, sf)
    indexed = classes.index_labels(rows, classes.class_list(rows))
    return indexed.select("window_id", "label", F.col("y").cast("int").alias("y"))


def class_weights(spark, sf):
    weights = classes.class_weights(fx.large_windows(spark, sf))
    return weights.select("label", "n", round6(F.col("weight")).alias("weight"))


def stratified_folds(spark, sf):
    return splits.assign_folds(fx.windows(spark, sf)).select("window_id", "label", "fold")


def stratified_folds_large(spark, sf):
    return splits.assign_folds(fx.large_windows(spark, sf)).select("window_id", "label", "fold")


def many_label_codes(spark, sf):
    coded = classes.label_codes(fx.order_windows(spark, sf))
    return coded.select("window_id", "label", "code")


def many_label_weights(spark, sf):
    weights = classes.class_weights(fx.order_windows(spark, sf))
    return weights.select("label", "n", round6(F.col("weight")).alias("weight"))


def many_label_folds(spark, sf):
    rows = fx.order_windows(spark, sf)
    return splits.assign_folds(rows).select("window_id", "label", "fold")


def many_label_holdout(spark, sf):
    rows = fx.order_windows(spark, sf)
    parts = splits.fit_holdout_split(rows).assign(rows, "part")
    return parts.select("window_id", "label", (F.col("part") == 0).alias("is_test"))


def stratified_folds_by_rank(spark, sf):
    return splits.assign_folds_by_rank(fx.large_windows(spark, sf))


def fold_sizes(spark, sf):
    folds = splits.assign_folds(fx.large_windows(spark, sf))
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


def holdout_split(spark, sf):
    rows = fx.large_windows(spark, sf)
    parts = splits.fit_holdout(rows).assign(rows, "part")
    return parts.select("window_id", "label", (F.col("part") == 0).alias("is_test"))


def train_valid_counts(spark, sf):
    """Sizes of both sides of every fold, pooled over the folds."""
    folds = splits.assign_folds(fx.windows(spark, sf))

    def sides(fold):
        def count(rows, side):
            return rows.agg(
                F.lit(fold).alias("fold"), F.lit(side).alias("side"), F.count(F.lit(1)).alias("n")
            )

        return count(splits.training(folds, fold), "train").unionByName(
            count(splits.validation(folds, fold), "valid")
        )

    return reduce(DataFrame.unionByName, [sides(f) for f in range(splits.FOLDS)])


def folds_joined(spark, sf):
    """Folds stored as rows, joined back to the windows by id."""
    rows = fx.large_windows(spark, sf)
    base = scratch.scratch_uri(spark, "folds")
    tables.save_split(splits.fit_folds(rows), rows, base)
    stored = tables.load_folds(spark, base, splits.SEED, splits.FOLDS)
    joined = splits.attach_folds(rows, stored)
    return joined.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.get("features", F.lit(1))), 2).alias("price")
    )


def argmax_confidence(spark, sf):
    proba = F.col("proba")
    return fx.multiclass_predictions(spark, sf).select(
        "window_id",
        arrays.argmax(proba).alias("guess"),
        round6(arrays.confidence(proba)).alias("conf"),
        arrays.hit(arrays.argmax(proba), F.col("y")).alias("hit"),
    )


def softmax_rows(spark, sf):
    rows = fx.windows(spark, sf)
    soft = rows.select("window_id", arrays.softmax(F.col("features")).alias("s"))
    return fx.channels_long(soft, F.col("s"))


def prediction_table(spark, sf):
    scored = fx.multiclass_predictions(spark, sf).withColumn("prediction", F.col("predicted"))
    result = jobs.prediction_table(scored, fx.N_CLASSES)
    return result.select(
        "window_id",
        "prediction",
        *[round6(F.col(f"prob_class_{i}")).alias(f"prob_class_{i}") for i in range(fx.N_CLASSES)],
    )


def accuracy_by_fold(spark, sf):
    scores = metrics.accuracy(fx.folded_predictions(spark, sf), ["fold"])
    return scores.select("fold", round6(F.col("accuracy")).alias("accuracy"), "n")


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *[round6(F.col(v)).alias(v) for v in values])


REPORT = ["precision", "recall", "f1"]


def fold_metrics(spark, sf):
    cells = metrics.confusion_counts(fx.folded_predictions(spark, sf), ["fold"])
    return _rounded(
        metrics.report_by_fold(cells, "weighted"), ["fold"], ["accuracy", *REPORT, "macro_f1"]
    )


def fold_mean_metrics(spark, sf):
    cells = metrics.confusion_counts(fx.folded_predictions(spark, sf), ["fold"])
    mean = metrics.mean_of_folds(metrics.report_by_fold(cells, "weighted"))
    return _rounded(mean, ["folds"], ["accuracy", *REPORT])


def confusion_long(spark, sf):
    return metrics.confusion_long(fx.multiclass_predictions(spark, sf), fx.CLASSES)


def confusion_wide(spark, sf):
    return metrics.confusion_wide(fx.multiclass_predictions(spark, sf), fx.CLASSES)


def class_report(spark, sf):
    cells = metrics.confusion_counts(fx.multiclass_predictions(spark, sf))
    return _rounded(metrics.class_report(cells), ["class", "support"], REPORT)


def report_weighted(spark, sf):
    cells = metrics.confusion_counts(fx.multiclass_predictions(spark, sf))
    return _rounded(metrics.report(cells, "weighted"), [], REPORT)


def report_macro(spark, sf):
    cells = metrics.confusion_counts(fx.multiclass_predictions(spark, sf))
    return _rounded(metrics.report(cells, "macro"), [], REPORT)


def ece_binary(spark, sf):
    return _rounded(metrics.ece(fx.binary_predictions(spark, sf)), [], ["ece"])


def ece_multiclass(spark, sf):
    return _rounded(metrics.ece(fx.multiclass_predictions(spark, sf)), [], ["ece"])


def reliability_bins(spark, sf):
    bins = metrics.reliability(fx.large_predictions(spark, sf), by=["model"])
    return _rounded(bins, ["model", "bin", "n"], ["sum_conf", "sum_hit"])


def log_loss(spark, sf):
    return _rounded(metrics.log_loss(fx.multiclass_predictions(spark, sf)), [], ["logloss"])


BUNDLE = ["accuracy", *REPORT, "ece", "logloss"]


def metric_bundle(spark, sf):
    return _rounded(metrics.metric_bundle(fx.oof_long(spark, sf), ["model"]), ["model"], BUNDLE)


def metric_bundle_large(spark, sf):
    scores = metrics.metric_bundle(fx.large_predictions(spark, sf), ["model"])
    return _rounded(scores, ["model"], BUNDLE)


def stack_matrix(spark, sf):
    stack = stacking.stack_matrix(fx.oof_long(spark, sf), list(fx.SLICES))
    return fx.channels_long(stack, F.col("stack"))


def stack_with_labels(spark, sf):
    stack = stacking.stack_matrix(fx.oof_long(spark, sf), list(fx.SLICES))
    labelled = stacking.with_labels(stack, fx.windows(spark, sf))
    return labelled.select(
        "window_id",
        "label",
        F.size("stack").alias("width"),
        round6(arrays.array_sum(F.col("stack"))).alias("total"),
    )


def oof_zero_rows(spark, sf):
    return stacking.zero_rows(fx.document_oof(spark, sf))


def oof_missing(spark, sf):
    return stacking.missing_rows(fx.document_folds(spark, sf), fx.document_oof(spark, sf))


def oof_coverage(spark, sf):
    rows = fx.document_oof(spark, sf).withColumn("model", F.lit("labels"))
    return stacking.coverage(fx.document_folds(spark, sf), rows, ["labels"])


def oof_coverage_faults(spark, sf):
    """Coverage of tables with foreign and repeated rows, three models in one pass."""
    names = ["doubled", "plain", "repeated"]
    return stacking.coverage(fx.document_folds(spark, sf), fx.faulty_oof(spark, sf), names)


def stack_acceptance(spark, sf):
    scores = metrics.metric_bundle(fx.oof_long(spark, sf), ["model"])
    best = metrics.best_base(scores, stacker="m2")
    return best.select(
        *[round6(F.col(c)).alias(c) for c in ("stack_f1", "stack_ece", "best_base_f1", "gain_points")],
        "accepted",
    )


def metric_ranges(spark, sf):
    balance = F.col("c_acctbal")
    scores = fx.table(spark, sf, "customer").select(
        F.col("c_name").alias("model"),
        (balance / 10000).alias("accuracy"),
        (balance / 5000).alias("recall"),
        F.when(F.col("c_mktsegment") != "BUILDING", balance / 8000).alias("auc"),
    )
    return contract.metric_range_violations(scores)


def metric_ranges_custom(spark, sf):
    """Range rule over the engine's own metric names and a map of custom ones."""
    price = F.col("o_totalprice")
    scores = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("model"),
        (price / 200000).alias("macro_f1"),
        F.create_map(
            F.col("o_orderpriority"), price / 300000, F.lit("lift"), F.when(F.col("o_orderstatus") == "F", price / 400000)
        ).alias("custom_metrics"),
    )
    return contract.metric_range_violations(scores)


def audit_verdict(spark, sf):
    checks = stacking.zero_rows(fx.document_oof(spark, sf)).select(
        F.when(F.col("zero_rows") > 0, FAIL).otherwise(OK).alias("status")
    )
    return verdict(checks)


def hash_verification(spark, sf):
    return artifacts.compare_hashes(fx.recorded_hashes(spark, sf), fx.current_hashes(spark, sf))


def first_failures(spark, sf):
    return artifacts.first_failures(hash_verification(spark, sf))


def value_sha256(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", arrays.sha256(F.col("text")).alias("digest")
    )


def _steps(spark, sf) -> DataFrame:
    steps = sequence.to_steps(F.col("features"))
    return fx.windows(spark, sf).select("window_id", steps.alias("steps"))


def seq_reshape(spark, sf):
    return fx.steps_long(_steps(spark, sf), F.col("steps"))


def seq_instance_norm(spark, sf):
    return fx.steps_long(_steps(spark, sf), sequence.instance_norm(F.col("steps")))


def seq_shift(spark, sf):
    return fx.steps_long(_steps(spark, sf), sequence.shift_right(F.col("steps")))


def seq_mix(spark, sf):
    return fx.steps_long(_steps(spark, sf), sequence.time_mix(F.col("steps"), MIX))


def seq_causal_conv(spark, sf):
    return fx.steps_long(_steps(spark, sf), sequence.causal_conv(F.col("steps")))


def seq_pool(spark, sf):
    both = F.zip_with(
        sequence.pool_last(F.col("steps")),
        sequence.pool_mean(F.col("steps")),
        lambda last, mean: F.struct(last.alias("last"), mean.alias("mean")),
    )
    rows = _steps(spark, sf).select("window_id", F.posexplode(both).alias("c", "pool"))
    return rows.select(
        "window_id",
        "c",
        round6(F.col("pool.last")).alias("last_value"),
        round6(F.col("pool.mean")).alias("mean_value"),
    )


def seq_patch(spark, sf):
    steps = _steps(spark, sf)
    scales = F.array(
        *[
            F.struct(
                F.lit(size).alias("size"), sequence.patch_means(F.col("steps"), size).alias("rows")
            )
            for size in sequence.PATCHES
        ]
    )
    by_size = steps.select("window_id", F.inline(scales))
    by_patch = by_size.select("window_id", "size", F.posexplode("rows").alias("p", "row"))
    cells = by_patch.select("window_id", "size", "p", F.posexplode("row").alias("c", "x"))
    return cells.select("window_id", "size", "p", "c", round6(F.col("x")).alias("value"))


def synthetic_windows(spark, sf):
    """A synthetic twin with one row per embedding."""
    ids = fx.table(spark, sf, "embeddings").select("vec_id")
    twin = windows_for(ids, "vec_id", splits.SEED)
    cells = twin.select("window_id", "label", F.posexplode("features").alias("c", "x"))
    return cells.select("window_id", "label", "c", round6(F.col("x")).alias("value"))


def ingest(spark, sf):
    """Validate, land and read back the large table."""
    return jobs.ingest(spark, scratch.scratch_uri(spark, "ingest"), fx.large_windows(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        label_distribution,
        dataset_profile,
        dataset_expectations,
        class_list,
        windows_conformed,
        contract_violations,
        violation_counts,
        duplicate_ids,
        wide_to_features,
        json_features,
        csv_round_trip,
        json_round_trip,
        feature_dimension,
        vector_round_trip,
        label_codes,
        label_decode,
        label_index,
        class_weights,
        many_label_codes,
        many_label_weights,
        many_label_folds,
        many_label_holdout,
        stratified_folds,
        stratified_folds_large,
        stratified_folds_by_rank,
        fold_sizes,
        holdout_split,
        train_valid_counts,
        folds_joined,
        argmax_confidence,
        softmax_rows,
        prediction_table,
        accuracy_by_fold,
        fold_metrics,
        fold_mean_metrics,
        confusion_long,
        confusion_wide,
        class_report,
        report_weighted,
        report_macro,
        ece_binary,
        ece_multiclass,
        reliability_bins,
        log_loss,
        metric_bundle,
        metric_bundle_large,
        stack_matrix,
        stack_with_labels,
        oof_zero_rows,
        oof_missing,
        oof_coverage,
        oof_coverage_faults,
        stack_acceptance,
        metric_ranges,
        metric_ranges_custom,
        audit_verdict,
        hash_verification,
        first_failures,
        value_sha256,
        seq_reshape,
        seq_instance_norm,
        seq_shift,
        seq_mix,
        seq_causal_conv,
        seq_pool,
        seq_patch,
        synthetic_windows,
        ingest,
    )
}
