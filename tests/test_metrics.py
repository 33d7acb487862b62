import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldstack.operators import metrics

PRED = "y int, proba array<double>"


def _pairs(spark, pairs):
    return spark.createDataFrame(pairs, "actual string, predicted string")


def _row(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    "conf, expected",
    [(0.0, 0), (0.1, 1), (0.3, 3), (0.30000000000000004, 3), (0.5, 5), (1.0, 10), (0.05, 1)],
)
def test_calibration_bins_are_open_below(spark, conf, expected):
    row = spark.range(1).select(metrics.calibration_bin(F.lit(conf)).alias("b")).first()
    assert row["b"] == expected


def test_never_predicted_class_counts_as_zero(spark):
    pred = _pairs(spark, [("a", "a"), ("a", "a"), ("b", "b"), ("c", "a")])
    cells = metrics.confusion_counts(pred)
    report = {r["class"]: r for r in metrics.class_report(cells).collect()}
    assert report["c"]["precision"] == 0 and report["c"]["f1"] == 0
    macro = _row(metrics.report(cells, "macro"))
    assert macro["precision"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert macro["recall"] == pytest.approx((1 + 1 + 0) / 3)


def test_class_only_predicted_joins_the_macro_mean(spark):
    pred = _pairs(spark, [("a", "a"), ("b", "c")])
    cells = metrics.confusion_counts(pred)
    assert _row(metrics.report(cells, "macro"))["recall"] == pytest.approx(1 / 3)
    assert _row(metrics.report(cells, "weighted"))["recall"] == pytest.approx(1 / 2)


def test_average_is_checked(spark):
    with pytest.raises(ValueError, match="macro or weighted"):
        metrics.report(metrics.confusion_counts(_pairs(spark, [("a", "a")])), "micro")


def test_confusion_keeps_empty_cells_and_absent_truth(spark):
    pred = _pairs(spark, [("a", "a"), ("a", "c"), ("b", "a")])
    long = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_long(pred, ["a", "b", "c"]).collect()}
    assert len(long) == 9
    assert long["a", "c"] == 1 and long["c", "c"] == 0 and long["b", "b"] == 0


def test_log_loss_is_null_when_a_class_is_missing(spark):
    pred = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.1, 0.8, 0.1])], PRED)
    assert _row(metrics.log_loss(pred))["logloss"] is None
    assert _row(metrics.metric_bundle(pred))["logloss"] is None


def test_log_loss_clips_zero_probability(spark):
    pred = spark.createDataFrame([(0, [0.0, 1.0]), (1, [0.0, 1.0])], PRED)
    expected = -math.log(2.220446049250313e-16) / 2
    assert _row(metrics.log_loss(pred))["logloss"] == pytest.approx(expected, rel=1e-6)


def _reference_metrics(y, proba):
    """Direct numpy computation of the definitions."""
    n, c = proba.shape
    guess, conf = proba.argmax(axis=1), proba.max(axis=1)
    seen = sorted(set(y) | set(guess))
    precision, recall, f1 = [], [], []
    for k in seen:
        hits = np.sum((y == k) & (guess == k))
        chosen, support = np.sum(guess == k), np.sum(y == k)
        precision.append(hits / chosen if chosen else 0.0)
        recall.append(hits / support if support else 0.0)
        f1.append(2 * hits / (chosen + support))
    edges = np.linspace(0, 1, 11)
    ece = 0.0
    for low, high in zip(edges[:-1], edges[1:]):
        inside = (conf > low) & (conf <= high)
        if inside.any():
            ece += abs(conf[inside].mean() - (guess == y)[inside].mean()) * inside.mean()
    loss = None
    if len(set(y)) == c:
        p = np.clip(proba[np.arange(n), y], 2.220446049250313e-16, 1 - 2.220446049250313e-16)
        loss = float(-np.log(p).mean())
    return {
        "accuracy": float((guess == y).mean()),
        "precision": float(np.mean(precision)),
        "recall": float(np.mean(recall)),
        "f1": float(np.mean(f1)),
        "ece": float(ece),
        "logloss": loss,
    }


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), n=st.integers(1, 60), c=st.integers(2, 5))
def test_bundle_equals_direct_computation(spark, seed, n, c):
    rng = np.random.default_rng(seed)
    proba = rng.dirichlet(np.ones(c), n)
    y = rng.integers(0, c, n)
    pred = spark.createDataFrame([(int(a), p.tolist()) for a, p in zip(y, proba)], PRED)
    got, want = _row(metrics.metric_bundle(pred)), _reference_metrics(y, proba)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-9) if value is not None else got[name] is None
    assert _row(metrics.ece(pred))["ece"] == pytest.approx(want["ece"], abs=1e-9)


def test_fold_means_weigh_folds_equally(spark):
    rows = [(0, "a", "a")] * 9 + [(0, "b", "a")] + [(1, "a", "b")]
    pred = spark.createDataFrame(rows, "fold int, actual string, predicted string")
    per_fold = metrics.report_by_fold(metrics.confusion_counts(pred, ["fold"]), "weighted")
    assert _row(metrics.mean_of_folds(per_fold))["accuracy"] == pytest.approx((0.9 + 0.0) / 2)


@pytest.mark.parametrize(
    "stack_f1, ece, accepted", [(0.52, 0.5, True), (0.51, 0.03, True), (0.51, 0.04, False)]
)
def test_acceptance_rule(spark, stack_f1, ece, accepted):
    scores = spark.createDataFrame(
        [("rf", 0.5, 0.2), ("xgb", 0.4, 0.2), ("stack", stack_f1, ece)], "model string, f1 double, ece double"
    )
    assert _row(metrics.best_base(scores))["accepted"] is accepted


def test_acceptance_without_base_metrics(spark):
    alone = spark.createDataFrame([("stack", 0.3, 0.2)], "model string, f1 double, ece double")
    row = _row(metrics.best_base(alone))
    assert row["best_base_f1"] == 0 and row["accepted"]


def test_metric_cells_come_from_one_scan(spark):
    pred = spark.createDataFrame([(0, [0.6, 0.4])], PRED)
    plan = metrics.metric_bundle(pred)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


@pytest.mark.parametrize("labels", [["a", "A"], ["actual", "b"], ["predicted", "n"], ["we`ird", "a.b"], ["", "x"]])
def test_any_text_may_be_a_label(spark, labels):
    pred = spark.createDataFrame([(labels[0], labels[1]), (labels[0], labels[0])], "actual string, predicted string")
    long = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_long(pred, labels).collect()}
    assert long == {(labels[0], labels[0]): 1, (labels[0], labels[1]): 1, (labels[1], labels[0]): 0, (labels[1], labels[1]): 0}
    wide = metrics.cells_wide(metrics.confusion_counts(pred), labels, names=["pred_0", "pred_1"])
    assert {r["actual"]: (r["pred_0"], r["pred_1"]) for r in wide.collect()} == {labels[0]: (1, 1), labels[1]: (0, 0)}
