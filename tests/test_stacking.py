import pytest
from pyspark.sql import functions as F

from foldstack.operators import stacking

OOF = "window_id string, model string, proba array<double>"


def _oof(spark, rows):
    return spark.createDataFrame(rows, OOF)


def test_models_keep_their_order_and_key(spark):
    oof = _oof(
        spark,
        [
            ("1", "b", [0.2, 0.8]),
            ("1", "a", [0.9, 0.1]),
            ("2", "a", [0.5, 0.5]),
            ("2", "b", [0.4, 0.6]),
            ("1", "ignored", [1.0, 0.0]),
        ],
    )
    rows = {r["window_id"]: r["stack"] for r in stacking.stack_matrix(oof, ["a", "b"]).collect()}
    assert rows == {"1": [0.9, 0.1, 0.2, 0.8], "2": [0.5, 0.5, 0.4, 0.6]}


@pytest.mark.parametrize(
    "rows",
    [
        [("1", "a", [0.9, 0.1])],
        [("1", "a", [0.9, 0.1]), ("1", "a", [0.9, 0.1])],
        [("1", "a", [0.9, 0.1]), ("1", "b", [0.9, 0.1]), ("1", "b", [0.9, 0.1])],
        [("1", "a", [0.9, 0.1]), ("1", "b", [0.5, 0.3, 0.2])],
    ],
    ids=["missing model", "repeated model", "extra row", "unequal classes"],
)
def test_misaligned_rows_raise(spark, rows):
    with pytest.raises(Exception, match="without exactly one aligned row"):
        stacking.stack_matrix(_oof(spark, rows), ["a", "b"]).collect()


def test_one_shuffle_for_any_number_of_models(spark):
    oof = _oof(spark, [("1", m, [1.0]) for m in "abcdef"])
    plan = stacking.stack_matrix(oof, list("abcdef"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_coverage_flags_zero_and_missing_rows(spark):
    folds = spark.createDataFrame([("1",), ("2",), ("3",)], "window_id string")
    oof = _oof(spark, [("1", "a", [0.5, 0.5]), ("2", "a", [0.0, 0.0])])
    assert stacking.coverage(folds, oof, ["a"]).first().asDict() == {
        "model": "a",
        "n_rows": 2,
        "zero_rows": 1,
        "missing_rows": 1,
        "extra_rows": 0,
        "duplicate_rows": 0,
    }
    assert [r["window_id"] for r in stacking.missing_rows(folds, oof).collect()] == ["3"]
    zero = stacking.zero_rows(oof).first()
    assert (zero["n_rows"], zero["zero_rows"]) == (2, 1)


def test_coverage_sees_foreign_and_duplicate_rows(spark):
    folds = spark.createDataFrame([("1",), ("2",), ("3",)], "window_id string")
    rows = [("1", "a", [0.5, 0.5]), ("1", "a", [0.5, 0.5]), ("9", "a", [1.0, 0.0]), ("9", "a", [0.0, 0.0]), ("2", "b", [1.0, 0.0])]
    found = {r["model"]: tuple(r)[1:] for r in stacking.coverage(folds, _oof(spark, rows), ["a", "b", "c"]).collect()}
    assert found == {"a": (4, 1, 2, 2, 2), "b": (1, 0, 2, 0, 0), "c": (0, 0, 3, 0, 0)}


def test_coverage_of_all_models_is_one_wide_pass(spark):
    oof = _oof(spark, [("1", m, [1.0]) for m in "abcdef"])
    folds = spark.createDataFrame([("1",)], "window_id string")
    plan = stacking.coverage(folds, oof, list("abcdef"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the split's ids and the flags


def test_hot_key_keeps_bounded_buffers(spark):
    """A key repeated far beyond one row per model is reported, not collected."""
    hot = spark.range(5000).select(
        F.lit("hot").alias("window_id"), F.lit("a").alias("model"), F.array(F.lit(1.0)).alias("proba")
    )
    with pytest.raises(Exception, match="hot"):
        stacking.stack_matrix(hot, ["a"]).collect()
