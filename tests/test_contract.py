import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldstack.operators import contract

ROW = "window_id string, label string, features array<double>"


def _json(spark, rows):
    return spark.createDataFrame(rows, "window_id string, label string, features string")


def test_valid_rows_pass_and_types_are_coerced(spark):
    df = spark.createDataFrame(
        [(1, "class_A", [0.1, 0.2, 0.3], "kept")],
        "window_id int, label string, features array<float>, extra string",
    )
    out = contract.validate(df)
    assert dict(out.dtypes) == {
        "window_id": "string",
        "label": "string",
        "features": "array<double>",
        "extra": "string",
    }
    assert contract.check(df)


def test_vectors_become_arrays(spark):
    df = spark.createDataFrame([("1", "a", [1.0, 2.0])], ROW)
    vectors = df.withColumn("features", array_to_vector("features"))
    assert contract.conform(vectors).first()["features"] == [1.0, 2.0]


def test_non_numeric_features_are_rejected(spark):
    df = spark.createDataFrame(
        [("3", "class_A", ["not", "numeric"])], "window_id string, label string, features array<string>"
    )
    assert not contract.check(df)
    with pytest.raises(contract.ContractError, match="non_numeric_feature"):
        contract.validate(df)


def test_row_rules(spark):
    df = _json(
        spark,
        [
            ("ok", "a", "[1,2]"),
            (None, "a", "[1,2]"),
            ("no label", None, "[1,2]"),
            ("no features", "a", None),
            ("text", "a", "bad"),
            ("words", "a", '["not","numeric"]'),
            ("gap", "a", "[1,null]"),
            ("nan", "a", "[NaN,1]"),
        ],
    )
    found = {(r["window_id"], r["rule"]) for r in contract.violations(df, flag_nan=True).collect()}
    assert found == {
        (None, "missing_window_id"),
        ("no label", "missing_label"),
        ("no features", "missing_features"),
        ("text", "unreadable_features"),
        ("words", "unreadable_features"),
        ("gap", "non_numeric_feature"),
        ("nan", "nan_feature"),
    }
    counts = contract.violation_counts(df).first()
    assert counts["n_rows"] == 8 and counts["unreadable_features"] == 2
    assert "nan_feature" not in counts.asDict()


def test_missing_columns(spark):
    with pytest.raises(contract.ContractError, match="label, features"):
        contract.validate(spark.range(1).select(F.col("id").alias("window_id")))


def test_duplicate_ids_are_rejected(spark):
    df = spark.createDataFrame([("1", "a", [1.0]), ("1", "b", [2.0])], ROW)
    assert contract.duplicate_ids(df).first()["copies"] == 2
    with pytest.raises(contract.ContractError, match="duplicate_window_id"):
        contract.validate(df)


def test_ragged_features_are_rejected(spark):
    df = spark.createDataFrame([("1", "a", [1.0, 2.0, 3.0]), ("2", "b", [1.0, 2.0, 3.0, 4.0])], ROW)
    assert not contract.feature_dimension(df).first()["uniform"]
    with pytest.raises(contract.ContractError, match="ragged_features: 3..4"):
        contract.validate(df)


def test_wide_form_for_scoring(spark):
    df = spark.createDataFrame([("1", 2, 3.5)], "window_id string, f1 int, f2 double")
    assert contract.with_features(df).first()["features"] == [2.0, 3.5]
    ready = spark.createDataFrame([("1", "a", [1.0])], ROW)
    assert contract.with_features(ready).first()["features"] == [1.0]


def test_expectations(spark):
    df = spark.createDataFrame([("1", "a", [1.0])], ROW)
    rows = contract.expectations(df, num_rows=2, num_cols=3).collect()
    assert [(r["check"], r["ok"]) for r in rows] == [("num_rows", False), ("num_cols", True)]
    with pytest.raises(ValueError):
        contract.expectations(df)


def test_metric_ranges(spark):
    df = spark.createDataFrame(
        [("m", 0.5, 1.2), ("n", None, -0.1), ("o", 0.0, 1.0)], "model string, accuracy double, auc double"
    )
    bad = {(r["model"], r["metric"]) for r in contract.metric_range_violations(df).collect()}
    assert bad == {("m", "auc"), ("n", "auc")}


def test_metric_ranges_of_maps_folds_and_own_names(spark):
    df = spark.createDataFrame(
        [("m", 1.2, {"lift": 3.0, "share": 0.5}, [(0, 0.5, -0.1)]), ("n", None, None, None)],
        "model string, f1 double, custom_metrics map<string,double>, fold_details array<struct<fold: int, accuracy: double, recall: double>>",
    )
    bad = {(r["model"], r["metric"]) for r in contract.metric_range_violations(df).collect()}
    assert bad == {("m", "f1"), ("m", "lift"), ("m", "fold 0 recall")}
    assert contract.metric_range_violations(df.select("model")).count() == 0
