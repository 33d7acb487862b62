"""The window contract: required columns, coercion, row rules and dataset expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW_SCHEMA = T.StructType(
    [
        T.StructField("window_id", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("features", T.ArrayType(T.DoubleType()), False),
    ]
)
REQUIRED = tuple(WINDOW_SCHEMA.fieldNames())
NOT_FEATURES = ("window_id", "label")
UNIT_METRICS = (
    "train_accuracy",
    "val_accuracy",
    "accuracy",
    "precision",
    "recall",
    "f1_score",
    "f1",
    "macro_f1",
    "ece",
    "auc",
)


class ContractError(ValueError):
    """A table breaks the window contract."""


def _features_as_doubles(df: DataFrame) -> Column:
    kind = df.schema["features"].dataType
    raw = F.col("features")
    if isinstance(kind, T.StringType):
        return F.from_json(raw, "array<double>")
    if isinstance(kind, VectorUDT):
        return vector_to_array(raw)
    if isinstance(kind, T.ArrayType):
        return raw.try_cast("array<double>")
    raise ContractError(f"features must be an array, a vector or JSON text, not {kind.simpleString()}")


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {', '.join(missing)}")


def conform(df: DataFrame) -> DataFrame:
    """Coerce the required columns, contract columns first; other columns pass through."""
    require_columns(df)
    extra = [c for c in df.columns if c not in REQUIRED]
    return df.select(
        F.col("window_id").cast("string").alias("window_id"),
        F.col("label").cast("string").alias("label"),
        _features_as_doubles(df).alias("features"),
        *extra,
    )


def wide_to_features(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES) -> DataFrame:
    """Gather every column outside ``exclude`` into ``features``, in table order."""
    names = [c for c in df.columns if c not in exclude]
    kept = [c for c in df.columns if c in exclude]
    return df.select(*kept, F.array(*[F.col(c).cast("double") for c in names]).alias("features"))


def with_features(df: DataFrame) -> DataFrame:
    """Scoring input: the ``features`` column when there is one, else the wide form."""
    if "features" not in df.columns:
        return wide_to_features(df)
    others = [c for c in df.columns if c != "features"]
    return df.select(*others, _features_as_doubles(df).alias("features"))


def parsed(df: DataFrame) -> DataFrame:
    """Required columns with the coerced features beside the raw ones, parsed once per row."""
    require_columns(df)
    return df.select(*REQUIRED, _features_as_doubles(df).alias("_parsed"))


def _rules(flag_nan: bool) -> list[tuple[str, Column]]:
    parsed = F.col("_parsed")
    rules = [
        ("missing_window_id", F.col("window_id").isNull()),
        ("missing_label", F.col("label").isNull()),
        ("missing_features", F.col("features").isNull()),
        ("unreadable_features", F.col("features").isNotNull() & parsed.isNull()),
        ("non_numeric_feature", F.coalesce(F.exists(parsed, lambda v: v.isNull()), F.lit(False))),
    ]
    if flag_nan:
        rules.append(("nan_feature", F.coalesce(F.exists(parsed, F.isnan), F.lit(False))))
    return rules


def violations(df: DataFrame, flag_nan: bool = False) -> DataFrame:
    """One row ``(window_id, rule)`` for each broken row rule; narrow, no shuffle."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in _rules(flag_nan)]))
    return parsed(df).select(F.col("window_id").cast("string"), F.explode(broken).alias("rule"))


def violation_counts(df: DataFrame, flag_nan: bool = False) -> DataFrame:
    """One row: how many rows break each rule, in a single pass."""
    return parsed(df).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(test).alias(name) for name, test in _rules(flag_nan)],
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids held by more than one row. Counts combine before the shuffle, so a hot id is cheap."""
    return df.groupBy("window_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def feature_dimension(df: DataFrame) -> DataFrame:
    """One row telling whether all windows have the same number of features."""
    n = F.size("features")
    return df.agg(F.min(n).alias("min_dim"), F.max(n).alias("max_dim")).select(
        "min_dim", "max_dim", (F.col("min_dim") == F.col("max_dim")).alias("uniform")
    )


def check(df: DataFrame) -> bool:
    """Does the table satisfy the contract? Boolean twin of :func:`validate`."""
    try:
        validate(df)
    except ContractError:
        return False
    return True


def rule_measures() -> list[Column]:
    """Aggregates over parsed rows: broken rules and the range of feature lengths."""
    length = F.size("_parsed")
    return [
        *[F.count_if(test).alias(name) for name, test in _rules(flag_nan=False)],
        F.min(length).alias("low"),
        F.max(length).alias("high"),
    ]


def conformed(rows: DataFrame) -> DataFrame:
    """The contract's columns of parsed rows."""
    return rows.select(
        F.col("window_id").cast("string").alias("window_id"),
        F.col("label").cast("string").alias("label"),
        F.col("_parsed").alias("features"),
    )


def raise_problems(counts: dict[str, int | None], duplicates: bool) -> None:
    """:class:`ContractError` naming what the measures and a look at the ids found wrong."""
    problems = {name: counts[name] for name, _ in _rules(flag_nan=False) if counts[name]}
    if not problems and counts["low"] != counts["high"]:
        problems["ragged_features"] = f"{counts['low']}..{counts['high']}"
    if not problems and duplicates:
        problems["duplicate_window_id"] = "yes"
    if problems:
        raise ContractError("; ".join(f"{name}: {n}" for name, n in problems.items()))


def is_sound(rows: DataFrame) -> bool:
    """Do conformed rows satisfy every rule, with one width and no id twice?"""
    length = F.size("features")
    bad = (
        F.col("window_id").isNull()
        | F.col("label").isNull()
        | F.col("features").isNull()
        | F.coalesce(F.exists("features", lambda v: v.isNull()), F.lit(False))
    )
    found = rows.agg(F.count_if(bad).alias("bad"), F.min(length).alias("low"), F.max(length).alias("high")).first()
    return not found["bad"] and found["low"] == found["high"] and duplicate_ids(rows).isEmpty()


def validate(df: DataFrame) -> DataFrame:
    """Conformed table, or :class:`ContractError` naming what is wrong.

    One pass over the rows counts every broken rule and the range of feature lengths; a second,
    reading only the ids, looks for duplicates.
    """
    counts = parsed(df).agg(*rule_measures()).first().asDict()
    broken = any(counts[name] for name, _ in _rules(flag_nan=False)) or counts["low"] != counts["high"]
    raise_problems(counts, not broken and not duplicate_ids(df).isEmpty())
    return conform(df)


def profile(df: DataFrame) -> DataFrame:
    """Row count, column count and column names."""
    names = ",".join(df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(names).alias("columns")
    )


def expectations(
    df: DataFrame,
    num_rows: int | None = None,
    num_cols: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per stated expectation: ``(check, expected, actual, ok)``."""
    wanted = []
    if num_rows is not None:
        wanted.append(("num_rows", str(num_rows), F.col("n_rows").cast("string")))
    if num_cols is not None:
        wanted.append(("num_cols", str(num_cols), F.col("n_cols").cast("string")))
    if columns is not None:
        wanted.append(("columns", ",".join(columns), F.col("columns")))
    if not wanted:
        raise ValueError("state at least one expectation")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"), F.lit(expected).alias("expected"), actual.alias("actual")
            )
            for name, expected, actual in wanted
        ]
    )
    return profile(df).select(F.inline(rows)).withColumn("ok", F.col("expected") == F.col("actual"))


def _fold_metric(metric: str):
    def entry(detail: Column) -> Column:
        name = F.concat_ws(" ", F.lit("fold"), detail["fold"].cast("string"), F.lit(metric))
        return F.struct(name.alias("metric"), detail[metric].cast("double").alias("value"))

    return entry


def metric_range_violations(
    df: DataFrame, metrics: Sequence[str] = UNIT_METRICS, key: str = "model", custom: str | None = "custom_metrics"
) -> DataFrame:
    """Metrics outside [0, 1] as ``(key, metric, value)``; a missing value is allowed.

    Looked at are the columns named in ``metrics``, the entries of a map column ``custom`` and the
    per-fold records in ``fold_details``, where the table has them; these last are named
    ``fold <n> <metric>``.
    """
    entry = "array<struct<metric: string, value: double>>"
    found = [
        F.array(F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")))
        for m in metrics
        if m in df.columns
    ]
    if custom is not None and custom in df.columns:
        found.append(
            F.transform(
                F.map_entries(custom),
                lambda e: F.struct(e["key"].cast("string").alias("metric"), e["value"].cast("double").alias("value")),
            )
        )
    if "fold_details" in df.columns:
        inner = [f for f in df.schema["fold_details"].dataType.elementType.fieldNames() if f in metrics]
        found += [F.transform("fold_details", _fold_metric(m)) for m in inner]
    if not found:
        return df.select(key, F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")).where("false")
    some = [F.coalesce(x.cast(entry), F.array().cast(entry)) for x in found]
    long = df.select(key, F.inline(F.concat(*some)))
    return long.where(F.col("value").isNotNull() & ~F.col("value").between(0.0, 1.0))
