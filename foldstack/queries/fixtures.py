"""Engine inputs derived from the shared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstack.functions.arrays import argmax, normalise
from foldstack.operators.splits import assign_folds

# The three pseudo models deal all embedding positions to ten classes, so many
# neighbours at a time.
SLICES = {"m0": 1, "m1": 7, "m2": 3}
POSITIONS = 64
N_CLASSES = 10
CLASSES = [f"c{i}" for i in range(N_CLASSES)]
FLAGS = ["A", "N", "R"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def round6(value: Column) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 16 steps x 4 channels in ten classes."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("window_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def wide_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Many windows of four numeric columns in three classes of a third each."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("window_id"),
        F.col("l_returnflag").alias("label"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
    )


def large_windows(spark: SparkSession, sf: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return wide_windows(spark, sf).select("window_id", "label", F.array(*values).alias("features"))


def large_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three-class probabilities for every line item."""
    source = table(spark, sf, "lineitem")
    weights = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12)
    flags = F.array(*[F.lit(x) for x in FLAGS])
    return source.select(
        F.col("l_returnflag").alias("actual"),
        (F.array_position(flags, F.col("l_returnflag")) - 1).cast("int").alias("y"),
        normalise(weights).alias("proba"),
        F.col("l_linestatus").alias("model"),
    )


def binary_predictions(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    p1 = (F.col("n_chars") % 1001) / 1000.0
    return scored.select("doc_id", F.col("quality").alias("y"), F.array(1 - p1, p1).alias("proba"))


def positions(step: int, code: int) -> list[int]:
    """Embedding positions, from 1, whose sizes add up to a class's pseudo score."""
    return [p for p in range(1, POSITIONS + 1) if (p - 1) // step % N_CLASSES == code]


def _scored(spark: SparkSession, sf: str, step: int) -> DataFrame:
    sizes = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v))
    sums = [
        reduce(lambda a, b: a + b, [F.get(sizes, F.lit(p - 1)) for p in positions(step, c)])
        for c in range(N_CLASSES)
    ]
    values = F.array(*sums)
    source = table(spark, sf, "embeddings").select("vec_id", "label", values.alias("_a"))
    return source.select(
        F.col("vec_id").cast("string").alias("window_id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("actual"),
        F.concat(F.lit("c"), argmax(F.col("_a")).cast("string")).alias("predicted"),
        F.col("label").alias("y"),
        normalise(F.col("_a")).alias("proba"),
    )


def multiclass_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, 1)


def folded_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Multiclass predictions with the fold of each window."""
    return assign_folds(multiclass_predictions(spark, sf))


def oof_long(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold rows of three pseudo models."""
    parts = [
        _scored(spark, sf, start).withColumn("model", F.lit(model))
        for model, start in SLICES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def order_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items labelled by their order: tens of thousands of classes of a few rows."""
    return large_windows(spark, sf).withColumn("label", F.substring_index("window_id", "-", 1))


def faulty_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold rows with foreign windows (every id doubled) and second rows (low quality again)."""
    rows = document_oof(spark, sf).select("window_id", "proba")
    doubled = rows.withColumn("window_id", (F.col("window_id").cast("long") * 2).cast("string"))
    again = rows.where(F.get("proba", F.lit(0)) == 0)
    named = [
        ("doubled", doubled),
        ("repeated", rows.unionAll(again)),
        ("plain", rows),
    ]
    return reduce(DataFrame.unionAll, [r.withColumn("model", F.lit(n)) for n, r in named])


def json_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows as raw windows with every kind of unusable value."""
    kind = F.col("event_type")
    value = F.col("value").cast("string")
    features = (
        F.when(kind == "click", F.col("props"))
        .when(kind == "purchase", F.concat(F.lit("["), value, F.lit(",null]")))
        .when(kind.isin("view", "error"), F.concat(F.lit("["), value, F.lit("]")))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("window_id"),
        F.when(kind != "error", kind).alias("label"),
        features.alias("features"),
    )


def document_folds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("window_id"), F.col("lang").alias("label")
    )


def document_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as out-of-fold rows; documents without labels have none."""
    sources = table(spark, sf, "documents").select("doc_id", "source")
    return (
        table(spark, sf, "labels")
        .join(sources, "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("window_id"),
            F.col("source").alias("model"),
            F.array("quality", "toxic").cast("array<double>").alias("proba"),
        )
    )


def recorded_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Expected hash of each document's text."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("rel_path"),
        F.sha2("text", 256).alias("sha256"),
    )


def current_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of the labelled documents, the low-quality ones altered."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    return labelled.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("rel_path"),
        F.upper(F.sha2(text, 256)).alias("sha256"),
    )


def steps_long(df: DataFrame, steps: Column) -> DataFrame:
    """``(window_id, t, c, value)`` from an array of steps."""
    by_step = df.select("window_id", F.posexplode(steps).alias("t", "row"))
    return by_step.select("window_id", "t", F.posexplode("row").alias("c", "x")).select(
        "window_id", "t", "c", round6(F.col("x")).alias("value")
    )


def channels_long(df: DataFrame, channels: Column) -> DataFrame:
    return df.select("window_id", F.posexplode(channels).alias("c", "x")).select(
        "window_id", "c", round6(F.col("x")).alias("value")
    )
