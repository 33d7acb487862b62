"""Everything that is one row per class: distributions, codes and weights.

Nothing here bounds the number of classes. A label may hold a third of all rows, so a wide table
is never shuffled by label alone: within ``MAX_CLASSES`` rows the class table is broadcast, beyond
that the join is salted for the classes that hold many rows. Fitting a classifier does need a bound, which :func:`class_list` checks.
"""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstack.sources.scratch import scratch_uri

MAX_CLASSES = 10_000
SALTS = 64


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_rank``, its 0-based place in the order, without gathering it in one task.

    Rows are range sorted and written; places add up from the sizes of the ranges.
    """
    spark = df.sparkSession
    path = scratch_uri(spark, "ranked")
    df.orderBy(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranked = spark.read.parquet(path)
    sizes = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        ranked.join(F.broadcast(sizes.select("_part", before)), "_part")
        .withColumn("_rank", place + F.col("_before"))
        .drop("_part", "_before")
    )


def class_table(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, code, n)`` with codes from 0 in sorted label order."""
    ranked = global_rank(label_distribution(df, label), label)
    return ranked.select(label, F.col("_rank").cast("int").alias("code"), "n")


def class_list(df: DataFrame, label: str = "label", limit: int = MAX_CLASSES) -> list[str]:
    """Sorted distinct labels on the driver; refuses label sets no classifier could hold."""
    rows = df.select(label).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct labels: not a class column")
    return sorted(row[0] for row in rows)


def join_per_class(
    df: DataFrame,
    per_class: DataFrame,
    on: str = "label",
    how: str = "left",
    limit: int = MAX_CLASSES,
    salts: int = SALTS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join a row-per-class table without shuffling ``df`` by its skewed label.

    Beyond ``limit`` rows only classes with over ``1 / limit`` of the rows are salted, fewer than ``limit`` of them, so
    the class table grows by less than ``limit * salts`` rows. ``sizes (label, n)`` are counted if not given.
    """
    rows = per_class.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        small = df.sparkSession.createDataFrame(rows)
        return df.join(F.broadcast(small), on, how)
    sizes = label_distribution(df, on) if sizes is None else sizes
    large = heavy_classes(sizes, limit, on).withColumn("_large", F.lit(True))
    key = ["window_id"] if "window_id" in df.columns else df.columns
    spread = F.when(F.col("_large"), F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int")).otherwise(0)
    last = F.when(F.col("_large"), salts - 1).otherwise(0)
    copies = per_class.join(F.broadcast(large), on, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_large")
    salted = df.join(F.broadcast(large), on, "left").withColumn("_salt", spread).drop("_large")
    # Merged, as the size of a table of so many classes is not known well enough to broadcast it.
    return salted.join(copies.hint("merge"), [on, "_salt"], how).drop("_salt")


def heavy_classes(sizes: DataFrame, limit: int = MAX_CLASSES, label: str = "label") -> DataFrame:
    """The labels of ``sizes (label, n)`` with over ``1 / limit`` of all rows: fewer than ``limit``, fetched once."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    found = sizes.where(F.col("n") * limit > total).select(label).toArrow()
    return sizes.sparkSession.createDataFrame(found)


def label_codes(df: DataFrame) -> DataFrame:
    """Attach the class code to each row."""
    table = class_table(df)
    return join_per_class(df, table.select("label", "code"), sizes=table.select("label", "n"))


def index_labels(df: DataFrame, labels: list[str], output: str = "y") -> DataFrame:
    """Code labels with the ML indexer, so the column carries the full class list."""
    indexer = StringIndexerModel.from_labels(
        labels, inputCol="label", outputCol=output, handleInvalid="error"
    )
    return indexer.transform(df)


def decode_labels(df: DataFrame, labels: list[str], column: str, output: str) -> DataFrame:
    return IndexToString(inputCol=column, outputCol=output, labels=labels).transform(df)


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights ``N / (C * n_class)``, one row per class."""
    sizes = label_distribution(df)
    total = sizes.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    weight = F.lit(total["rows"] or 0) / (F.lit(total["classes"]) * F.col("n"))
    return sizes.select("label", "n", weight.alias("weight"))


def class_summary(df: DataFrame) -> DataFrame:
    """One row: the sorted class names, a single text by definition, and how many there are."""
    return label_distribution(df).agg(
        F.array_join(F.sort_array(F.collect_list("label")), ",").alias("classes"),
        F.count("label").alias("n_classes"),
    )
