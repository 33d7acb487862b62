"""Readers and writers for every table the jobs exchange.

All tables live under one base URI. Those that are replaced as a whole are snapshots behind a pointer (see
:mod:`foldstack.sources.snapshots`), under these names::

    train                        windows (parquet)
    split/seed=<s>/k=<k>         fold of each window, and the split's boundaries (parquet)
    oof/model=<m>/seed=<s>       out-of-fold probabilities (parquet)
    model/<name>                 fitted pipeline
    metrics/<name>               metrics record (JSON)
    manifest                     artifact hashes and header

and beside them::

    models/<name>/confusion      confusion matrix (CSV)
    confusion                    confusion matrix of the last evaluated model (CSV)
    runs                         one row per evaluation
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstack.operators.contract import WINDOW_SCHEMA
from foldstack.operators.splits import RankedSplit, Split
from foldstack.sources import snapshots
from foldstack.sources.scratch import exists

FORMATS = ("csv", "parquet", "json")

_FOLD_DETAIL = T.StructType(
    [
        T.StructField("fold", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
    ]
)
METRICS_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("cv_folds", T.IntegerType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("macro_f1", T.DoubleType()),
        T.StructField("ece", T.DoubleType()),
        T.StructField("logloss", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("fold_details", T.ArrayType(_FOLD_DETAIL)),
    ]
)
OOF_SCHEMA = T.StructType(
    [
        T.StructField("window_id", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("proba", T.ArrayType(T.DoubleType())),
        T.StructField("model", T.StringType()),
        T.StructField("seed", T.LongType()),
    ]
)
RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("git_sha", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("duration", T.DoubleType()),
    ]
)


TRAIN = "train"


def split_key(seed: int, k: int) -> str:
    return f"split/seed={seed}/k={k}"


def oof_key(model: str, seed: int) -> str:
    return f"oof/model={model}/seed={seed}"


def model_key(name: str) -> str:
    return f"model/{name}"


def metrics_key(name: str) -> str:
    return f"metrics/{name}"


def has(spark: SparkSession, base: str, what: str) -> bool:
    return snapshots.current(spark, base, what) is not None


def read_dataset(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Raw table in one of the declared formats; CSV carries features as JSON text."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    if fmt == "parquet":
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    if fmt == "json":
        return spark.read.schema(schema or WINDOW_SCHEMA).json(path)
    text = schema or "window_id string, label string, features string"
    return spark.read.schema(text).option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")
    if fmt == "csv" and "features" in df.columns:
        df = df.withColumn("features", F.to_json("features"))
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def windows_and_version(spark: SparkSession, base: str) -> tuple[DataFrame, str]:
    """The training table and its version, of one and the same snapshot."""
    found = snapshots.current(spark, base, TRAIN)
    if found is None:
        raise FileNotFoundError(f"no training table under {base}: run ingest first")
    return spark.read.schema(WINDOW_SCHEMA).parquet(found.path), found.version


def read_windows(spark: SparkSession, base: str) -> DataFrame:
    return windows_and_version(spark, base)[0]


def write_windows(df: DataFrame, base: str) -> None:
    staged = staging_path(base)
    df.write.parquet(staged)
    promote(df.sparkSession, staged, base)


def staging_path(base: str) -> str:
    return snapshots.new_folder(base, TRAIN)


def promote(spark: SparkSession, staged: str, base: str) -> None:
    """Make a staged table the training table; table and version change together."""
    mark = F.sum(F.xxhash64("window_id", "label").cast("decimal(38,0)")).cast("string")
    narrow = spark.read.schema(WINDOW_SCHEMA).parquet(staged).select("window_id", "label")
    # Its version: the rows and an order-free sum over id and label.
    row = narrow.agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), mark).alias("version")).first()
    snapshots.point(spark, base, TRAIN, staged, row["version"])


def discard(spark: SparkSession, path: str) -> None:
    snapshots.remove(spark, path)


def marked_version(spark: SparkSession, base: str, what: str) -> str | None:
    """Which version of the training table ``what`` was made from."""
    found = snapshots.current(spark, base, what)
    return None if found is None else found.version


def table_version(spark: SparkSession, base: str) -> str:
    return windows_and_version(spark, base)[1]


def require_version(spark: SparkSession, base: str, what: str) -> None:
    """Raise if ``what`` was made from another version of the training table.

    Tables stored by other means carry no mark and are left to the checks by id.
    """
    made_from = marked_version(spark, base, what)
    if made_from is not None and made_from != table_version(spark, base):
        raise StaleTable(f"{what} under {base} belongs to another version of the training table: make it again")


class StaleTable(ValueError):
    """A stored table was made from another version of the training table."""


def save_split(split: Split | RankedSplit, windows: DataFrame, base: str, version: str | None = None) -> None:
    """Persist the fold of every window, for joins by id, and the boundaries of a split that has some."""
    spark = windows.sparkSession

    def write(folder: str) -> None:
        split.assign(windows.select("window_id", "label")).write.parquet(f"{folder}/folds")
        if isinstance(split, Split):
            split.table(spark).coalesce(1).write.parquet(f"{folder}/bounds")

    snapshots.publish(spark, base, split_key(split.seed, split.parts), write, version)


def has_split(spark: SparkSession, base: str, seed: int, k: int) -> bool:
    return has(spark, base, split_key(seed, k))


def _split_folder(spark: SparkSession, base: str, seed: int, k: int) -> str:
    found = snapshots.current(spark, base, split_key(seed, k))
    if found is None:
        raise FileNotFoundError(f"no folds for seed={seed} k={k} under {base}")
    return found.path


def load_split(spark: SparkSession, base: str, seed: int, k: int) -> Split | RankedSplit:
    """Boundaries of a stored split, one row per class, or its folds where it has no boundaries."""
    folder = _split_folder(spark, base, seed, k)
    if not exists(spark, f"{folder}/bounds"):
        return RankedSplit(seed, k, _folds_in(spark, folder))
    rows = spark.read.parquet(f"{folder}/bounds").collect()
    return Split(seed, k, {r["label"]: list(r["bounds"]) for r in sorted(rows, key=lambda r: r["label"])})


def _folds_in(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/folds").select("window_id", "label", "fold")


def load_folds(spark: SparkSession, base: str, seed: int, k: int) -> DataFrame:
    return _folds_in(spark, _split_folder(spark, base, seed, k))


def save_oof(oof: DataFrame, base: str, version: str | None = None) -> None:
    """Write out-of-fold rows; only the (model, seed) pairs present are replaced, each at once."""
    spark, folder = oof.sparkSession, snapshots.new_folder(base, "oof")
    oof.select(*OOF_SCHEMA.fieldNames()).write.partitionBy("model", "seed").parquet(folder)
    written = spark.read.schema(OOF_SCHEMA).parquet(folder)
    for r in written.select("model", "seed").distinct().collect():  # one row per model and seed
        part = f"{folder}/model={escaped(r['model'])}/seed={r['seed']}"
        snapshots.point(spark, base, oof_key(r["model"], r["seed"]), part, version)


def escaped(value: str) -> str:
    """A model's name as a partition folder is called."""
    return "".join(c if c.isalnum() or c in "_-. ,@" else f"%{ord(c):02X}" for c in value)


def has_oof(spark: SparkSession, base: str, model: str, seed: int) -> bool:
    return has(spark, base, oof_key(model, seed))


def load_oof(spark: SparkSession, base: str, models: list[str], seed: int) -> DataFrame:
    """Rows of these models; of others nothing is read."""
    parts, inner = [], T.StructType([f for f in OOF_SCHEMA if f.name not in ("model", "seed")])
    for model in models:
        found = snapshots.current(spark, base, oof_key(model, seed))
        if found is None:
            raise FileNotFoundError(f"no out-of-fold rows for model={model} seed={seed} under {base}")
        rows = spark.read.schema(inner).parquet(found.path)
        parts.append(rows.withColumn("model", F.lit(model)).withColumn("seed", F.lit(seed).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def save_model(model: PipelineModel, base: str, name: str, version: str | None = None) -> None:
    spark = SparkSession.active()
    snapshots.publish(spark, base, model_key(name), lambda folder: model.write().save(folder), version)


def load_model(spark: SparkSession, base: str, name: str) -> PipelineModel:
    found = snapshots.current(spark, base, model_key(name))
    if found is None:
        raise FileNotFoundError(f"no model {name} under {base}: run train for {name} first")
    return PipelineModel.load(found.path)


def save_metrics(record: DataFrame, base: str, name: str) -> None:
    """``record`` holds one row; columns it lacks stay null in the shared schema."""
    filled = [
        (F.col(f.name) if f.name in record.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in METRICS_SCHEMA
    ]
    row = record.select(*filled).coalesce(1)
    snapshots.publish(record.sparkSession, base, metrics_key(name), lambda folder: row.write.json(folder))


def load_metrics(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    """Metrics records of those models that have one."""
    found = [snapshots.current(spark, base, metrics_key(n)) for n in names]
    paths = [f.path for f in found if f is not None]
    if not paths:
        return spark.createDataFrame([], METRICS_SCHEMA)
    return spark.read.schema(METRICS_SCHEMA).json(paths)


def save_confusion(matrix: DataFrame, base: str, name: str) -> None:
    """One row per class; written for the model and as the latest matrix.

    Columns are ``pred_0 ..`` in class order, which is the order of the rows, so labels of any
    text stay values.
    """
    ordered = matrix.orderBy("actual").coalesce(1)
    for path in (f"{base}/confusion", f"{base}/models/{name}/confusion"):
        ordered.write.mode("overwrite").option("header", True).csv(path)


def append_run(run: DataFrame, base: str) -> None:
    run.select(*RUNS_SCHEMA.fieldNames()).coalesce(1).write.mode("append").parquet(f"{base}/runs")


def read_runs(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(f"{base}/runs")


def runs_as_text(runs: DataFrame) -> DataFrame:
    """Run log as exported: four decimals for scores, two for seconds."""
    return runs.select(
        "run_id",
        "model",
        "git_sha",
        F.format_string("%.4f", "accuracy").alias("accuracy"),
        F.format_string("%.4f", "f1").alias("f1"),
        F.format_string("%.2f", "duration").alias("duration"),
    )


def write_predictions(pred: DataFrame, path: str) -> DataFrame:
    """Write as CSV and return the written table."""
    pred.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return pred.sparkSession.read.schema(pred.schema).option("header", True).option("escape", '"').csv(path)
