"""Classification and calibration metrics as aggregates.

Rows are scanned once: a map-side combined count by (actual, predicted[, bin]) shrinks any
number of predictions to a few cells, and every metric is computed from those cells.

A prediction table holds ``actual`` and ``predicted`` (labels or codes) and, for calibration,
``y`` (class code) and ``proba``. ``by`` names grouping columns such as model and fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstack.functions.arrays import argmax, confidence

# Number of calibration bins and the clipping constant of log-loss.
N_BINS = 10
LOG_LOSS_EPS = 2.220446049250313e-16


def accuracy(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("predicted") == F.col("actual")).cast("double")
    return pred.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confusion_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Non-empty cells ``(by.., actual, predicted, n)``."""
    return pred.groupBy(*by, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def cells_long(cells: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """All cells, zeros included, as ``(by.., actual, predicted, n)``.

    Labels stay values from end to end, so any text may be a label. Every class is an actual one
    even when it never occurs: each cell also stands for its predicted class.
    """
    kind = cells.schema["predicted"].dataType
    listed = F.array(*[F.lit(c) for c in classes]).cast(T.ArrayType(kind))
    seen = F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("actual")
    grid = cells.select(*by, seen).distinct().select(*by, "actual", F.explode(listed).alias("predicted"))
    blank = grid.withColumn("n", F.lit(0).cast("long"))
    counted = cells.select(*by, "actual", "predicted", "n").where(F.array_contains(listed, F.col("predicted")))
    return counted.unionByName(blank).groupBy(*by, "actual", "predicted").agg(F.sum("n").alias("n"))


def cells_wide(
    cells: DataFrame, classes: Sequence, by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Square matrix: one row per class as ``actual``, one column per predicted class.

    Columns are named after the classes unless ``names`` gives other ones by position.
    """
    places = {c: i for i, c in enumerate(classes)}
    numbered = cells_long(cells, classes, by).withColumn(
        "_at", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("predicted")).cast("int") - 1
    )
    wide = numbered.groupBy(*by, "actual").pivot("_at", list(places.values())).agg(F.sum("n"))
    return wide.na.fill(0).toDF(*by, "actual", *(names or [str(c) for c in classes]))


def confusion_wide(pred: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    return cells_wide(confusion_counts(pred, by), classes, by)


def confusion_long(pred: DataFrame, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """All cells, zeros included, as ``(by.., actual, predicted, n)``."""
    return cells_long(confusion_counts(pred, by), classes, by)


def class_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of each class that is actual or predicted; zero when undefined."""
    n = F.col("n")
    none = F.lit(0).cast("long")
    on_truth = F.struct(
        F.col("actual").alias("class"),
        n.alias("support"),
        none.alias("chosen"),
        F.when(F.col("actual") == F.col("predicted"), n).otherwise(none).alias("hits"),
    )
    on_guess = F.struct(
        F.col("predicted").alias("class"), none.alias("support"), n.alias("chosen"), none.alias("hits")
    )
    per_class = (
        cells.select(*by, F.inline(F.array(on_truth, on_guess)))
        .groupBy(*by, "class")
        .agg(F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hits").alias("hits"))
    )
    return per_class.select(
        *by,
        "class",
        "support",
        _ratio(F.col("hits"), F.col("chosen")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("chosen") + F.col("support")).alias("f1"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def report(cells: DataFrame, average: str, by: Sequence[str] = ()) -> DataFrame:
    """Averaged precision, recall and F1: ``macro`` over classes or ``weighted`` by support."""
    return report_by_fold(cells, average, by).select(*by, "precision", "recall", "f1")


def report_by_fold(cells: DataFrame, average: str, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Accuracy, averaged precision/recall/F1 and macro F1 of each group of cells."""
    if average not in ("macro", "weighted"):
        raise ValueError(f"average must be macro or weighted, not {average!r}")
    support = F.col("support").cast("double")
    weight = F.lit(1.0) if average == "macro" else support
    return (
        class_report(cells, by)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(F.col("recall") * support), F.sum(support)).alias("accuracy"),
            *[
                F.try_divide(F.sum(F.col(m) * weight), F.sum(weight)).alias(m)
                for m in ("precision", "recall", "f1")
            ],
            F.avg("f1").alias("macro_f1"),
            F.sum("support").alias("n"),
        )
    )


def mean_of_folds(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the fold metrics, each fold counting once."""
    metrics = ("accuracy", "precision", "recall", "f1")
    return per_fold.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("folds")
    )


def calibration_bin(conf: Column, n_bins: int = N_BINS) -> Column:
    """Bin ``i`` covers ``(b[i-1], b[i]]``; 0 and ``n_bins + 1`` are outside every bin."""
    # Same doubles as an evenly spaced grid; a formula on the confidence would round differently.
    step = 1.0 / n_bins
    edges = [i * step for i in range(n_bins)] + [1.0]
    passed = F.lit(0)
    for edge in edges:
        passed = passed + (conf > F.lit(edge)).cast("int")
    return passed


def reliability(pred: DataFrame, n_bins: int = N_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Per bin: rows, mean confidence and accuracy (rows outside every bin keep their count)."""
    conf = confidence(F.col("proba"))
    right = (argmax(F.col("proba")) == F.col("y")).cast("double")
    return (
        pred.select(*by, conf.alias("conf"), right.alias("hit"))
        .groupBy(*by, calibration_bin(F.col("conf"), n_bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("conf").alias("sum_conf"),
            F.sum("hit").alias("sum_hit"),
        )
    )


def ece(pred: DataFrame, n_bins: int = N_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error."""
    inside = F.col("bin").between(1, n_bins)
    gap = F.when(inside, F.abs(F.col("sum_conf") - F.col("sum_hit"))).otherwise(F.lit(0.0))
    return (
        reliability(pred, n_bins, by)
        .groupBy(*by)
        .agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))
    )


def _surprise(eps: float) -> Column:
    truth = F.get(F.col("proba"), F.col("y").cast("int"))
    return -F.ln(F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), truth)))


def log_loss(pred: DataFrame, eps: float = LOG_LOSS_EPS, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood; null when truth and probabilities disagree on class count."""
    per_class = pred.groupBy(*by, "y").agg(
        F.sum(_surprise(eps)).alias("loss"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("proba")).alias("width"),
    )
    same = F.count(F.lit(1)) == F.max("width")
    return per_class.groupBy(*by).agg(
        F.when(same, F.sum("loss") / F.sum("n")).alias("logloss")
    )


def metric_bundle(
    pred: DataFrame,
    by: Sequence[str] = (),
    n_bins: int = N_BINS,
    eps: float = LOG_LOSS_EPS,
) -> DataFrame:
    """Accuracy, macro precision/recall/F1, ECE and log-loss in one linear plan.

    The scan collapses to cells of (y, guess, bin). Each cell then yields one record for its true
    class, one for its predicted class and one for its bin, and all metrics fall out of the sums.
    """
    scored = pred.select(
        *by,
        F.col("y").cast("int").alias("y"),
        argmax(F.col("proba")).alias("guess"),
        confidence(F.col("proba")).alias("conf"),
        F.size("proba").alias("width"),
        _surprise(eps).alias("loss"),
    )
    cells = scored.groupBy(
        *by, "y", "guess", calibration_bin(F.col("conf"), n_bins).alias("bin")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("conf").alias("conf"),
        F.sum("loss").alias("loss"),
        F.max("width").alias("width"),
    )
    n = F.col("n")
    none = F.lit(0).cast("long")
    hits = F.when(F.col("y") == F.col("guess"), n).otherwise(none)
    zero = F.lit(0.0)

    def record(kind, key, support, chosen, conf, loss, right):
        return F.struct(
            F.lit(kind).alias("kind"),
            key.alias("key"),
            support.alias("support"),
            chosen.alias("chosen"),
            conf.alias("conf"),
            loss.alias("loss"),
            right.alias("hits"),
            F.col("width"),
        )

    records = cells.select(
        *by,
        F.inline(
            F.array(
                record("class", F.col("y"), n, none, zero, zero, hits),
                record("class", F.col("guess"), none, n, zero, zero, none),
                record("bin", F.col("bin"), n, none, F.col("conf"), F.col("loss"), hits),
            )
        ),
    )
    sums = records.groupBy(*by, "kind", "key").agg(
        *[F.sum(c).alias(c) for c in ("support", "chosen", "conf", "loss", "hits")],
        F.max("width").alias("width"),
    )
    of_class, of_bin = F.col("kind") == "class", F.col("kind") == "bin"
    inside = of_bin & F.col("key").between(1, n_bins)
    total = F.sum(F.when(of_bin, F.col("support")))
    truth_classes = F.count_if(of_class & (F.col("support") > 0))
    return sums.groupBy(*by).agg(
        F.try_divide(F.sum(F.when(of_bin, F.col("hits"))), total).alias("accuracy"),
        F.avg(F.when(of_class, _ratio(F.col("hits"), F.col("chosen")))).alias("precision"),
        F.avg(F.when(of_class, _ratio(F.col("hits"), F.col("support")))).alias("recall"),
        F.avg(
            F.when(of_class, _ratio(2 * F.col("hits"), F.col("chosen") + F.col("support")))
        ).alias("f1"),
        F.try_divide(
            F.sum(F.when(inside, F.abs(F.col("conf") - F.col("hits"))).otherwise(zero)), total
        ).alias("ece"),
        F.when(
            truth_classes == F.max("width"),
            F.try_divide(F.sum(F.when(of_bin, F.col("loss"))), total),
        ).alias("logloss"),
    )


def best_base(metrics: DataFrame, stacker: str = "stack") -> DataFrame:
    """Stacker against the best base model: F1 gain in points, and whether it is accepted.

    Accepted when F1 gains two points or the stacker's calibration error is at most 0.03.
    """
    is_stack = F.col("model") == stacker
    gain = (F.col("stack_f1") - F.col("best_base_f1")) * 100
    return (
        metrics.agg(
            F.max(F.when(is_stack, F.col("f1"))).alias("stack_f1"),
            F.max(F.when(is_stack, F.col("ece"))).alias("stack_ece"),
            F.coalesce(F.max(F.when(~is_stack, F.col("f1"))), F.lit(0.0)).alias("best_base_f1"),
        )
        .withColumn("gain_points", gain)
        .withColumn(
            "accepted",
            F.coalesce((F.col("gain_points") >= 2.0) | (F.col("stack_ece") <= 0.03), F.lit(False)),
        )
    )
