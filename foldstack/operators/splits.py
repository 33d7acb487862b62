"""Deterministic stratified splits, keyed by ``window_id``.

Within a class, windows are ordered by ``md5(seed:window_id)`` (ties by id) and each fold takes
one contiguous stretch of that order. A fold is therefore a range of sort keys, and the whole
split is described by at most ``k - 1`` boundary keys per class: finding them costs two scans of
two narrow columns, and applying them to the wide table is a plain projection, no shuffle.

Boundaries are found exactly. Sort keys fall into buckets by hash prefix; per-bucket counts say
which bucket holds each boundary rank. Buckets that are still large are cut by further digits,
and only what remains is ranked. No task ever sees a whole class. With too many classes for a
boundary table the same folds come from a two-level rank (:func:`fit_split` chooses).
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldstack.operators.classes import MAX_CLASSES, global_rank, heavy_classes, label_distribution
from foldstack.sources.scratch import scratch_uri

# Default seed and number of folds.
SEED = 1337
FOLDS = 5
BUCKET_DIGITS = 3
#: Boundary keys (classes times cuts) that may be fetched and broadcast, some 100 bytes each.
MAX_BOUNDS = 200_000
#: Rows that a sample keeps of every class in every fold, if there are so many.
SAMPLE_FLOOR = 2
#: Rows of a bucket that are ranked in one task; larger ones are cut by more digits first.
BUCKET_ROWS = 500_000


class TooManyBounds(ValueError):
    """More classes times cuts than a boundary table may hold: rank instead."""


def _check_bounds(classes: int, parts: int) -> None:
    if classes > MAX_CLASSES or classes * (parts - 1) > MAX_BOUNDS:
        raise TooManyBounds(f"{classes} classes in {parts} parts: use assign_folds_by_rank")


def sort_key(seed: int, window_id: str = "window_id") -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(window_id)))
    return F.concat(digest, F.col(window_id))


@dataclass(frozen=True)
class Split:
    """Boundary keys per class. ``bounds[label]`` is sorted; part = bounds at or below the key."""

    seed: int
    parts: int
    bounds: dict[str, list[str]]

    def __post_init__(self):
        _check_bounds(len(self.bounds), self.parts)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per class: ``(label, bounds)``."""
        labels = sorted(self.bounds)
        return spark.createDataFrame(
            pa.table(
                {
                    "label": pa.array(labels, pa.string()),
                    "bounds": pa.array([self.bounds[c] for c in labels], pa.list_(pa.string())),
                }
            )
        )

    def assign(self, df: DataFrame, output: str = "fold") -> DataFrame:
        """Add the fold number. Narrow: the boundary table holds at most ``MAX_BOUNDS`` keys.

        A label the split has never seen raises instead of losing its rows.
        """
        small = self.table(df.sparkSession).select(F.col("label"), F.col("bounds").alias("_bounds"))
        keyed = df.withColumn("_key", sort_key(self.seed))
        joined = keyed.join(F.broadcast(small), "label", "left")
        part = F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))).cast("int")
        unknown = F.raise_error(
            F.concat(F.lit("label not in the stored split: "), F.coalesce("label", F.lit("null")))
        ).cast("int")
        known = F.when(F.col("_bounds").isNotNull(), part).otherwise(unknown)
        kept = [c for c in df.columns if c != output]
        return joined.select(*kept, known.alias(output))


def _bucket_counts(ids: DataFrame, seed: int, digits: int) -> DataFrame:
    """Rows per (label, hash bucket); combined before the shuffle, so tiny after it."""
    keyed = ids.select("label", F.substring(sort_key(seed), 1, digits).alias("bucket"))
    return keyed.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _class_sizes(buckets: DataFrame, parts: int) -> dict[str, int]:
    rows = buckets.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_CLASSES + 1).collect()
    _check_bounds(len(rows), parts)
    by_hash = sorted(rows, key=lambda r: hashlib.md5(r["label"].encode()).hexdigest())
    return {r["label"]: r["n"] for r in by_hash}


def _boundary_keys(
    ids: DataFrame, buckets: DataFrame, seed: int, cuts: dict[str, list[int]], digits: int
) -> dict[str, list[str]]:
    """Sort key of the row at each cut rank, 0-based within its class."""
    spark = ids.sparkSession
    wanted = [(label, rank) for label, ranks in cuts.items() for rank in sorted(set(ranks))]
    if not wanted:
        return {}
    cut_table = spark.createDataFrame(
        pa.table(
            {
                "label": pa.array([w[0] for w in wanted], pa.string()),
                "rank": pa.array([w[1] for w in wanted], pa.int64()),
            }
        )
    )
    # Everything broadcast or fetched here has one row per class and cut: at most MAX_BOUNDS.
    keyed = ids.select("label", sort_key(seed).alias("key"))
    running = Window.partitionBy("label").orderBy("bucket")
    located = (
        buckets.withColumn("start", F.sum("n").over(running) - F.col("n"))
        .join(F.broadcast(cut_table), "label")
        .where("rank >= start and rank < start + n")
        .select("label", "bucket", (F.col("rank") - F.col("start")).alias("offset"), "rank", "n")
        .toArrow()
    )
    while digits < 32 and max(located["n"].to_pylist()) > BUCKET_ROWS:
        targets = spark.createDataFrame(located.rename_columns(["label", "outer", "offset", "rank", "n"]))
        places = targets.select("label", "outer").distinct()
        inside = keyed.withColumn("outer", F.substring("key", 1, digits)).join(
            F.broadcast(places), ["label", "outer"], "left_semi"
        )
        digits = min(digits + BUCKET_DIGITS, 32)
        finer = inside.groupBy("label", "outer", F.substring("key", 1, digits).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n")
        )
        running = Window.partitionBy("label", "outer").orderBy("bucket")
        located = (
            finer.withColumn("start", F.sum("n").over(running) - F.col("n"))
            .join(F.broadcast(targets.drop("n")), ["label", "outer"])
            .where("offset >= start and offset < start + n")
            .select("label", "bucket", (F.col("offset") - F.col("start")).alias("offset"), "rank", "n")
            .toArrow()
        )
    targets = spark.createDataFrame(located).drop("n")
    candidates = keyed.withColumn("bucket", F.substring("key", 1, digits))
    order = Window.partitionBy("label", "bucket").orderBy("key")
    found = (
        candidates.join(F.broadcast(targets), ["label", "bucket"], "left_semi")
        .withColumn("offset", (F.row_number().over(order) - 1).cast("long"))
        .join(F.broadcast(targets), ["label", "bucket", "offset"])
        .select("label", "rank", "key")
        .collect()
    )
    keys = {(r["label"], r["rank"]): r["key"] for r in found}
    return {label: [keys[label, rank] for rank in ranks] for label, ranks in cuts.items()}


def _fit(df: DataFrame, seed: int, parts: int, digits: int, starts_for) -> Split:
    """Find the boundary keys of parts whose first ranks ``starts_for(class sizes)`` gives.

    A start at or below 0 lies under every key; a start past the end of a class is never met.
    """
    ids = df.select("window_id", "label")
    buckets = _bucket_counts(ids, seed, digits).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = _class_sizes(buckets, parts)
        starts = starts_for(sizes)
        inner = {c: [r for r in starts[c] if 0 < r < sizes[c]] for c in sizes}
        cuts = {c: ranks for c, ranks in inner.items() if ranks}
        keys = _boundary_keys(ids, buckets, seed, cuts, digits)
    finally:
        buckets.unpersist()
    empty = {c: [""] * sum(1 for r in starts[c] if r <= 0) for c in sizes}
    return Split(seed, parts, {c: empty[c] + keys.get(c, []) for c in sizes})


def fold_quotas(sizes: dict[str, int], k: int) -> dict[str, list[int]]:
    """Rows per (class, fold): even within one in each class and in total.

    Leftover rows of a class continue round-robin where the previous class stopped; classes come
    in the order of ``md5(label)``, which any number of tasks can follow.
    """
    quotas, offset = {}, 0
    for label, n in sizes.items():
        base, extra = divmod(n, k)
        quotas[label] = [base + ((f - offset) % k < extra) for f in range(k)]
        offset += n
    return quotas


def _starts(quotas: list[int]) -> list[int]:
    return [sum(quotas[: i + 1]) for i in range(len(quotas) - 1)]


def fit_folds(
    df: DataFrame, seed: int = SEED, k: int = FOLDS, digits: int = BUCKET_DIGITS
) -> Split:
    """Stratified k-fold split of ``(window_id, label)``."""
    if k < 2:
        raise ValueError("k must be at least 2")

    def starts(sizes: dict[str, int]) -> dict[str, list[int]]:
        return {label: _starts(quotas) for label, quotas in fold_quotas(sizes, k).items()}

    return _fit(df, seed, k, digits, starts)


def holdout_quotas(sizes: dict[str, int], test_size: float) -> dict[str, int]:
    """Test rows per class by largest remainder, ``ceil(test_size * N)`` in total."""
    total = sum(sizes.values())
    target = math.ceil(test_size * total)
    exact = {c: n * target for c, n in sizes.items()}
    quota = {c: e // total for c, e in exact.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(exact[c] % total), c))
    for c in by_remainder[: target - sum(quota.values())]:
        quota[c] += 1
    return quota


def fit_holdout(
    df: DataFrame, seed: int = SEED, test_size: float = 0.2, digits: int = BUCKET_DIGITS
) -> Split:
    """Stratified train/test split; part 0 is the test set, part 1 the training set."""

    def starts(sizes: dict[str, int]) -> dict[str, list[int]]:
        return {label: [quota] for label, quota in holdout_quotas(sizes, test_size).items()}

    return _fit(df, seed, 2, digits, starts)


def sample_quotas(sizes: dict[str, int], rows: int, floor: int = SAMPLE_FLOOR) -> dict[str, int]:
    """Rows to take of each stratum: its share of ``rows`` by largest remainder, but ``min(n, floor)`` at least."""
    total = sum(sizes.values())
    exact = {c: n * min(rows, total) for c, n in sizes.items()}
    quota = {c: e // total for c, e in exact.items()}
    by_remainder = sorted(sizes, key=lambda c: (-(exact[c] % total), c))
    for c in by_remainder[: min(rows, total) - sum(quota.values())]:
        quota[c] += 1
    return {c: max(q, min(sizes[c], floor)) for c, q in quota.items()}


@dataclass(frozen=True)
class Sample:
    """Rows of each (fold, class): the first so many in order of the seeded hash of the id."""

    split: Split
    quotas: dict[tuple[int, str], int]

    def take(self, df: DataFrame) -> DataFrame:
        """The sampled rows of ``df (window_id, label, fold, ..)``, a narrow filter."""
        marked = df.withColumn("_label", F.col("label")).withColumn("label", _stratum())
        kept = self.split.assign(marked, "_part").where("_part = 0")
        return kept.withColumn("label", F.col("_label")).select(*df.columns)


def _stratum() -> Column:
    return F.concat(F.col("fold").cast("string"), F.lit(":"), F.col("label"))


def fit_sample(df: DataFrame, rows: int, seed: int = SEED, floor: int = SAMPLE_FLOOR) -> Sample:
    """An exact stratified sample of ``df (window_id, label, fold)`` by the boundary search of the splits.

    About ``rows`` rows, each fold and class with its share to within one row, and no class and fold with fewer than
    ``min(n, floor)``: at most ``floor`` more rows for each of them.
    """
    chosen: dict[str, int] = {}

    def starts(sizes: dict[str, int]) -> dict[str, list[int]]:
        chosen.update(sample_quotas(sizes, rows, floor))
        return {c: [q] for c, q in chosen.items()}

    # Folds are ranges of one seeded order; the sample draws from another.
    split = _fit(df.select("window_id", _stratum().alias("label")), -1 - seed, 2, BUCKET_DIGITS, starts)
    parted = {c: c.split(":", 1) for c in chosen}
    return Sample(split, {(int(fold), label): chosen[c] for c, (fold, label) in parted.items()})


def assign_folds(df: DataFrame, seed: int = SEED, k: int = FOLDS) -> DataFrame:
    """``df`` with its fold number, for any number of classes."""
    return fit_split(df, seed, k).assign(df)


@dataclass(frozen=True)
class RankedSplit:
    """Parts by id, for more classes than a boundary table may hold."""

    seed: int
    parts: int
    folds: DataFrame

    def assign(self, df: DataFrame, output: str = "fold") -> DataFrame:
        """Add the part number by id; a window the split has never seen raises."""
        known = self.folds.select("window_id", F.col("fold").alias("_part"))
        unknown = F.raise_error(
            F.concat(F.lit("window not in the split: "), F.coalesce("window_id", F.lit("null")))
        ).cast("int")
        kept = [c for c in df.columns if c != output]
        part = F.when(F.col("_part").isNotNull(), F.col("_part")).otherwise(unknown)
        return df.join(known, "window_id", "left").select(*kept, part.alias(output))


def fit_split(df: DataFrame, seed: int = SEED, k: int = FOLDS) -> Split | RankedSplit:
    """Stratified k-fold split; the same folds whether by boundaries or, beyond their bound, by rank."""
    try:
        return fit_folds(df, seed, k)
    except TooManyBounds:
        return RankedSplit(seed, k, assign_folds_by_rank(df, seed, k))


def fit_holdout_split(df: DataFrame, seed: int = SEED, test_size: float = 0.2) -> Split | RankedSplit:
    """Train/test split for any number of classes."""
    try:
        return fit_holdout(df, seed, test_size)
    except TooManyBounds:
        return RankedSplit(seed, 2, assign_holdout_by_rank(df, seed, test_size))


def _class_offsets(sizes: DataFrame, digits: int) -> DataFrame:
    """``(label, size, begin)``: running class totals of ``sizes (label, n)`` in ``md5(label)`` order.

    Totals run inside each group of labels sharing a hash prefix, and over the groups, of which
    there are at most ``16 ** digits``.
    """
    sizes = (
        sizes.select("label", F.col("n").alias("size"))
        .withColumn("_hash", F.md5("label"))
        .withColumn("_group", F.substring("_hash", 1, digits))
    )
    groups = sizes.groupBy("_group").agg(F.sum("size").alias("_total"))
    before = groups.select(
        "_group", (F.sum("_total").over(Window.orderBy("_group")) - F.col("_total")).alias("_before")
    )
    inside = F.sum("size").over(Window.partitionBy("_group").orderBy("_hash")) - F.col("size")
    return (
        sizes.withColumn("_inside", inside)
        .join(before, "_group")
        .select("label", "size", (F.col("_before") + F.col("_inside")).alias("begin"))
    )


def _stored_sizes(df: DataFrame) -> DataFrame:
    """``(label, n)``, counted once and kept."""
    path = scratch_uri(df.sparkSession, "sizes")
    label_distribution(df).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ranked(df: DataFrame, seed: int, digits: int, sizes: DataFrame, per_class: DataFrame) -> DataFrame:
    """Rows ``(window_id, label, rank)`` ranked in their class, with the columns of ``per_class (label, ..)``.

    Rows shuffle once, by (label, bucket). Only a class with over ``1 / MAX_CLASSES`` of the rows has buckets, so a
    class holding most of the table still spreads over all of them, and others need no counts. Rows carry the hash in
    16 bytes beside their id, in the order of :func:`sort_key`.
    """
    large = F.broadcast(heavy_classes(sizes).withColumn("_large", F.lit(True)))  # fewer than MAX_CLASSES labels
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("window_id")))
    bucket = F.when(F.col("_large"), F.substring(digest, 1, digits)).otherwise("")
    flagged = df.select("window_id", "label").join(large, "label", "left")
    keyed = flagged.select("window_id", "label", F.unhex(digest).alias("_digest"), bucket.alias("bucket"))
    counts = flagged.where("_large").groupBy("label", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")
    starts = counts.select("label", "bucket", start.alias("start"))
    parted = per_class.join(large, "label", "left")
    whole = parted.where("_large is null").withColumns({"bucket": F.lit(""), "start": F.lit(0).cast("long")})
    cut = parted.where("_large").join(starts, "label")
    per_bucket = whole.unionByName(cut).drop("_large")
    order = Window.partitionBy("label", "bucket").orderBy("_digest", "window_id")
    return (
        keyed.withColumn("_row", F.row_number().over(order) - 1)
        .where("window_id is not null")  # counted, but in no part
        .join(per_bucket.hint("merge"), ["label", "bucket"])
        .withColumn("rank", F.col("start") + F.col("_row"))
        .drop("bucket", "start", "_row", "_digest")
    )


def assign_folds_by_rank(
    df: DataFrame, seed: int = SEED, k: int = FOLDS, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """``(window_id, label, fold)``: the same folds for any number of classes, with no broadcast."""
    sizes = _stored_sizes(df)
    ranked = _ranked(df, seed, digits, sizes, _class_offsets(sizes, digits))
    base = F.floor(F.col("size") / k)
    extra = F.col("size") % k
    quotas = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda f: base + F.when(F.pmod(f - F.col("begin"), F.lit(k)) < extra, 1).otherwise(0),
    )
    cumulative = F.transform(
        F.sequence(F.lit(1), F.lit(k - 1)),
        lambda f: F.aggregate(F.slice(quotas, F.lit(1), f), F.lit(0).cast("long"), lambda a, v: a + v),
    )
    fold = F.size(F.filter(cumulative, lambda s: s <= F.col("rank"))).cast("int")
    return ranked.select("window_id", "label", fold.alias("fold"))


def assign_holdout_by_rank(
    df: DataFrame, seed: int = SEED, test_size: float = 0.2, digits: int = BUCKET_DIGITS
) -> DataFrame:
    """``(window_id, label, fold)`` with the test part as 0: the same holdout for any number of classes.

    Classes of one size have one remainder, so the rows left over go to whole sizes at a time; only the
    labels of the size in which they end are ranked.
    """
    sizes = _stored_sizes(df)
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    target = math.ceil(test_size * total)
    exact = F.col("n").cast("decimal(38,0)") * F.lit(target)
    quotas = sizes.select(
        "label",
        F.floor(exact / F.lit(max(total, 1))).cast("long").alias("quota"),
        (-(exact % F.lit(max(total, 1)))).alias("rest"),
    )
    left = target - int(quotas.agg(F.sum("quota")).first()[0] or 0)
    by_rest = quotas.groupBy("rest").agg(F.count(F.lit(1)).alias("n"))  # sizes are few: they add up to the rows
    ended = by_rest.withColumn("upto", F.sum("n").over(Window.orderBy("rest"))).where(F.col("upto") >= left)
    end = ended.orderBy("rest").first() if left > 0 else None
    if end is not None:
        more = F.col("rest") < F.lit(end["rest"])
        within = left - (end["upto"] - end["n"])
        ties = F.col("rest") == F.lit(end["rest"])
        if within < end["n"]:
            first = global_rank(quotas.where(ties).select("label"), "label").where(F.col("_rank") == within).first()
            ties &= F.col("label") < F.lit(first["label"])
        quotas = quotas.withColumn("quota", F.col("quota") + (more | ties).cast("long"))
    ranked = _ranked(df, seed, digits, sizes, quotas.select("label", "quota"))
    part = F.when(F.col("rank") < F.col("quota"), 0).otherwise(1).cast("int")
    return ranked.select("window_id", "label", part.alias("fold"))


def training(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") != fold)


def validation(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)


def attach_folds(windows: DataFrame, folds: DataFrame) -> DataFrame:
    """Stored fold rows joined back to their windows by id (ids are unique on both sides)."""
    return windows.join(folds.select("window_id", "fold"), "window_id")
