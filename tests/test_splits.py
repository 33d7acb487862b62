import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldstack.operators import classes, splits


def _table(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "window_id string, label string"), rows


def _brute_force(rows, seed, k):
    """Fold by global rank inside each class, quotas continuing round-robin over the classes."""
    by_class = {}
    for window_id, label in rows:
        digest = hashlib.md5(f"{seed}:{window_id}".encode()).hexdigest()
        by_class.setdefault(label, []).append((digest, window_id))
    folds, offset = {}, 0
    for label in sorted(by_class, key=lambda c: hashlib.md5(c.encode()).hexdigest()):
        members = sorted(by_class[label])
        quota = Counter((offset + i) % k for i in range(len(members)))
        position = 0
        for fold in range(k):
            for _, window_id in members[position : position + quota[fold]]:
                folds[window_id] = fold
            position += quota[fold]
        offset += len(members)
    return folds


@pytest.mark.parametrize(
    "sizes, k",
    [
        ({"a": 40, "b": 33, "c": 7}, 5),
        ({"a": 2, "b": 9}, 5),
        ({"a": 1, "b": 1, "c": 1}, 2),
        ({"big": 300, "small": 3}, 7),
    ],
)
def test_folds_equal_brute_force(spark, sizes, k):
    df, rows = _table(spark, sizes)
    expected = _brute_force(rows, 7, k)
    for assigned in (splits.assign_folds(df, 7, k), splits.assign_folds_by_rank(df, 7, k)):
        assert {r["window_id"]: r["fold"] for r in assigned.collect()} == expected


def test_folds_are_exhaustive_balanced_and_stable(spark):
    df, rows = _table(spark, {"a": 101, "b": 57, "c": 12})
    first = {r["window_id"]: (r["label"], r["fold"]) for r in splits.assign_folds(df).collect()}
    assert len(first) == len(rows)
    totals = Counter(fold for _, fold in first.values())
    assert max(totals.values()) - min(totals.values()) <= 1
    for label in "abc":
        sizes = Counter({f: 0 for f in range(5)})
        sizes.update(fold for name, fold in first.values() if name == label)
        assert max(sizes.values()) - min(sizes.values()) <= 1
    for n in (1, 7, 32):
        again = splits.assign_folds(df.repartition(n)).collect()
        assert {r["window_id"]: (r["label"], r["fold"]) for r in again} == first
    other = {r["window_id"]: r["fold"] for r in splits.assign_folds(df, seed=1).collect()}
    assert any(other[w] != first[w][1] for w in other)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_bucket_width_does_not_matter(spark, digits):
    df, _ = _table(spark, {"a": 90, "b": 45})
    assert splits.fit_folds(df, digits=digits) == splits.fit_folds(df)


def test_assigning_folds_never_shuffles_the_wide_table(spark):
    df, _ = _table(spark, {"a": 50, "b": 50})
    wide = df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    plan = splits.fit_folds(df).assign(wide)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan


def test_unknown_label_raises_instead_of_losing_rows(spark):
    df, _ = _table(spark, {"a": 10, "b": 10})
    split = splits.fit_folds(df)
    late = spark.createDataFrame([("x", "z")], "window_id string, label string")
    with pytest.raises(Exception, match="label not in the stored split"):
        split.assign(late).collect()


def test_holdout_quota(spark):
    df, rows = _table(spark, {"a": 50, "b": 31, "c": 6})
    parts = splits.fit_holdout(df).assign(df, "part")
    test = parts.where("part = 0")
    assert test.count() == 18  # ceil(0.2 * 87)
    per_class = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert per_class == {"a": 10, "b": 7, "c": 1}
    assert parts.count() == len(rows)


def test_k_must_allow_a_training_side(spark):
    df, _ = _table(spark, {"a": 4})
    with pytest.raises(ValueError, match="at least 2"):
        splits.fit_folds(df, k=1)


def test_join_per_class_agrees_within_and_beyond_the_broadcast_bound(spark):
    df, _ = _table(spark, {"a": 90, "b": 5, "c": 5})
    weights = classes.class_weights(df).select("label", "weight")
    small = classes.join_per_class(df, weights)
    salted = classes.join_per_class(df, weights, limit=1)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()


def test_a_table_of_many_classes_is_never_broadcast_in_copies(spark):
    df, _ = _table(spark, {"big": 400, **{f"class-{i}": 2 for i in range(300)}})
    coded = classes.join_per_class(df, classes.class_table(df).select("label", "code"), limit=20)
    wanted = {"big": 0, **{c: i + 1 for i, c in enumerate(sorted(f"class-{i}" for i in range(300)))}}
    assert {(r["label"], r["code"]) for r in coded.collect()} == set(wanted.items()) and coded.count() == 1000
    plan = coded._jdf.queryExecution().toString()
    final = plan[plan.index("== Physical Plan =="):]
    assert "SortMergeJoin" in final
    # Copies are made for classes with many rows alone, not for all 301.
    assert _rows_of(classes.heavy_classes(classes.label_distribution(df), 20)) == ["big"]


def _rows_of(df):
    return sorted(r[0] for r in df.collect())


def test_many_classes_split_alike(spark):
    sizes = {f"class-{i}": 1 + i % 4 for i in range(300)}
    df, rows = _table(spark, sizes)
    expected = _brute_force(rows, 7, 5)
    for assigned in (splits.assign_folds(df, 7, 5), splits.assign_folds_by_rank(df, 7, 5)):
        assert {r["window_id"]: r["fold"] for r in assigned.collect()} == expected
    totals = Counter(expected.values())
    assert max(totals.values()) - min(totals.values()) <= 1


def test_ranks_count_large_classes_alone(spark, monkeypatch):
    df, rows = _table(spark, {"big": 700, **{f"class-{i}": 1 + i % 6 for i in range(200)}})
    quota = splits.holdout_quotas(Counter(c for _, c in rows), 0.2)
    assert len({quota[f"class-{i}"] for i in range(0, 200, 6)} | {quota[f"class-{i}"] for i in range(3, 200, 6)}) > 1  # cut inside a size
    for limit in (100, 10_000):  # with a large class alone, and with every class large
        monkeypatch.setattr(splits, "heavy_classes", lambda sizes, n=limit: classes.heavy_classes(sizes, n))
        ranked = splits.assign_holdout_by_rank(df, 7)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        assert "unhex(md5" in plan and "_large" in plan  # 16 bytes of hash, and buckets where they are needed
        found = ranked.where("fold = 0").groupBy("label").agg(F.count("*").alias("n")).collect()
        assert {r["label"]: r["n"] for r in found} == {c: n for c, n in quota.items() if n}
        assert {r["window_id"]: r["fold"] for r in splits.assign_folds_by_rank(df, 7, 5).collect()} == _brute_force(rows, 7, 5)


def test_class_list_refuses_unbounded_labels(spark):
    df, _ = _table(spark, {"a": 1, "b": 1, "c": 1})
    assert classes.class_list(df) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="not a class column"):
        classes.class_list(df, limit=2)


def test_ranks_and_finer_buckets_give_the_same_split(spark, monkeypatch):
    rows = spark.range(700).select(
        F.concat(F.lit("w"), "id").alias("window_id"),
        F.when(F.col("id") % 10 < 7, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("label"),
    )
    folds, holdout = splits.fit_folds(rows, 3, 4), splits.fit_holdout(rows, 3)
    placed = [{tuple(r) for r in x.assign(rows).select("window_id", "fold").collect()} for x in (folds, holdout)]
    monkeypatch.setattr(splits, "BUCKET_ROWS", 2)
    assert splits.fit_folds(rows, 3, 4, digits=1) == folds and splits.fit_holdout(rows, 3, digits=1) == holdout
    monkeypatch.setattr(splits, "MAX_BOUNDS", 2)
    for fitted, ranked in zip(placed, (splits.fit_split(rows, 3, 4), splits.fit_holdout_split(rows, 3))):
        assert isinstance(ranked, splits.RankedSplit)
        assert {tuple(r) for r in ranked.assign(rows).select("window_id", "fold").collect()} == fitted
    with pytest.raises(splits.TooManyBounds):
        splits.fit_folds(rows, 3, 4)


def test_sample_keeps_every_class_and_its_share(spark):
    rows = spark.range(4000).select(
        F.concat(F.lit("w"), "id").alias("window_id"),
        F.when(F.col("id") < 10, "rare").when(F.col("id") == 10, "single").when(F.col("id") % 3 == 0, "b").otherwise("a").alias("label"),
    )
    folded = splits.assign_folds(rows)
    sample = splits.fit_sample(folded, 200)
    taken = sample.take(folded.repartition(5))
    found = {(r["fold"], r["label"]): r["n"] for r in taken.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    assert found == sample.quotas and taken.columns == folded.columns
    size = {(r["fold"], r["label"]): r["n"] for r in folded.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    assert sum(n for (_, c), n in found.items() if c == "rare") == 10 and sum(n for (_, c), n in found.items() if c == "single") == 1
    for key, n in size.items():
        assert found[key] == max(min(n, splits.SAMPLE_FLOOR), found[key]) and abs(found[key] - n * 200 / 4000) < 1 or n <= splits.SAMPLE_FLOOR
    again = sorted(r["window_id"] for r in splits.fit_sample(folded, 200).take(folded).collect())
    assert again == sorted(r["window_id"] for r in taken.collect())
