"""Boosted trees against brute-force computations and across partitionings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstack.operators.binning import bin_edges, blocks, keyed, shares, to_bins
from foldstack.plans import boosting
from foldstack.plans.boosting import Boosting, fit_boosted, fit_part, gradients, margins_of, probabilities


def made(n=400, d=5, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    y = (x[:, 0] + (x[:, 1] > 0.3) * x[:, 2] > 0.4).astype(int) + (classes > 2) * (x[:, 3] > 0.9)
    return x, np.minimum(y, classes - 1).astype(np.int32)


def frame(spark, x, y, folds=3):
    rows = [(f"w{i}", int(c), i % folds, [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "window_id string, y int, fold int, x array<double>")


def test_edges_are_near_quantiles(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=20_000), rng.integers(0, 9, 20_000).astype(float), np.zeros(20_000)], axis=1)
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    edges = bin_edges(rows, "x", 64)
    assert [len(e) for e in edges][1:] == [9, 1] and len(edges[0]) == 63
    ranks = np.searchsorted(np.sort(x[:, 0]), edges[0], side="right") / len(x)
    assert np.abs(ranks - np.arange(1, 64) / 64).max() < 0.001
    bins = to_bins(x, edges)
    for i, e in enumerate(edges):
        for b in range(len(e)):
            assert ((bins[:, i] <= b) == (x[:, i] <= e[b])).all()


def test_blocks_hold_every_row_once(spark):
    x, y = made(200)
    rows = frame(spark, x, y)
    edges = bin_edges(rows, "x", 16)
    found = blocks(rows, edges, "x", 3).collect()
    assert len(found) == 3 and sum(len(b["y"]) for b in found) == 200
    assert len(np.unique(np.concatenate([b["key"] for b in found]))) == 200


@pytest.mark.parametrize("classes", [2, 3])
def test_gradients_are_the_slope(classes):
    rng = np.random.default_rng(classes)
    margins, y = rng.normal(size=(30, 1 if classes == 2 else classes)), rng.integers(0, classes, 30)
    loss = lambda m: -np.log(probabilities(m)[np.arange(30), y])
    g, h = (v / boosting.STEPS for v in gradients(margins, y))
    for k in range(margins.shape[1]):
        step = np.zeros_like(margins)
        step[:, k] = 1e-4
        assert g[:, k] == pytest.approx((loss(margins + step) - loss(margins - step)) / 2e-4, abs=1e-6)
        curve = (loss(margins + step) - 2 * loss(margins) + loss(margins - step)) / 1e-8
        assert h[:, k] == pytest.approx(curve * (1 if classes == 2 else 2), abs=1e-4)


def brute_tree(x, g, h, settings, columns, edges, depth):
    """A tree by trying every split of every node: a function of a row."""
    total = lambda s: (g[s].sum(), h[s].sum())
    value = lambda s: -settings.step * total(s)[0] / (total(s)[1] + settings.penalty)
    score = lambda s: total(s)[0] ** 2 / (total(s)[1] + settings.penalty)

    def grow(rows, depth):
        best = (boosting.LEAST_GAIN, None)
        for c in columns if depth else ():
            for e in edges[c]:
                left, right = rows[x[rows, c] <= e], rows[x[rows, c] > e]
                if min(h[left].sum(), h[right].sum()) >= settings.least:
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (c, e, left, right))
        if best[1] is None:
            leaf = value(rows)
            return lambda r: leaf
        c, e, left, right = best[1]
        low, high = grow(left, depth - 1), grow(right, depth - 1)
        return lambda r: low(r) if r[c] <= e else high(r)

    return grow(np.arange(len(x)), depth)


@pytest.mark.parametrize("classes", [2, 3])
def test_trees_equal_brute_force(spark, classes):
    x, y = made(120, 4, classes)
    rows = frame(spark, x, y, 1)
    edges = bin_edges(rows, "x", 12)
    settings = Boosting(4, 3, 0.3, 0.8, 0.5, seed=5)
    block = blocks(rows, edges, "x", 1).first()
    n_trees = 1 if classes == 2 else classes
    found = margins_of(block["bins"], fit_part(block, None, n_trees, max(map(len, edges)) + 1, settings))
    order = {int(k): i for i, k in enumerate(block["key"])}
    keys = [r["k"] for r in rows.orderBy(F.expr("int(substr(window_id, 2))")).select(F.xxhash64("window_id").alias("k")).collect()]
    place = [order[k % 2**64] for k in keys]
    margins = np.zeros((len(x), n_trees))
    hashed = np.array(keys, np.int64).view(np.uint64)
    for round_ in range(settings.rounds):
        g, h = (v / boosting.STEPS for v in gradients(margins, y))
        taken = shares(hashed, keyed(settings.seed, 2, round_)) < settings.rows
        for k in range(n_trees):
            columns = settings.chosen_columns(round_, k, x.shape[1])
            assert len(columns) == 2
            tree = brute_tree(x[taken], g[taken, k], h[taken, k], settings, columns, edges, settings.depth)
            margins[:, k] += [tree(r) for r in x]
    assert found[place] == pytest.approx(margins, abs=1e-9)


@pytest.mark.parametrize("classes", [2, 3])
def test_parts_give_the_trees_of_one_part(spark, classes, monkeypatch):
    monkeypatch.setattr(boosting, "CUT", 2)
    x, y = made(300, 5, classes)
    rows = frame(spark, x, y)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = bin_edges(rows, "x", 32)
    settings = Boosting(5, 4, 0.3, 0.8, 0.8, seed=9)
    folds = [None, 0, 2]
    wanted = fit_boosted(blocks(rows, edges, "x", 1), folds, classes, edges, settings)
    for parts in (2, 7):
        found = fit_boosted(blocks(rows.repartition(5), edges, "x", parts), folds, classes, edges, settings)
        for one, other in zip(wanted, found):
            assert all(np.array_equal(one[n], other[n]) for n in ("feature", "bin", "value"))


def test_full_rounds_learn(spark):
    x, y = made(600, 5, 3)
    rows = frame(spark, x, y)
    edges = bin_edges(rows, "x")
    model = fit_boosted(blocks(rows, edges, "x", 1), [None], 3, edges, Boosting(60, 4, 0.3, 0.8, 0.8))[0]
    fresh, wanted = made(300, 5, 3, seed=2)
    p = probabilities(margins_of(to_bins(fresh, edges), model))
    assert (p.argmax(axis=1) == wanted).mean() > 0.9 and np.allclose(p.sum(axis=1), 1)


def test_of_two_children_one_is_summed(monkeypatch):
    rng = np.random.default_rng(7)
    block = {
        "bins": rng.integers(0, 9, (2000, 4)).astype(np.uint8), "y": rng.integers(0, 3, 2000).astype(np.int32),
        "fold": np.zeros(2000, np.int32), "key": rng.integers(0, 2**63, 2000).astype(np.uint64),
    }
    settings, sums_of, summed = Boosting(3, 5, 0.3, 1.0, 0.8, seed=2), boosting.sums_of, []
    monkeypatch.setattr(boosting, "sums_of", lambda *args: summed.append(len(args[2])) or sums_of(*args))
    found = fit_part(block, None, 3, 9, settings)
    assert sum(summed) <= 3 * 3 * 2000 * (1 + 4 / 2)  # whole once, then at most half of the rows a level
    monkeypatch.setattr(boosting._Rows, "sums_below", lambda self, tree, active, above, held, n_bins: self.sums(tree, active, n_bins))
    wanted = fit_part(block, None, 3, 9, settings)
    assert all(np.array_equal(found[n], wanted[n]) for n in wanted) and sum(summed) > 3 * 3 * 2000 * 5


@pytest.mark.parametrize("classes", [2, 3])
def test_rows_of_equal_bins_count_as_one(monkeypatch, classes):
    rng = np.random.default_rng(classes)
    block = {
        "bins": rng.integers(0, 5, (4000, 3)).astype(np.uint8), "y": rng.integers(0, classes, 4000).astype(np.int32),
        "fold": rng.integers(0, 3, 4000).astype(np.int32), "key": rng.integers(0, 2**63, 4000).astype(np.uint64),
    }
    settings, sums_of, summed = Boosting(4, 4, 0.3, 0.8, 0.8, seed=2), boosting.sums_of, []
    monkeypatch.setattr(boosting, "sums_of", lambda *args: summed.append(len(args[2])) or sums_of(*args))
    n_trees = 1 if classes == 2 else classes
    found = fit_part(block, 1, n_trees, 5, settings)
    assert max(summed) <= 5**3  # not the 2,100 rows that a round takes
    monkeypatch.setattr(boosting._Rows, "joined", lambda self: self)
    wanted = fit_part(block, 1, n_trees, 5, settings)
    assert all(np.array_equal(found[n], wanted[n]) for n in wanted) and max(summed) > 2000


def test_tables_are_one_part_by_what_a_task_holds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(boosting, "blocks", lambda rows, edges, column, partitions: asked.append(partitions) or blocks(rows, edges, column, 1))
    x, y = made(60, 4, 2)
    learner = boosting.BoostedClasses(2, 16, Boosting(1, 2, 0.3, 0.8, 0.8))
    for n_rows in (60, 3_600_000, 36_000_000):  # as if there were so many: a level of rounds is a job only beyond a task's share
        learner.fit_many(frame(spark, x, y), "x", [None], n_rows)
    assert asked[:2] == [1, 1] and asked[2] > 1
