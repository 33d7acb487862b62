"""Forests under a keyed bootstrap against brute-force computations and across partitionings."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldstack.operators.binning import bin_edges, blocks, to_bins
from foldstack.plans import forest
from foldstack.plans.forest import Growing, balanced, columns_of, fit_forest, votes

from test_boosting import frame, made


def brute_tree(bins, y, w, weights, path, settings, n_bins, depth=0):
    """A tree by recursion over rows: nested (column, bin, left, right) or class counts."""
    counts = np.bincount(y, w, len(weights)).astype(int)
    if (counts > 0).sum() < 2 or counts.sum() < 2 * settings.leaf or depth == settings.depth:
        return counts
    for n in (settings.columns, bins.shape[1]):
        best, found = -1.0, None
        for column in columns_of(np.array([path]), bins.shape[1], n)[0]:
            for b in range(n_bins):
                side = bins[:, column] <= b
                left, right = (np.bincount(y[s], w[s], len(weights)) for s in (side, ~side))
                if min(left.sum(), right.sum()) < settings.leaf:
                    continue
                score = sum((x * weights) @ (x * weights) / (x * weights).sum() for x in (left, right))
                if score > best + 1e-9:
                    best, found = score, (column, b, side)
        if found:
            column, b, side = found
            paths = forest.children(np.array([path]))
            below = [
                brute_tree(bins[s], y[s], w[s], weights, p, settings, n_bins, depth + 1) for s, p in zip((side, ~side), paths)
            ]
            return (int(column), b, *below)
    return counts


def nested(tree, at=0):
    if tree["feature"][at] < 0:
        return tree["counts"][at]
    left = tree["left"][at]
    return (int(tree["feature"][at]), int(tree["bin"][at]), nested(tree, left), nested(tree, left + 1))


def same(one, other):
    if isinstance(one, tuple):
        return one[:2] == other[:2] and same(one[2], other[2]) and same(one[3], other[3])
    return list(one) == list(other)


@pytest.mark.parametrize("settings", [Growing(3, 2, seed=1), Growing(3, 1, depth=3, leaf=4, seed=2)])
def test_trees_equal_brute_force(spark, settings):
    x, y = made(150, 5, 3)
    x[:, 4] = 1.0  # a column that divides nothing
    rows = frame(spark, x, y)
    edges = bin_edges(rows, "x", 16)
    block, n_bins = blocks(rows, edges, "x", 1).first(), max(map(len, edges)) + 1
    for fold in (None, 1):
        for tree in range(settings.trees):
            w = np.where(block["fold"] != (-1 if fold is None else fold), settings.draws(tree, block["key"]), 0)
            weights = balanced(np.bincount(block["y"], w, 3).astype(int))
            some = w > 0
            wanted = brute_tree(block["bins"][some], block["y"][some], w[some], weights, settings.root(tree)[0], settings, n_bins)
            assert same(nested(forest._whole(block, fold, tree, 3, n_bins, settings)), wanted)


def test_dense_and_sorted_counts_agree():
    rng = np.random.default_rng(1)
    cells, y, w = rng.integers(0, 50, 300), rng.integers(0, 3, 300), rng.integers(1, 4, 300)
    dense, sparse = (forest.cells_of(cells, y, w, n, 3) for n in (50, 10**6))
    assert all(np.array_equal(a, b) for a, b in zip(dense, sparse))


@pytest.mark.parametrize("settings", [Growing(3, 2, seed=4), Growing(2, 2, depth=4, leaf=2, seed=5)])
def test_any_partitioning_gives_the_same_forest(spark, settings, monkeypatch):
    monkeypatch.setattr(forest, "LOCAL", 40)  # the top of each tree grows level by level
    monkeypatch.setattr(forest, "TOGETHER", 4)
    x, y = made(300, 5, 3)
    rows = frame(spark, x, y)
    edges = bin_edges(rows, "x", 32)
    folds = [None, 0]
    wanted = fit_forest(blocks(rows, edges, "x", 1), folds, 3, edges, settings)
    bins = to_bins(x, edges)
    for parts in (2, 7):
        found = fit_forest(blocks(rows.repartition(parts), edges, "x", parts), folds, 3, edges, settings)
        for one, other in zip(wanted, found):
            assert len(one["feature"]) == len(other["feature"])
            assert np.array_equal(votes(bins, one), votes(bins, other))


def test_draws_are_a_bootstrap():
    keys = np.random.default_rng(0).integers(0, 2**63, 50_000).astype(np.uint64)
    draws = [Growing(1, 1, seed=s).draws(t, keys) for s in (1, 2) for t in (0, 1)]
    for d in draws:
        assert d.mean() == pytest.approx(1, abs=0.03) and (d == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert all(abs(np.corrcoef(draws[0], d)[0, 1]) < 0.02 for d in draws[1:])


def test_unlimited_trees_know_what_they_drew(spark):
    x, y = made(400, 5, 3)
    y = np.random.default_rng(5).integers(0, 3, 400).astype(np.int32)  # labels without a pattern
    rows = frame(spark, x + np.arange(400)[:, None] * 1e-4, y)
    edges = bin_edges(rows, "x")
    block, settings = blocks(rows, edges, "x", 1).first(), Growing(1, 2)
    tree = forest._whole(block, None, 0, 3, max(map(len, edges)) + 1, settings)
    leaves = tree["counts"][tree["feature"] < 0]
    alike = {}
    for b, c, w in zip(map(bytes, block["bins"]), block["y"], settings.draws(0, block["key"])):
        if w:
            alike.setdefault(b, set()).add(int(c))
    mixed_leaves = int(((leaves > 0).sum(axis=1) > 1).sum())
    assert mixed_leaves == sum(len(c) > 1 for c in alike.values())  # only rows of equal bins stay together


def test_out_of_bag_votes(spark):
    x, y = made(200, 4, 3)
    rows = frame(spark, x, y)
    learner = forest.ForestClasses(3, 64, Growing(15, 2, seed=3))
    model = learner.fit_many(rows, "x", [None], 200)[0]
    found = {r["window_id"]: r for r in model.out_of_bag(rows, "x").collect()}
    edges = bin_edges(rows, "x", 64)
    block, n_bins = blocks(rows, edges, "x", 1).first(), max(map(len, edges)) + 1
    ids = {r["k"] % 2**64: r["window_id"] for r in rows.select("window_id", F.xxhash64("window_id").alias("k")).collect()}
    share, trees = np.zeros((200, 3)), np.zeros(200, int)
    for t in range(15):
        w = learner.settings.draws(t, block["key"])
        tree = forest._whole(block, None, t, 3, n_bins, learner.settings)
        weights = balanced(tree["counts"][0])
        for i in np.flatnonzero(w == 0):
            at = 0
            while tree["feature"][at] >= 0:
                at = tree["left"][at] + int(block["bins"][i, tree["feature"][at]] > tree["bin"][at])
            leaf = tree["counts"][at] * weights
            share[i] += leaf / leaf.sum()
            trees[i] += 1
    assert len(found) == 200 and 0 < trees.max() < 15
    for i, key in enumerate(block["key"].tolist()):
        row = found[ids[key]]
        assert row["trees"] == trees[i] and row["y"] == block["y"][i]
        assert row["proba"] is None if not trees[i] else row["proba"] == pytest.approx(share[i] / trees[i], abs=1e-6)


def test_trees_stay_out_of_the_driver(spark, tmp_path):
    x, y = made(200, 4, 3)
    rows = frame(spark, x, y)
    few, many = (forest.ForestClasses(3, 64, Growing(n, 2, seed=3)).fit_many(rows, "x", [None, 1], 200) for n in (2, 40))
    size = lambda model: sum(len(str(v)) for v in model.extractParamMap().values())
    assert abs(size(few[1]) - size(many[1])) < 10  # what the driver holds does not grow with the trees
    model = many[1]
    model.write().save(str(tmp_path / "forest"))
    again = forest.ForestTrees.load(str(tmp_path / "forest"))
    assert again.getOrDefault(again.stored) != model.getOrDefault(model.stored)
    edges = bin_edges(rows, "x", 64)
    wanted = fit_forest(blocks(rows, edges, "x", 1), [1], 3, edges, Growing(40, 2, seed=3))[0]
    vectors = rows.select("window_id", array_to_vector("x").alias("_vector"))
    for one in (model, again):
        found = {r["window_id"]: r["_probability"] for r in one.transform(vectors).collect()}
        assert np.array_equal([found[f"w{i}"] for i in range(200)], votes(to_bins(x, edges), wanted) / 40)


@pytest.mark.parametrize("classes, leaf", [(4, 1), (10, 1), (10, 3), (40, 2)])
def test_divisions_equal_those_counted_by_class(classes, leaf):
    rng = np.random.default_rng(classes + leaf)
    for n_rows, n_nodes, n_bins in ((900, 150, 256), (900, 150, 3), (4000, 4, 64)):
        nodes, y, w = np.arange(n_rows) * n_nodes // n_rows, rng.integers(0, classes, n_rows), rng.integers(1, 4, n_rows)
        values = rng.integers(0, n_bins, (n_rows, 3)).astype(np.uint8)
        values[:, 2] = values[:, 1]  # equal scores: the first column counts
        totals = np.bincount(nodes * classes + y, w, n_nodes * classes).reshape(-1, classes).astype(np.int64)
        weights = balanced(totals.sum(axis=0))
        weights[0] *= 1e5  # a rare class outweighs the others
        cells, counts = forest.cells_of(
            ((nodes[:, None] * 3 + np.arange(3)) * n_bins + values).ravel(), np.repeat(y, 3), np.repeat(w, 3), n_nodes * 3 * n_bins, classes
        )
        wanted = forest.choose(cells, counts, totals, weights, n_bins, 3, leaf)
        some = values, nodes, y, w, totals, weights
        for found in (forest.divide(*some, leaf), forest.divide_dense(*some, n_bins, leaf), forest._split(*some, n_bins, leaf)):
            order = np.argsort(found[0])
            assert all(np.array_equal(a, b[order]) for a, b in zip(wanted, found))


def test_no_number_per_class_of_small_nodes(monkeypatch):
    rng = np.random.default_rng(4)
    n, classes = 3000, 10
    bins, y = rng.integers(0, 256, (n, 12)).astype(np.uint8), rng.integers(0, classes, n).astype(np.int32)
    weighed, score, choose = [], forest._score, forest.choose
    monkeypatch.setattr(forest, "_score", lambda left, right: weighed.append(left.size) or score(left, right))
    monkeypatch.setattr(forest, "choose", lambda found, counts, *rest: weighed.append(counts.size) or choose(found, counts, *rest))
    tree = forest.grow(bins, y, np.ones(n, np.int64), np.ones(classes), np.array([7], np.uint64), 256, Growing(1, 4, seed=1))
    assert len(tree["feature"]) > 1500  # some 11 levels of 3,000 rows in 4 columns, which are 1.3 million numbers
    assert sum(weighed) < 3000 * 4 * classes * 2


def test_nodes_are_divided_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 40, (2000, 6)).astype(np.uint8), rng.integers(0, 5, 2000).astype(np.int32)
    args = bins, y, rng.integers(0, 3, 2000), np.ones(5), np.array([3], np.uint64), 40, Growing(1, 2, seed=1)
    wanted = forest.grow(*args)
    monkeypatch.setattr(forest, "DRAWN", 100)
    monkeypatch.setattr(forest, "CELLS", 1)
    monkeypatch.setattr(forest, "WEIGHED", 7)
    found = forest.grow(*args)
    assert all(np.array_equal(found[n], wanted[n]) for n in wanted)
