"""Gradient-boosted trees: one model for all classes, fitted for all folds together on features binned once.

Newton boosting on the softmax loss (logistic for two classes), one tree per class and round, L2 penalty on leaves, a
keyed share of rows per round and of columns per tree. A level costs one job for all folds and classes: every part of
the rows sums gradients and Hessians per (fold, class, node, feature, bin), the sums meet by key in a combined shuffle,
the best split of each node is chosen where its sums met, and only these splits reach the driver. Margins stay with the
rows' parts, carried from round to round; every ``CUT`` rounds they are checkpointed.

Gradients are summed as integers, so sums do not depend on the order of rows or parts: a table gives the same trees on
any partitioning. A table that takes at most ``ONE_TASK`` bytes of a task is one part; its sums then need no shuffle, so
the same steps run to the end inside one task per fold.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstack.operators.binning import bin_edges, blocks, keyed, shares, to_bins

#: Gradients are rounded to so many steps before they are summed.
STEPS = float(1 << 30)
#: Bytes that a task holds for the rows of one model up to which a table is one part, and binned bytes of a part beyond.
ONE_TASK, PART = 384 * 1024**2, 8 * 1024**2
#: Rows whose gradients are found at a time.
SLOPES = 1 << 14
#: Rounds between checkpoints of the margins.
CUT = 25
#: A split must lower the loss by more.
LEAST_GAIN = 1e-6
#: Leaves looked up at a time when scoring.
LOOKED_UP = 1 << 21
#: Cells whose splits are weighed at a time, so that they stay in a core's cache.
CACHED = 1 << 13


@dataclass(frozen=True)
class Boosting:
    """Settings of a fit; ``least`` is the least sum of Hessians in a leaf."""

    rounds: int
    depth: int
    step: float
    rows: float
    columns: float
    penalty: float = 1.0
    least: float = 1.0
    seed: int = 0

    def nodes(self) -> int:
        return 2 ** (self.depth + 1) - 1

    def chosen_columns(self, round_: int, tree: int, width: int) -> np.ndarray:
        """The columns of a tree: so many of the lowest keyed numbers."""
        if self.columns >= 1:
            return np.arange(width)
        n = max(1, round(self.columns * width))
        drawn = shares(np.arange(width).astype(np.uint64), keyed(self.seed, 1, round_, tree))
        return np.sort(np.argsort(drawn, kind="stable")[:n])

    def chosen_rows(self, round_: int, keys: np.ndarray) -> np.ndarray:
        if self.rows >= 1:
            return np.ones(len(keys), bool)
        salt, out = keyed(self.seed, 2, round_), np.empty(len(keys), bool)
        for at in range(0, len(keys), SLOPES):
            np.less(shares(keys[at : at + SLOPES], salt), self.rows, out=out[at : at + SLOPES])
        return out


class Trees:
    """Trees of one round: split feature (-1: leaf), bin and value of each node, in heap order."""

    def __init__(self, n_trees: int, nodes: int):
        self.feature = np.full((n_trees, nodes), -1, np.int32)
        self.bin = np.zeros((n_trees, nodes), np.uint8)
        self.value = np.zeros((n_trees, nodes))


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded first and second derivatives of the loss, one column per tree of a round."""
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins))
        g, h = p - y[:, None], p * (1 - p)
    else:
        p = np.exp(margins - margins.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g, h = p.copy(), 2 * p * (1 - p)
        g[np.arange(len(y)), y] -= 1
    return np.rint(g * STEPS), np.rint(np.maximum(h, 1e-16) * STEPS)


def sums_of(
    by_column: np.ndarray, columns: np.ndarray, rows: np.ndarray, place: np.ndarray, n_places: int, g: np.ndarray, h: np.ndarray, n_bins: int
) -> np.ndarray:
    """Sums over rows per (gradient or Hessian, place of the row's node, column, bin), a column at a time."""
    out = np.empty((2, n_places, len(columns), n_bins))
    g, h, first = g.take(rows), h.take(rows), place * n_bins
    cells = np.empty(len(rows), np.int64)
    for at, column in enumerate(columns):
        np.add(first, by_column[column].take(rows), out=cells)
        for i, x in enumerate((g, h)):
            out[i, :, at] = np.bincount(cells, x, n_places * n_bins).reshape(n_places, n_bins)
    return out  # whole numbers below 2^53


class _Rows:
    """The rows of a part that one model learns from; the taken ones are dealt to the nodes of the current round's trees."""

    def __init__(self, block: dict, margins: np.ndarray, fold: int | None):
        used = np.ones(len(block["y"]), bool) if fold is None else block["fold"] != fold
        self.used = np.flatnonzero(used)
        self.bins, self.y, self.key = (block[x][self.used] for x in ("bins", "y", "key"))
        self.margins = margins[self.used]
        self.other, self.dealt = np.arange(len(self.y)), [[] for _ in range(self.margins.shape[1])]
        self.kind = None

    def joined(self) -> _Rows:
        """Rows of equal bins as one: trees send them the same way, so only their numbers by class matter to a sum.

        Done where it saves work, before the first round, and only for windows of as many bytes as a whole number has.
        """
        (n_rows, width), n_trees = self.bins.shape, self.margins.shape[1]
        if not n_rows or width > 8:
            return self
        packed = np.zeros((n_rows, 8), np.uint8)
        packed[:, :width] = self.bins
        found, kind = np.unique(packed.view(np.uint64).ravel(), return_inverse=True)
        n_classes = max(2, n_trees)
        if len(found) * n_classes <= n_rows:
            self.bins = found.view(np.uint8).reshape(-1, 8)[:, :width].copy()
            self.kind = kind * n_classes + self.y
            self.margins, self.other = np.zeros((len(found), n_trees)), np.arange(len(found))
        return self

    def start(self, settings: Boosting, round_: int) -> None:
        n_rows, n_trees = self.margins.shape
        chosen = settings.chosen_rows(round_, self.key)
        if self.kind is not None:
            drawn = np.bincount(self.kind[chosen], minlength=n_rows * max(2, n_trees)).reshape(n_rows, -1)
            chosen = drawn.any(axis=1)
        self.g, self.h = np.empty((n_trees, n_rows)), np.empty((n_trees, n_rows))
        for at in range(0, n_rows, SLOPES):
            some = slice(at, at + SLOPES)
            if self.kind is None:
                g, h = gradients(self.margins[some], self.y[some])
            else:
                each = [gradients(self.margins[some], np.full(len(drawn[some]), y)) for y in range(drawn.shape[1])]
                g, h = (sum(x * n[:, None] for x, n in zip(xs, drawn[some].T)) for xs in zip(*each))
            self.g[:, some], self.h[:, some] = g.T, h.T
        self.taken, self.other = np.flatnonzero(chosen), np.flatnonzero(~chosen)
        self.columns = [settings.chosen_columns(round_, k, self.bins.shape[1]) for k in range(n_trees)]
        self.at = [{0: self.taken} for _ in range(n_trees)]  # rows by node of the level
        self.dealt = [[] for _ in range(n_trees)]  # and by leaf above it

    @cached_property
    def by_column(self) -> np.ndarray:
        return np.ascontiguousarray(self.bins.T)

    def sums(self, tree: int, active: np.ndarray, n_bins: int) -> np.ndarray:
        """Sums over taken rows per (gradient or Hessian, active node, column of the tree, bin)."""
        some = [self.at[tree][node] for node in active.tolist()]
        place = np.repeat(np.arange(len(some)), [len(x) for x in some])
        rows = some[0] if len(some) == 1 else np.concatenate(some)
        return sums_of(self.by_column, self.columns[tree], rows, place, len(some), self.g[tree], self.h[tree], n_bins)

    def sums_below(self, tree: int, active: np.ndarray, above: np.ndarray, held: np.ndarray, n_bins: int) -> np.ndarray:
        """The same from the sums ``held`` of the nodes ``above``: of two children the smaller is summed, the other is the rest."""
        parents = np.unique((active - 1) // 2)
        left, right = 2 * parents + 1, 2 * parents + 2
        size = {node: len(rows) for node, rows in self.at[tree].items()}
        small = np.array([a if size[a] <= size[b] else b for a, b in zip(left.tolist(), right.tolist())])
        some = self.sums(tree, small, n_bins)
        of = np.searchsorted(parents, (active - 1) // 2)
        out = np.empty((2, len(active), *some.shape[2:]))
        for at, (node, i, j) in enumerate(zip(active, of, np.searchsorted(above, parents[of]))):
            if node == small[i]:
                out[:, at] = some[:, i]
            else:
                np.subtract(held[:, j], some[:, i], out=out[:, at])
        return out

    def descend(self, trees: Trees, level: int, only: int | None = None) -> None:
        """Deal the taken rows at a level's split nodes to their children, in all trees of the round or one."""
        for tree in range(len(self.at)) if only is None else (only,):
            below = {}
            for node, rows in self.at[tree].items():
                feature = trees.feature[tree, node]
                if feature < 0:
                    self.dealt[tree].append((node, rows))
                    continue
                right = self.by_column[feature].take(rows) > trees.bin[tree, node]
                below[2 * node + 1], below[2 * node + 2] = rows[~right], rows[right]
            self.at[tree] = below

    def finish(self, trees: Trees) -> None:
        """Add the round's leaves to the margins; rows that were not taken look theirs up."""
        flat, first = self.bins.ravel(), self.other * self.bins.shape[1]
        for tree, dealt in enumerate(self.dealt):
            ends = [*dealt, *(self.at[tree].items() if len(self.other) < len(self.margins) else ())]
            for node, rows in ends:
                self.margins[rows, tree] += trees.value[tree, node]
            node, rows = np.zeros(len(self.other), np.int64), np.arange(len(self.other))
            feature, bin_ = trees.feature[tree], trees.bin[tree]
            while len(rows):
                at = node[rows]
                asked = feature[at]
                if (asked < 0).any():
                    rows = rows[asked >= 0]
                    at = node[rows]
                    asked = feature[at]
                node[rows] = 2 * at + 1 + (flat.take(first[rows] + asked) > bin_[at])
            self.margins[self.other, tree] += trees.value[tree][node]


def best_splits(sums: np.ndarray, settings: Boosting) -> list[tuple]:
    """``(gain, column, bin, g left, h left, g, h)`` of each node of ``sums``; the first of equal gains."""
    step = max(1, CACHED // (sums.shape[2] * sums.shape[3]))
    return [x for at in range(0, sums.shape[1], step) for x in _best_splits(sums[:, at : at + step], settings)]


def _best_splits(sums: np.ndarray, settings: Boosting) -> list[tuple]:
    # In steps as they are summed: STEPS is a power of two, so this rounds as gradients themselves would.
    g, h = np.cumsum(sums, axis=-1, dtype=np.float64)
    all_g, all_h = g[:, 0, -1], h[:, 0, -1]  # every column has all rows
    least, penalty = settings.least * STEPS, settings.penalty * STEPS
    rest = all_h[:, None, None] - h
    poor = h < least
    poor |= rest < least
    poor[..., -1] = True  # nothing is on the right
    right = all_g[:, None, None] - g
    right *= right
    rest += penalty
    right /= rest
    gain = np.multiply(g, g, out=rest)
    gain /= h + penalty
    gain += right
    gain[poor] = -np.inf
    nodes, flat = np.arange(len(gain)), gain.reshape(len(gain), -1)
    column, bin_ = np.divmod(flat.argmax(axis=1), gain.shape[2])
    best = gain[nodes, column, bin_] - all_g * all_g / (all_h + penalty)
    found = (best / STEPS, column, bin_, *(x / STEPS for x in (g[nodes, column, bin_], h[nodes, column, bin_], all_g, all_h)))
    return list(zip(*(x.tolist() for x in found)))


def plant(trees: Trees, tree: int, active: np.ndarray, splits: list[tuple], columns: np.ndarray, settings: Boosting) -> np.ndarray:
    """Put the splits into a tree; returns the nodes of the next level that may be split."""
    below = []
    value = lambda g, h: -settings.step * g / (h + settings.penalty)
    for node, (gain, column, bin_, g, h, all_g, all_h) in zip(active.tolist(), splits):
        trees.value[tree, node] = value(all_g, all_h)
        if gain > LEAST_GAIN:
            trees.feature[tree, node], trees.bin[tree, node] = columns[column], bin_
            trees.value[tree, 2 * node + 1] = value(g, h)
            trees.value[tree, 2 * node + 2] = value(all_g - g, all_h - h)
            # A node that cannot give both children their least share of Hessians stays a leaf.
            below += [2 * node + 1 + side for side, x in enumerate((h, all_h - h)) if x >= 2 * settings.least]
    return np.array(below, np.int64)


def _stacked(rounds: list[Trees]) -> dict[str, np.ndarray]:
    names = ("feature", "bin", "value")
    return {n: np.stack([getattr(t, n) for t in rounds]) for n in names}


def fit_part(block: dict, fold: int | None, n_trees: int, n_bins: int, settings: Boosting) -> dict[str, np.ndarray]:
    """All rounds of one model whose rows are one part."""
    rows = _Rows(block, np.zeros((len(block["y"]), n_trees)), fold).joined()
    rounds = []
    for round_ in range(settings.rounds):
        trees = Trees(n_trees, settings.nodes())
        rows.start(settings, round_)
        for tree in range(n_trees):
            active = np.zeros(1, np.int64)
            for level in range(settings.depth):
                sums = rows.sums_below(tree, active, above, sums, n_bins) if level else rows.sums(tree, active, n_bins)
                splits = best_splits(sums, settings)
                above, active = active, plant(trees, tree, active, splits, rows.columns[tree], settings)
                rows.descend(trees, level, tree)
                if not len(active):
                    break
        rows.finish(trees)
        rounds.append(trees)
    return _stacked(rounds)


def _fit_parts(
    parts: RDD, folds: Sequence[int | None], n_trees: int, n_bins: int, width: int, settings: Boosting
) -> list[dict[str, np.ndarray]]:
    """The same rounds over many parts, all folds at once."""
    context = parts.context
    start = lambda block: {**block, "margins": np.zeros((len(folds), len(block["y"]), n_trees))}
    state = parts.map(start).persist(StorageLevel.MEMORY_AND_DISK)
    rounds: list[list[Trees]] = [[] for _ in folds]
    try:
        for round_ in range(settings.rounds):
            grown = [Trees(n_trees, settings.nodes()) for _ in folds]
            active = [[np.zeros(1, np.int64)] * n_trees for _ in folds]
            for level in range(settings.depth):
                asked = context.broadcast((grown, active))  # nodes of one round's trees

                def sums(block: dict, level: int = level, asked=asked, round_: int = round_) -> Iterator[tuple]:
                    grown, active = asked.value
                    for model, fold in enumerate(folds):
                        rows = _Rows(block, block["margins"][model], fold)
                        rows.start(settings, round_)
                        for above in range(level):
                            rows.descend(grown[model], above)
                        for tree in range(n_trees):
                            nodes = active[model][tree]
                            if len(nodes):
                                found = rows.sums(tree, nodes, n_bins).astype(np.int64)
                                for i in range(len(nodes)):
                                    yield (model, tree, i), found[:, i : i + 1]

                met = state.flatMap(sums).reduceByKey(np.add)
                splits = dict(met.mapValues(lambda x: best_splits(x, settings)[0]).collect())  # one per node
                for model in range(len(folds)):
                    for tree in range(n_trees):
                        nodes = active[model][tree]
                        if len(nodes):
                            some = [splits[model, tree, i] for i in range(len(nodes))]
                            columns = settings.chosen_columns(round_, tree, width)
                            active[model][tree] = plant(grown[model], tree, nodes, some, columns, settings)
                asked.unpersist()
                if not any(len(nodes) for per_model in active for nodes in per_model):
                    break
            done = context.broadcast(grown)

            def add(block: dict, done=done) -> dict:
                margins = block["margins"].copy()
                for model, fold in enumerate(folds):
                    rows = _Rows(block, margins[model], fold)
                    rows.finish(done.value[model])
                    margins[model][rows.used] = rows.margins
                return {**block, "margins": margins}

            after = state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
            if (round_ + 1) % CUT == 0:
                after.checkpoint()
            after.count()  # filled before the rows of the round go
            state.unpersist()
            state = after
            for model, trees in enumerate(grown):
                rounds[model].append(trees)
    finally:
        state.unpersist()
    return [_stacked(r) for r in rounds]


def fit_boosted(
    parts: RDD, folds: Sequence[int | None], n_classes: int, edges: list[np.ndarray], settings: Boosting
) -> list[dict[str, np.ndarray]]:
    """One model per entry of ``folds``, learned from the rows outside that fold (None: from all)."""
    n_trees = 1 if n_classes == 2 else n_classes
    n_bins = max(len(e) for e in edges) + 1
    if parts.getNumPartitions() > 1:
        return _fit_parts(parts, folds, n_trees, n_bins, len(edges), settings)

    def without(block: dict) -> Iterator[tuple[int, dict]]:
        for model, fold in enumerate(folds):
            kept = slice(None) if fold is None else block["fold"] != fold
            yield model, {n: v[kept] for n, v in block.items()}

    spread = parts.flatMap(without).partitionBy(len(folds), lambda model: model)
    fitted = spread.map(lambda x: (x[0], fit_part(x[1], None, n_trees, n_bins, settings)))
    found = dict(fitted.collect())  # trees alone, one model per fold
    return [found[model] for model in range(len(folds))]


def margins_of(bins: np.ndarray, trees: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of leaf values per row and tree of a round."""
    rounds, n_trees, nodes = trees["feature"].shape
    feature, split, value = (trees[n].reshape(rounds * n_trees, nodes) for n in ("feature", "bin", "value"))
    out, tree = np.zeros((len(bins), n_trees)), np.arange(rounds * n_trees)
    step = max(1, LOOKED_UP // max(1, rounds * n_trees))
    for at in range(0, len(bins), step):
        some = bins[at : at + step]
        node = np.zeros((len(some), rounds * n_trees), np.int32)
        for _ in range(nodes.bit_length() - 1):
            asked = feature[tree, node]
            right = np.take_along_axis(some, np.maximum(asked, 0), axis=1) > split[tree, node]
            node = np.where(asked >= 0, 2 * node + 1 + right, node)
        out[at : at + step] = value[tree, node].reshape(len(some), rounds, n_trees).sum(axis=1)
    return out


def probabilities(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        p = 1 / (1 + np.exp(-margins[:, 0]))
        return np.stack([1 - p, p], axis=1)
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def packed(arrays: dict[str, np.ndarray]) -> str:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return base64.b64encode(out.getvalue()).decode()


def unpacked(text: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(base64.b64decode(text))) as found:
        return {k: found[k] for k in found.files}


def with_edges(trees: dict[str, np.ndarray], edges: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {**trees, "edges": np.concatenate(edges), "counts": np.array([len(e) for e in edges])}


def edges_of(arrays: dict[str, np.ndarray]) -> list[np.ndarray]:
    return np.split(arrays["edges"], np.cumsum(arrays["counts"])[:-1])


class BoostedTrees(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Probabilities of all classes from fitted trees: a projection in Arrow batches, no shuffle."""

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array column", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "trees and bin edges", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol="_vector", outputCol="_probability", state=""):
        super().__init__()
        self._setDefault(inputCol="_vector", outputCol="_probability")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shipped = dataset.sparkSession.sparkContext.broadcast(self.getOrDefault(self.state))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees = unpacked(shipped.value)
            edges = edges_of(trees)
            for batch in batches:
                values = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, len(edges)))
                found = probabilities(margins_of(to_bins(values, edges), trees))
                yield pd.Series(list(found), index=batch.index)

        # Kept as a projection of its own: merged into a higher-order function it could not be evaluated.
        alone = score.asNondeterministic()
        return dataset.withColumn(self.getOrDefault(self.outputCol), alone(vector_to_array(self.getOrDefault(self.inputCol))))


class BoostedClasses(Estimator):
    """Learner of :class:`BoostedTrees`; ``fit_many`` fits the models of several folds in the same passes."""

    def __init__(self, n_classes: int, bins: int, settings: Boosting):
        super().__init__()
        self.n_classes, self.bins, self.settings = n_classes, bins, settings

    def fit_many(
        self, rows: DataFrame, column: str, folds: Sequence[int | None], n_rows: int, edges: list[np.ndarray] | None = None
    ) -> list[BoostedTrees]:
        """``rows (window_id, y, fold, <column>)``; ``edges`` are those of an earlier binning of the same rows."""
        edges = bin_edges(rows, column, self.bins) if edges is None else edges
        size, n_trees = n_rows * len(edges), 1 if self.n_classes == 2 else self.n_classes
        held = n_rows * (2 * len(edges) + 32 * n_trees + 64)  # bins twice, margins and slopes, rows by node
        parts = blocks(rows, edges, column, 1 if held <= ONE_TASK else -(-size // PART)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            found = fit_boosted(parts, folds, self.n_classes, edges, self.settings)
        finally:
            parts.unpersist()
        return [BoostedTrees(state=packed(with_edges(trees, edges))) for trees in found]

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        rows = dataset.select("window_id", "y", F.lit(0).alias("fold"), vector_to_array("_vector").alias("x"))
        return self.fit_many(rows, "x", [None], rows.count())[0]
