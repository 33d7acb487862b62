"""Random forests of unlimited depth under a keyed bootstrap, on features binned once.

Whether and how often a tree draws a row is a Poisson weight from a hash of (seed, tree, window id), and the columns a
node may split on come from a hash of its path, so a table gives the same forest on any partitioning. Class weights
are balanced per tree over what it drew. A row no tree drew is out of its bag, and its votes come from one pass.

Large tables grow level by level: each part of the rows counts classes per (tree, node, column, bin), counts meet by key
in a combined shuffle, and only the chosen splits reach the driver. A node that drew at most ``LOCAL`` rows is finished
where its rows meet, one group per node. A table of at most ``ONE_TASK`` bytes is broadcast and its trees are
finished whole, each in a task. Counts are whole numbers, so both ways give the same trees.

Trees of unlimited depth grow with the rows, so a forest never meets the driver: tasks write its trees to files in the
shared folder, a saved model has a copy of them, and scoring reads some trees at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstack.operators.binning import bin_edges, blocks, keyed, matrix, mixed, shares, to_bins
from foldstack.plans.boosting import PART, edges_of, packed, unpacked, with_edges
from foldstack.sources import artifacts
from foldstack.sources.scratch import scratch_uri

#: Bytes of a table as it is broadcast, binned rows with their keys, up to which trees grow whole, each in a task.
ONE_TASK = 64 * 1024**2
#: Rows drawn by a node up to which its subtree is finished in one group.
LOCAL = 1 << 16
#: Trees that grow level by level at a time.
TOGETHER = 64
#: Chances of drawing a row at most 0, 1, .. times: Poisson of mean 1.
DRAWS = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])
#: Draws in looked-at columns that are sorted at a time, and counts by class that are weighed, so that they stay in cache.
DRAWN, WEIGHED = 1 << 18, 1 << 18
#: Counts by bin and class of large nodes at a time, and classes up to which small nodes are weighed class by class.
CELLS, FEW = 1 << 19, 3
#: Leaves looked up at a time when scoring.
LOOKED_UP = 1 << 20
#: Trees read at a time, and rows scored by one pass over a stored forest.
READ, AT_ONCE = 16, 1 << 17
#: Arrays of a stored tree, in its bytes.
STORED = {"feature": np.int32, "bin": np.uint8, "left": np.int32, "share": np.float32}
STORED_SCHEMA = ", ".join(["tree long", *(f"{n} binary" for n in STORED)])


@dataclass(frozen=True)
class Growing:
    """Settings of a forest; no ``depth`` is no limit, ``columns`` is the number a node looks at."""

    trees: int
    columns: int
    depth: int | None = None
    leaf: int = 1
    seed: int = 0

    def root(self, tree: int) -> np.ndarray:
        return np.array([keyed(self.seed, 4, tree)])

    def draws(self, tree: int, keys: np.ndarray) -> np.ndarray:
        """How often a tree draws each row."""
        return np.searchsorted(DRAWS, shares(keys, keyed(self.seed, 3, tree)), side="right")


def balanced(counts: np.ndarray) -> np.ndarray:
    """Weights ``n / (classes * n of the class)`` over the classes that a tree drew."""
    present = counts > 0
    return np.where(present, counts.sum() / (max(1, present.sum()) * np.maximum(counts, 1)), 0.0)


def columns_of(paths: np.ndarray, width: int, n: int) -> np.ndarray:
    """The columns that nodes look at, in the order of a hash of their paths."""
    drawn = mixed(paths[:, None] ^ (np.arange(width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.argsort(drawn, axis=1)[:, :n]  # mixed numbers of different columns differ: there are no equals


def children(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and right child of each node, one after another."""
    return np.stack([mixed(paths + np.uint64(1)), mixed(paths + np.uint64(2))], axis=1).ravel()


def cells_of(cells: np.ndarray, y: np.ndarray, w: np.ndarray, n_cells: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order and the draws of each class in them; dense where that is smaller, else by sorting."""
    if n_cells * n_classes <= 8 * len(cells):
        counts = np.bincount(cells * n_classes + y, w, n_cells * n_classes).reshape(n_cells, n_classes).astype(np.int64)
        found = np.flatnonzero(counts.any(axis=1))
        return found, counts[found]
    found, where = np.unique(cells, return_inverse=True)
    counts = np.bincount(where * n_classes + y, w, len(found) * n_classes).reshape(len(found), n_classes)
    return found, counts.astype(np.int64)


def choose(found: np.ndarray, counts: np.ndarray, totals: np.ndarray, weights: np.ndarray, n_bins: int, n_columns: int, leaf: int):
    """``(node, column, bin)`` of the purest division of each node that has one; cells are (node, column, bin)."""
    segment = found // n_bins
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    upto = np.cumsum(counts, axis=0)
    base = np.repeat(upto[first] - counts[first], np.diff(np.r_[first, len(found)]), axis=0)
    node = segment // n_columns
    left = upto - base
    right = totals[node] - left
    fits = (left.sum(axis=1) >= leaf) & (right.sum(axis=1) >= leaf)
    found, node, left, right = found[fits], node[fits], left[fits] * weights, right[fits] * weights
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    score = _score(left, right)
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    best = np.repeat(np.maximum.reduceat(score, start), np.diff(np.r_[start, len(node)]))
    at = np.flatnonzero(score == best)
    nodes, place = np.unique(node[at], return_index=True)  # the first of equals
    cell = found[at[place]]
    return nodes, cell // n_bins % n_columns, cell % n_bins


def _first_best(owner: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The place of the highest score of each owner, the first of equals; owners are in order."""
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    top = np.repeat(np.maximum.reduceat(score, begin), np.diff(np.r_[begin, len(owner)]))
    equal = np.flatnonzero(score == top)
    return equal[np.unique(owner[equal], return_index=True)[1]]


def divide_dense(
    values: np.ndarray, nodes: np.ndarray, y: np.ndarray, w: np.ndarray, totals: np.ndarray, weights: np.ndarray, n_bins: int, leaf: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`choose` finds where nodes have many rows: every bin is counted, and scores are products of matrices.

    Their rounding is bounded, and the divisions that may be the best by that bound are weighed as :func:`choose` does,
    so the result is the same to the last bit.
    """
    n_columns, (n_nodes, n_classes) = values.shape[1], totals.shape
    cells = (nodes[:, None] * n_columns + np.arange(n_columns)) * n_classes + y[:, None]
    cells = (cells * n_bins + values).ravel()
    shape = (n_nodes, n_columns, n_classes, n_bins)
    upto = np.bincount(cells, np.repeat(w, n_columns), int(np.prod(shape))).reshape(shape)
    np.cumsum(upto, axis=-1, out=upto)
    weighed = totals * weights
    whole, squared = weighed.sum(axis=1)[:, None, None], (weighed * weighed).sum(axis=1)[:, None, None]
    rows = np.stack([np.broadcast_to(weights, totals.shape), weighed * weights, np.ones(totals.shape)], axis=1)
    weight, across, drawn = np.moveaxis(np.matmul(rows[:, None], upto), 2, 0)
    left = np.matmul(weights * weights, upto * upto)
    fits = (drawn >= leaf) & (totals.sum(axis=1)[:, None, None] - drawn >= leaf)
    fits[:, :, 1:] &= drawn[:, :, 1:] != drawn[:, :, :-1]  # an empty bin divides as the one before
    slack = 64 * np.finfo(float).eps * (n_classes + 16)
    one_side, other_side = np.maximum(weight, slack * whole), np.maximum(whole - weight, slack * whole)
    score = left / one_side + (squared - 2 * across + left) / other_side
    slack = slack * whole * whole / np.minimum(one_side, other_side)
    score[~fits] = -np.inf
    least = (score - slack).max(axis=(1, 2), keepdims=True)
    node, column, bin_ = np.nonzero(fits & (score + slack >= least))
    if not len(node):
        return (np.zeros(0, np.int64),) * 3
    counts = upto[node, column, :, bin_].astype(np.int64)
    best = _first_best(node, _score(counts * weights, (totals[node] - counts) * weights))
    return node[best], column[best], bin_[best]


def divide(
    values: np.ndarray, nodes: np.ndarray, y: np.ndarray, w: np.ndarray, totals: np.ndarray, weights: np.ndarray, leaf: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`choose` finds where nodes have few rows, without a number per class in each cell.

    Every drawn row changes the purity of both sides by a term of its own, so running sums over sorted rows give the
    score of each division but for a rounding whose bound is known. Only divisions that may be the best one by that
    bound are counted by class and weighed as :func:`choose` does; the result is the same to the last bit.
    """
    n_rows, n_columns = values.shape
    n_classes, u, size = len(weights), np.uint64, values.size
    bits = u(max(1, n_rows.bit_length()))
    keys = np.arange(n_columns) + (nodes * n_columns)[:, None] << int(bits) + 8
    keys += values.astype(np.int64) << int(bits)
    keys += np.arange(n_rows)[:, None]
    keys = np.sort(keys.view(u).ravel())  # by node, column, bin and row
    row = (keys & u((1 << int(bits)) - 1)).astype(np.int64)
    cell = keys >> bits
    segment = (cell >> u(8)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    # A division is behind the last row of a bin, if not of its segment: a node and a column of it.
    fits = np.r_[(cell[1:] != cell[:-1]) & (segment[1:] == segment[:-1]), False]
    # How many draws of a row's class came before it in its segment.
    shift = u(max(1, size.bit_length()))
    by_class = np.sort((((segment * n_classes + y[row]) << int(shift)) + np.arange(size)).view(u))
    at = (by_class & u((1 << int(shift)) - 1)).astype(np.int64)
    ordered = w[row[at]]
    upto = np.cumsum(ordered)
    upto -= ordered
    group = by_class >> shift
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    before = np.empty(size)
    before[at] = upto - np.repeat(upto[heads], np.diff(np.r_[heads, size]))
    # Shares of a node's weight: running sums begin each segment by taking back what the last one came to.
    weighed = totals * weights
    all_weight = weighed.sum(axis=1)
    share = weighed / all_weight[:, None]
    squared = (share * share).sum(axis=1)
    one = weights[y] / all_weight[nodes]
    part = one * w
    whole = squared[segment[starts] // n_columns]
    left = (2 * one * part)[row] * before
    left += (part * part)[row]
    right = left - (2 * part * share[nodes, y])[row]
    weight = part[row]
    left[starts[1:]] -= whole[:-1]
    right[starts] += whole
    weight[starts[1:]] -= 1
    for sums in (left, right, weight):
        np.cumsum(sums, out=sums)
    if leaf > 1:
        drawn = np.cumsum(w[row])
        sizes = np.diff(np.r_[starts, size])
        drawn -= np.repeat(np.r_[0, drawn[starts[1:] - 1]], sizes)
        fits &= (drawn >= leaf) & (np.repeat(totals.sum(axis=1)[segment[starts] // n_columns], sizes) - drawn >= leaf)
    slack = 16 * np.finfo(float).eps * (size + 16)
    other = 1 - weight
    np.maximum(weight, slack, out=weight)
    np.maximum(other, slack, out=other)
    left /= weight
    right /= other
    left += right
    left[~fits] = -np.inf
    error = slack / np.minimum(weight, other, out=weight)
    begin = starts[np.flatnonzero(np.r_[True, np.diff(segment[starts] // n_columns) > 0])]
    least = np.maximum.reduceat(left - error, begin)
    left += error
    ends = np.flatnonzero((left >= np.repeat(least, np.diff(np.r_[begin, size]))) & fits)
    if not len(ends):
        return (np.zeros(0, np.int64),) * 3
    owner = segment[ends] // n_columns
    score = np.zeros(len(ends))
    several = np.flatnonzero(np.bincount(owner)[owner] > 1)
    behind = np.searchsorted(starts, ends, side="right") - 1
    for i in range(0, len(several), max(1, WEIGHED // n_classes)):
        here = several[i : i + max(1, WEIGHED // n_classes)]
        begin, end = starts[behind[here]], ends[here]
        lengths = end - begin + 1
        if lengths.sum() <= 4 * n_classes * len(here):
            of = np.repeat(np.arange(len(here)), lengths)
            some = row[np.arange(len(of)) + np.repeat(begin - np.cumsum(lengths) + lengths, lengths)]
            found = np.bincount(of * n_classes + y[some], w[some], len(here) * n_classes)
        else:
            wanted = (segment[end][:, None] * n_classes + np.arange(n_classes)) << int(shift)
            sums = np.r_[upto, upto[-1] + ordered[-1]]
            low, high = (np.searchsorted(by_class, x.ravel().view(u), side=s) for x, s in ((wanted, "left"), (wanted + end[:, None], "right")))
            found = sums[high] - sums[low]
        counts = found.reshape(len(here), n_classes).astype(np.int64)
        score[here] = _score(counts * weights, (totals[owner[here]] - counts) * weights)
    best = _first_best(owner, score)
    chosen = cell[ends[best]].astype(np.int64)
    return owner[best], (chosen >> 8) % n_columns, chosen & 255


def _score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * left).sum(axis=1) / left.sum(axis=1) + (right * right).sum(axis=1) / right.sum(axis=1)


def _split(
    values: np.ndarray, nodes: np.ndarray, y: np.ndarray, w: np.ndarray, totals: np.ndarray, weights: np.ndarray, n_bins: int, leaf: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best division of each node, nodes of many rows and of few each in their way."""
    n_columns, n_classes, n_nodes = values.shape[1], len(weights), len(totals)
    if n_classes <= FEW:
        cells = ((nodes[:, None] * n_columns + np.arange(n_columns)) * n_bins + values).ravel()
        cells, counts = cells_of(cells, np.repeat(y, n_columns), np.repeat(w, n_columns), n_nodes * n_columns * n_bins, n_classes)
        return choose(cells, counts, totals, weights, n_bins, n_columns, leaf)
    many = np.bincount(nodes, minlength=n_nodes) * 10 >= n_bins * max(10, n_classes)
    step = max(1, CELLS // (n_columns * n_classes * n_bins))
    large, small = np.flatnonzero(many), np.flatnonzero(~many)
    groups = [large[at : at + step] for at in range(0, len(large), step)] + [small] * (len(small) > 0)
    number, group = np.empty(n_nodes, np.int64), np.empty(n_nodes, np.int64)
    for i, asked in enumerate(groups):
        number[asked], group[asked] = np.arange(len(asked)), i
    of, out = group[nodes], []
    for i, asked in enumerate(groups):
        rows = np.flatnonzero(of == i)
        some = values[rows], number[nodes[rows]], y[rows], w[rows], totals[asked], weights
        node, column, bin_ = divide(*some, leaf) if i * step >= len(large) else divide_dense(*some, n_bins, leaf)
        out.append((asked[node], column, bin_))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pieces(nodes: np.ndarray, n_nodes: int, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of nodes with about so many rows, a larger node alone, and the places of their rows."""
    if len(nodes) <= rows:
        yield 0, n_nodes, np.arange(len(nodes))
        return
    order, upto = np.argsort(nodes, kind="stable"), np.cumsum(np.bincount(nodes, minlength=n_nodes))
    first = 0
    while first < n_nodes:
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + rows, side="right")))
        yield first, last, order[done : upto[last - 1]]
        first = last


def grow(
    bins: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, path: np.ndarray, n_bins: int, settings: Growing, depth: int = 0
) -> dict[str, np.ndarray]:
    """The subtree of one node from the rows it drew, all nodes of a level at once.

    ``feature`` is -1 in a leaf, ``left`` the place of the left child, the right one follows it; ``counts`` are the
    draws of each class.
    """
    n_classes, width = len(weights), bins.shape[1]
    drawn = np.flatnonzero(w)
    bins, y, w = bins[drawn], y[drawn], w[drawn]
    place, paths, n_nodes = np.zeros(len(y), np.int64), path, 1
    out: list[dict[str, np.ndarray]] = []
    while True:
        totals = np.bincount(place * n_classes + y, w, len(paths) * n_classes).reshape(-1, n_classes).astype(np.int64)
        level = {
            "feature": np.full(len(paths), -1, np.int32),
            "bin": np.zeros(len(paths), np.uint8),
            "left": np.zeros(len(paths), np.int64),
            "counts": totals,
        }
        out.append(level)
        mixed_nodes = ((totals > 0).sum(axis=1) > 1) & (totals.sum(axis=1) >= max(2, 2 * settings.leaf))
        if settings.depth is not None and depth >= settings.depth:
            mixed_nodes[:] = False
        for n_columns in (settings.columns, width):  # where no looked-at column divides a node, all are
            asked = np.flatnonzero(mixed_nodes & (level["feature"] < 0))
            if not len(asked):
                break
            number = np.full(len(paths), -1)
            number[asked] = np.arange(len(asked))
            rows = np.flatnonzero(number[place] >= 0)
            nodes = number[place[rows]]
            for first, last, some in _pieces(nodes, len(asked), max(1, DRAWN // n_columns)):
                here, at = asked[first:last], nodes[some] - first
                columns = columns_of(paths[here], width, n_columns)
                values = bins[rows[some][:, None], columns[at]]
                found = _split(values, at, y[rows[some]], w[rows[some]], totals[here], weights, n_bins, settings.leaf)
                split, column, bin_ = found
                level["feature"][here[split]] = columns[split, column]
                level["bin"][here[split]] = bin_
        split = np.flatnonzero(level["feature"] >= 0)
        if not len(split):
            break
        level["left"][split] = n_nodes + 2 * np.arange(len(split))
        n_nodes += 2 * len(split)
        number = np.full(len(paths), -1)
        number[split] = np.arange(len(split))
        rows = np.flatnonzero(number[place] >= 0)
        at = place[rows]
        right = bins[rows, level["feature"][at]] > level["bin"][at]
        place = 2 * number[at] + right
        bins, y, w = bins[rows], y[rows], w[rows]
        paths = children(paths[split])
        depth += 1
    return {n: np.concatenate([x[n] for x in out]) for n in out[0]}


class _Growth:
    """A tree that grows level by level on the driver's side: small arrays, no rows."""

    def __init__(self, model: int, tree: int, weights: np.ndarray, settings: Growing):
        self.model, self.tree, self.weights = model, tree, weights
        self.feature, self.bin, self.left = [-1], [0], [0]
        self.paths, self.depths, self.counts = [settings.root(tree)[0]], [0], [None]
        self.open: list[tuple[int, int]] = []  # node, columns to look at
        self.ready: list[int] = []

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.bin), np.array(self.left)

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.feature)
        for path in children(np.array([self.paths[node]])):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.paths.append(path)
            self.depths.append(self.depths[node] + 1)
            self.counts.append(None)
        return self.left[node], self.left[node] + 1


def _descend(bins: np.ndarray, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node of each row in one tree as far as it is grown."""
    node = np.zeros(len(bins), np.int64)
    while True:
        rows = np.flatnonzero(feature[node] >= 0)
        if not len(rows):
            return node
        at = node[rows]
        node[rows] = left[at] + (bins[rows, feature[at]] > bin_[at])


def _drawn(block: dict, fold: int | None, tree: int, settings: Growing) -> np.ndarray:
    w = settings.draws(tree, block["key"])
    return w if fold is None else np.where(block["fold"] != fold, w, 0)


def _grow_parts(
    parts: RDD, folds: Sequence[int | None], some: list[tuple[int, int]], n_classes: int, n_bins: int, width: int, settings: Growing
) -> Iterator[RDD]:
    """The trees ``(model, tree)`` of some models, level by level and then node by node: ``(tree, arrays)`` in order.

    Only the levels above ``LOCAL`` are on the driver; subtrees meet their tops in tasks, one tree in each.
    """
    context = parts.context

    def totals(block: dict) -> Iterator[tuple]:
        for i, (model, tree) in enumerate(some):
            yield i, np.bincount(block["y"], _drawn(block, folds[model], tree, settings), n_classes).astype(np.int64)

    drawn = dict(parts.flatMap(totals).reduceByKey(np.add).collect())
    growths = [_Growth(model, tree, balanced(drawn[i]), settings) for i, (model, tree) in enumerate(some)]

    def sort_in(growth: _Growth, node: int, counts: np.ndarray) -> None:
        growth.counts[node] = counts
        large = counts.sum() > LOCAL
        if settings.depth is not None and growth.depths[node] >= settings.depth or (counts > 0).sum() < 2:
            return  # a leaf
        if large:
            growth.open.append((node, settings.columns))
        else:
            growth.ready.append(node)

    for growth, counts in zip(growths, (drawn[i] for i in range(len(some)))):
        sort_in(growth, 0, counts)
    while any(g.open for g in growths):
        asked = context.broadcast([(g.model, g.tree, g.arrays(), g.open, [g.paths[n] for n, _ in g.open]) for g in growths])

        def count(block: dict, asked=asked) -> Iterator[tuple]:
            for i, (model, tree, arrays, nodes, paths) in enumerate(asked.value):
                if not nodes:
                    continue
                w = _drawn(block, folds[model], tree, settings)
                place = _descend(block["bins"], *arrays)
                for (node, n_columns), path in zip(nodes, paths):
                    rows = np.flatnonzero((place == node) & (w > 0))
                    columns = columns_of(np.array([path]), width, n_columns)[0]
                    cells = block["bins"][rows[:, None], columns] + np.arange(n_columns) * n_bins
                    cells = (cells * n_classes + block["y"][rows, None]).ravel()
                    found = np.bincount(cells, np.repeat(w[rows], n_columns), n_columns * n_bins * n_classes)
                    yield (i, node), found.astype(np.int64)

        def best(key: tuple, counts: np.ndarray, asked=asked) -> tuple:
            i, node = key
            n_columns = len(counts) // (n_bins * n_classes)
            path = next(p for (n, _), p in zip(*asked.value[i][3:]) if n == node)
            counts = counts.reshape(n_columns * n_bins, n_classes)
            total = counts[:n_bins].sum(axis=0, keepdims=True)
            found = np.flatnonzero(counts.any(axis=1))
            weights = balanced(drawn[i])
            _, column, bin_ = choose(found, counts[found], total, weights, n_bins, n_columns, settings.leaf)
            if not len(column):
                return key, None
            at = column[0] * n_bins
            left = counts[at : at + bin_[0] + 1].sum(axis=0)
            feature = columns_of(np.array([path]), width, n_columns)[0][column[0]]
            return key, (int(feature), int(bin_[0]), left, total[0] - left)

        splits = dict(parts.flatMap(count).reduceByKey(np.add).map(lambda x: best(*x)).collect())  # one per open node
        for i, growth in enumerate(growths):
            pending, growth.open = growth.open, []
            for node, n_columns in pending:
                found = splits[i, node]
                if found is not None:
                    feature, bin_, *sides = found
                    for child, counts in zip(growth.split(node, feature, bin_), sides):
                        sort_in(growth, child, counts)
                elif n_columns < width:
                    growth.open.append((node, width))  # else its rows are all alike: a leaf
        asked.unpersist()

    ends = context.broadcast([(g.model, g.tree, g.arrays(), set(g.ready), g.paths, g.depths, g.counts) for g in growths])

    def deal(block: dict) -> Iterator[tuple]:
        for i, (model, tree, arrays, ready, *_) in enumerate(ends.value):
            w = _drawn(block, folds[model], tree, settings)
            place = np.where(w > 0, _descend(block["bins"], *arrays), -1)
            for node in ready & set(np.unique(place).tolist()):
                rows = np.flatnonzero(place == node)
                yield (i, node), (block["bins"][rows], block["y"][rows], w[rows])

    def finish(key: tuple, groups) -> tuple:
        i, node = key
        _, _, _, _, paths, depths, _ = ends.value[i]
        bins, y, w = map(np.concatenate, zip(*groups))
        return i, (node, grow(bins, y, w, balanced(drawn[i]), np.array([paths[node]]), n_bins, settings, depths[node]))

    def assemble(i: int, subtrees) -> tuple[int, dict[str, np.ndarray]]:
        _, number, (feature, bin_, left), _, _, _, counts = ends.value[i]
        counts = np.stack([np.zeros(n_classes, np.int64) if c is None else c for c in counts])
        pieces = [{"feature": feature.astype(np.int32), "bin": bin_.astype(np.uint8), "left": left, "counts": counts}]
        tree, n_nodes = pieces[0], len(feature)
        for node, below in sorted((x for x in subtrees if x is not None), key=lambda x: x[0]):
            # The subtree's root takes the node's place, the others come behind what is there.
            below["left"] = np.where(below["feature"] >= 0, below["left"] + n_nodes - 1, 0)
            for n in tree:
                tree[n][node] = below[n][0]
            pieces.append({n: below[n][1:] for n in tree})
            n_nodes += len(below["feature"]) - 1
        return number, {n: np.concatenate([x[n] for x in pieces]) for n in tree}

    every = context.parallelize([(i, None) for i in range(len(some))], len(some))  # a tree may have no open end
    finished = parts.flatMap(deal).groupByKey().map(lambda x: finish(*x))
    yield every.union(finished).groupByKey(len(some)).map(lambda x: assemble(*x))  # one tree a partition, in order
    ends.unpersist()


def _whole(block: dict, fold: int | None, tree: int, n_classes: int, n_bins: int, settings: Growing) -> dict[str, np.ndarray]:
    w = _drawn(block, fold, tree, settings)
    weights = balanced(np.bincount(block["y"], w, n_classes).astype(np.int64))
    return grow(block["bins"], block["y"], w, weights, settings.root(tree), n_bins, settings)


def _light(tree: dict[str, np.ndarray], weights_of: np.ndarray) -> dict[str, np.ndarray]:
    """What scoring needs: splits, children, and the weighted share of each class in the leaves."""
    leaf = tree["feature"] < 0
    share = tree["counts"][leaf] * weights_of
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    left = tree["left"].copy()
    left[leaf] = np.arange(int(leaf.sum()))  # a leaf points to its shares
    return {"feature": tree["feature"], "bin": tree["bin"], "left": left.astype(np.int32), "share": share.astype(np.float32)}


def _joined(trees: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Trees one after another; ``roots`` and ``leaves`` are where each begins."""
    out = {n: np.concatenate([t[n] for t in trees]) for n in trees[0]}
    sizes, leaves = [len(t["feature"]) for t in trees], [len(t["share"]) for t in trees]
    out["roots"], out["leaves"] = (np.cumsum([0, *x[:-1]]) for x in (sizes, leaves))
    return out


def grown(parts: RDD, folds: Sequence[int | None], n_classes: int, edges: list[np.ndarray], settings: Growing) -> Iterator[tuple[int, RDD]]:
    """``(model, trees)`` again and again: one model per entry of ``folds``, learned from the rows outside that fold (None: all).

    The trees ``(tree, arrays)`` of a model come in their order and are to be used before the next are asked for.
    """
    n_bins, context = max(len(e) for e in edges) + 1, parts.context
    if parts.getNumPartitions() == 1:
        found = parts.collect()
        block = context.broadcast(found[0] if found else None)  # at most ONE_TASK bytes
        slices = min(settings.trees, 4 * context.defaultParallelism)
        for model, fold in enumerate(folds):

            def whole(tree: int, fold: int | None = fold) -> tuple[int, dict[str, np.ndarray]]:
                return tree, _whole(block.value, fold, tree, n_classes, n_bins, settings)

            yield model, context.parallelize(range(settings.trees), slices).map(whole).mapValues(_scored)
        block.unpersist()
        return
    for model in range(len(folds)):
        for at in range(0, settings.trees, TOGETHER):
            some = [(model, tree) for tree in range(at, min(at + TOGETHER, settings.trees))]
            for trees in _grow_parts(parts, folds, some, n_classes, n_bins, len(edges), settings):
                yield model, trees.mapValues(_scored)


def _scored(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _light(tree, balanced(tree["counts"][0]))


def fit_forest(
    parts: RDD, folds: Sequence[int | None], n_classes: int, edges: list[np.ndarray], settings: Growing
) -> list[dict[str, np.ndarray]]:
    """Small forests as arrays on the driver; :func:`store_forest` keeps those of any size in files."""
    trees: list[list] = [[] for _ in folds]
    for model, some in grown(parts, folds, n_classes, edges, settings):
        trees[model] += some.values().collect()
    return [_joined(t) for t in trees]


def store_forest(
    parts: RDD, folds: Sequence[int | None], n_classes: int, edges: list[np.ndarray], settings: Growing, root: str
) -> list[str]:
    """The folder below ``root`` of each model's trees, which tasks have written: none of them meets the driver."""
    spark, n_written = SparkSession.active(), [0] * len(folds)
    for model, some in grown(parts, folds, n_classes, edges, settings):
        rows = some.map(lambda x: (x[0], *(x[1][n].astype(t).tobytes() for n, t in STORED.items())))
        spark.createDataFrame(rows, STORED_SCHEMA, verifySchema=False).write.parquet(f"{root}/model={model}/part={n_written[model]:06d}")
        n_written[model] += 1
    return [artifacts.qualified(spark, f"{root}/model={model}") for model in range(len(folds))]


def stored_trees(uri: str) -> Iterator[dict[str, np.ndarray]]:
    """A stored forest in pieces of ``READ`` trees, in the order of its trees; ``first`` is the number of the first."""
    system, path = artifacts.opened(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):  # files are numbered in order
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(READ):
                trees = []
                for row in zip(*(batch.column(n) for n in STORED)):
                    tree = {n: np.frombuffer(v.as_buffer(), t) for (n, t), v in zip(STORED.items(), row)}
                    tree["share"] = tree["share"].reshape(int((tree["feature"] < 0).sum()), -1)
                    trees.append(tree)
                if trees:
                    yield {**_joined(trees), "first": batch.column("tree")[0].as_py()}


def votes(
    bins: np.ndarray, forest: dict[str, np.ndarray], counted: np.ndarray | None = None, out: np.ndarray | None = None
) -> np.ndarray:
    """Sum of leaf shares per row over all trees, or over those ``counted`` (row, tree); added to ``out`` if there is one."""
    feature, split, left, share = (forest[n] for n in ("feature", "bin", "left", "share"))
    roots, leaves = forest["roots"], forest["leaves"]
    out = np.zeros((len(bins), share.shape[1])) if out is None else out
    step = max(1, LOOKED_UP // len(roots))
    for at in range(0, len(bins), step):
        some = bins[at : at + step]
        node = np.broadcast_to(roots, (len(some), len(roots))).copy()
        offset = np.zeros_like(node)
        while True:
            here = roots + offset
            asked = feature[here]
            moves = asked >= 0
            if not moves.any():
                break
            right = np.take_along_axis(some, np.maximum(asked, 0), axis=1) > split[here]
            offset = np.where(moves, left[here] + right, offset)
        leaf = leaves + left[roots + offset]
        for tree in range(len(roots)):
            part = share[leaf[:, tree]]
            if counted is not None:
                part = part * counted[at : at + step, tree, None]
            out[at : at + step] += part
    return out


def _gathered(batches: Iterator, rows: int) -> Iterator[list]:
    """Batches in lists of at least so many rows, the last with what is left."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= rows:
            yield some
            some, n = [], 0
    if some:
        yield some


@dataclass(frozen=True)
class _Binned:
    """A batch to score: its index and the bins of its rows."""

    index: pd.Index
    bins: np.ndarray

    def __len__(self) -> int:
        return len(self.bins)


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        model = self.instance
        trees = SparkSession.active().read.schema(STORED_SCHEMA).parquet(f"{model.getOrDefault(model.stored)}/part=*")
        files = max(1, model.getOrDefault(model.trees) // READ)
        # Ranges of trees, so that the files are in their order again.
        trees.repartitionByRange(files, "tree").sortWithinPartitions("tree").write.parquet(f"{path}/trees/part=000000")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ForestTrees:
        model = super().load(path)
        return model._set(stored=artifacts.qualified(SparkSession.active(), f"{path}/trees"))


class ForestTrees(Transformer, MLReadable, MLWritable):
    """Mean class shares over all trees: a projection in Arrow batches, no shuffle.

    Tasks read the trees from their files, some at a time, once for each ``AT_ONCE`` rows; a stored model has a copy of
    its own.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array column", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "bin edges", TypeConverters.toString)
    stored = Param(Params._dummy(), "stored", "folder of the trees", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="_vector", outputCol="_probability", state="", stored="", trees=0, classes=0, seed=0):
        super().__init__()
        self._setDefault(inputCol="_vector", outputCol="_probability")
        self._set(**self._input_kwargs)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges = edges_of(unpacked(self.getOrDefault(self.state)))
        stored, trees, classes = (self.getOrDefault(x) for x in (self.stored, self.trees, self.classes))

        @F.pandas_udf("array<double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            binned = ((x.index, to_bins(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(edges))), edges)) for x in batches)
            for some in _gathered((_Binned(*x) for x in binned), AT_ONCE):
                bins = np.concatenate([x.bins for x in some])
                found = np.zeros((len(bins), classes))
                if len(bins):
                    for forest in stored_trees(stored):
                        votes(bins, forest, out=found)
                found /= trees
                at = 0
                for x in some:
                    yield pd.Series(list(found[at : at + len(x)]), index=x.index, dtype=object)
                    at += len(x)

        # Kept as a projection of its own: merged into a higher-order function it could not be evaluated.
        alone = score.asNondeterministic()
        return dataset.withColumn(self.getOrDefault(self.outputCol), alone(vector_to_array(self.getOrDefault(self.inputCol))))

    def out_of_bag(self, rows: DataFrame, column: str = "features") -> DataFrame:
        """``(window_id, y, trees, proba)`` of the rows learned from, voted on by the trees that did not draw them.

        One pass without a shuffle; a row that every tree drew has zero trees and a null ``proba``.
        """
        edges = edges_of(unpacked(self.getOrDefault(self.state)))
        stored, classes = self.getOrDefault(self.stored), self.getOrDefault(self.classes)
        drawing = Growing(self.getOrDefault(self.trees), 1, seed=self.getOrDefault(self.seed))

        def run(batches):
            import pyarrow as pa

            for some in _gathered(batches, AT_ONCE):
                bins = np.concatenate([to_bins(matrix(b.column("x"), len(edges)), edges) for b in some])
                keys = np.concatenate([b.column("key").to_numpy() for b in some]).view(np.uint64)
                share, trees = np.zeros((len(bins), classes)), np.zeros(len(bins), np.int64)
                for forest in stored_trees(stored) if len(bins) else ():
                    numbers = range(forest["first"], forest["first"] + len(forest["roots"]))
                    out = np.stack([drawing.draws(t, keys) == 0 for t in numbers], axis=1)
                    trees += out.sum(axis=1)
                    votes(bins, forest, out, share)
                share /= np.maximum(trees, 1)[:, None]
                at = 0
                for batch in some:
                    here = slice(at, at + len(batch))
                    proba = pa.array([p if n else None for p, n in zip(share[here].tolist(), trees[here])], pa.list_(pa.float64()))
                    yield pa.record_batch(
                        [batch.column("window_id"), batch.column("y"), pa.array(trees[here]), proba],
                        names=["window_id", "y", "trees", "proba"],
                    )
                    at += len(batch)

        narrow = rows.select(
            F.col("window_id").cast("string").alias("window_id"), F.col("y").cast("int").alias("y"),
            F.col(column).cast("array<double>").alias("x"), F.xxhash64("window_id").alias("key"),
        )
        return narrow.mapInArrow(run, "window_id string, y int, trees long, proba array<double>")


class ForestClasses(Estimator):
    """Learner of :class:`ForestTrees`; ``fit_many`` fits the forests of several folds in the same passes."""

    def __init__(self, n_classes: int, bins: int, settings: Growing):
        super().__init__()
        self.n_classes, self.bins, self.settings = n_classes, bins, settings

    def fit_many(
        self, rows: DataFrame, column: str, folds: Sequence[int | None], n_rows: int, edges: list[np.ndarray] | None = None
    ) -> list[ForestTrees]:
        """``rows (window_id, y, fold, <column>)``; ``edges`` are those of an earlier binning of the same rows."""
        edges = bin_edges(rows, column, self.bins) if edges is None else edges
        size = n_rows * len(edges)
        whole = n_rows * (len(edges) + 16) <= ONE_TASK
        parts = blocks(rows, edges, column, 1 if whole else -(-size // PART)).persist(StorageLevel.MEMORY_AND_DISK)
        root = scratch_uri(rows.sparkSession, "forest")
        try:
            found = store_forest(parts, folds, self.n_classes, edges, self.settings, root)
        finally:
            parts.unpersist()
        state, trees, seed = packed(with_edges({}, edges)), self.settings.trees, self.settings.seed
        return [ForestTrees(state=state, stored=folder, trees=trees, classes=self.n_classes, seed=seed) for folder in found]

    def _fit(self, dataset: DataFrame) -> ForestTrees:
        rows = dataset.select("window_id", "y", F.lit(0).alias("fold"), vector_to_array("_vector").alias("x"))
        return self.fit_many(rows, "x", [None], rows.count())[0]
