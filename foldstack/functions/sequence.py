"""Sequence features of one window, as array expressions.

A window is an array of steps, each step an array of channels. Everything here stays inside
the row, so none of it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldstack.functions.arrays import array_mean, array_sum, bind

# Four price channels per step, normalisation epsilon, convolution and patch sizes.
CHANNELS = 4
EPSILON = 1e-5
KERNELS = (3, 5, 7)
PATCHES = (7, 15, 21, 35)


def to_steps(features: Column, channels: int = CHANNELS) -> Column:
    """Flat features to ``T x channels`` when they divide evenly, else one step of all of them."""
    # Values are picked by position: slicing would copy the whole window once per step.
    size = F.size(features)
    cut = F.transform(
        F.sequence(F.lit(0), F.floor(size / channels).cast("int") - 1),
        lambda t: F.array(*[F.get(features, t * channels + c) for c in range(channels)]),
    )
    empty = F.array().cast("array<array<double>>")
    return F.when(size == 0, empty).when(size % channels == 0, cut).otherwise(F.array(features))


def _channel(steps: Column, c: Column) -> Column:
    return F.transform(steps, lambda row: F.get(row, c))


def _per_channel(steps: Column, summarise) -> Column:
    """One value per channel, computed from that channel's series."""

    def each(s: Column) -> Column:
        last = F.size(F.get(s, F.lit(0))) - 1
        return F.transform(F.sequence(F.lit(0), last), lambda c: bind(_channel(s, c), summarise))

    return bind(steps, each)


def instance_norm(steps: Column, epsilon: float = EPSILON) -> Column:
    """Z-score each channel over the window's own steps; a single step passes unchanged."""

    def moments(series: Column) -> Column:
        return bind(
            array_mean(series),
            lambda mean: F.struct(
                mean.alias("mean"),
                F.sqrt(
                    array_mean(F.transform(series, lambda v: (v - mean) * (v - mean))) + epsilon
                ).alias("scale"),
            ),
        )

    def normed(s: Column) -> Column:
        return bind(
            _per_channel(s, moments),
            lambda stats: F.transform(
                s,
                lambda row: F.zip_with(
                    row, stats, lambda v, m: (v - m.getField("mean")) / m.getField("scale")
                ),
            ),
        )

    return bind(steps, lambda s: F.when(F.size(s) > 1, normed(s)).otherwise(s))


def shift_right(steps: Column) -> Column:
    """Each step replaced by the one before it; the first becomes zeros."""
    return bind(
        steps,
        lambda s: F.when(
            F.size(s) > 0,
            F.concat(
                F.array(F.transform(F.get(s, F.lit(0)), lambda v: F.lit(0.0))),
                F.slice(s, F.lit(1), F.size(s) - 1),
            ),
        ).otherwise(s),
    )


def time_mix(steps: Column, mix: float | Sequence[float]) -> Column:
    """``x * m + previous * (1 - m)``, with one ``m`` or one per channel."""

    def blend(now: Column, before: Column) -> Column:
        if isinstance(mix, (int, float)):
            m = F.lit(float(mix))
            return F.zip_with(now, before, lambda a, b: a * m + b * (F.lit(1.0) - m))
        weights = F.array(*[F.lit(float(m)) for m in mix])
        pairs = F.zip_with(now, before, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.zip_with(
            pairs,
            weights,
            lambda p, m: p.getField("a") * m + p.getField("b") * (F.lit(1.0) - m),
        )

    return bind(steps, lambda s: F.zip_with(s, shift_right(s), blend))


def _lag_weights(kernel: int | Sequence[float]) -> list[float]:
    return [1.0 / kernel] * kernel if isinstance(kernel, int) else [float(w) for w in kernel]


def causal_conv(steps: Column, kernels: Sequence[int | Sequence[float]] = KERNELS) -> Column:
    """Left-padded convolutions, one block of output channels per kernel.

    An integer kernel ``k`` averages the current and the ``k - 1`` earlier steps; a list gives
    the weight of each lag, current step first. Steps before the window count as zero.
    """
    weights = [_lag_weights(k) for k in kernels]

    def convolved(s: Column) -> Column:
        def at(row: Column, i: Column) -> Column:
            def block(lags: list[float]) -> Column:
                def out(_: Column, c: Column) -> Column:
                    total = F.lit(0.0)
                    for lag, w in enumerate(lags):
                        value = F.get(F.get(s, i - lag), c)
                        total = total + F.coalesce(value, F.lit(0.0)) * w
                    return total

                return F.transform(row, out)

            return F.concat(*[block(lags) for lags in weights])

        return F.transform(s, at)

    return bind(steps, convolved)


def pool_last(steps: Column) -> Column:
    return F.element_at(steps, -1)


def pool_mean(steps: Column) -> Column:
    return _per_channel(steps, array_mean)


def pooled_conv(steps: Column, kernels: Sequence[int | Sequence[float]] = KERNELS) -> Column:
    """``pool_mean(causal_conv(steps, kernels))`` without building the convolution.

    Every value is met by all lags of a kernel, except that the last ``k - 1`` steps lose the lags
    reaching past the window. So each output is the channel sum times the kernel's total weight,
    less what those few steps lose.
    """
    reach = [list(accumulate(_lag_weights(k))) for k in kernels]

    def pooled(series: Column) -> Column:
        n = F.size(series)

        def one(shares: list[float], total: Column) -> Column:
            value = total * shares[-1]
            for back, share in enumerate(shares[:-1], start=1):
                late = F.coalesce(F.get(series, n - back), F.lit(0.0))
                value = value - late * (shares[-1] - share)
            return F.try_divide(value, n)

        return bind(array_sum(series), lambda total: F.array(*[one(s, total) for s in reach]))

    return bind(
        _per_channel(steps, pooled),
        lambda outputs: F.concat(*[_channel(outputs, F.lit(i)) for i in range(len(reach))]),
    )


def patch_means(steps: Column, size: int) -> Column:
    """Mean of each run of ``size`` steps; the last run may be shorter."""
    return bind(
        steps,
        lambda s: F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(s) / size).cast("int") - 1),
            lambda p: bind(
                F.slice(s, p * size + 1, F.lit(size)), lambda run: _per_channel(run, array_mean)
            ),
        ),
    )
