"""Expressions over probability and feature arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Spark re-evaluates an outer expression for every element when it is used inside a
    lambda; passing it as a lambda variable keeps array expressions linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(proba: Column) -> Column:
    return F.array_max(proba)


def softmax(logits: Column) -> Column:
    shifted = bind(
        F.array_max(logits),
        lambda top: F.transform(logits, lambda v: F.exp(v - top)),
    )
    return normalise(shifted)


def normalise(weights: Column) -> Column:
    """Scale non-negative weights to sum to one; null when they sum to zero."""
    return bind(
        weights,
        lambda w: bind(
            array_sum(w),
            lambda total: F.when(total != 0, F.transform(w, lambda v: F.try_divide(v, total))),
        ),
    )


def is_zero_row(proba: Column) -> Column:
    """True when no probability was ever written into the row."""
    return F.forall(proba, lambda v: v == 0)


def hit(predicted: Column, actual: Column) -> Column:
    """1.0 where the prediction is right, else 0.0."""
    return (predicted == actual).cast("double")


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def utc_stamp(ts: Column | None = None) -> Column:
    """ISO-8601 text with a ``Z`` suffix, whatever the session time zone."""
    instant = F.current_timestamp() if ts is None else ts
    utc = F.to_utc_timestamp(instant, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
