"""Distribution expressions on arrays of doubles (one array a row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)


def known_total(x: Column) -> Column:
    """Sum of the elements that aren't null; null if there are none, like SQL's sum."""
    return F.aggregate(x, F.lit(None).cast("double"), lambda a, y: F.when(y.isNull(), a).otherwise(F.coalesce(a, F.lit(0.0)) + y))


def softmax(x: Column) -> Column:
    shifted = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda y: F.exp(y - top)))
    return let(let(x, shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda y: y / s)))


def log_softmax(x: Column) -> Column:
    return let(x, lambda v: let(F.array_max(v), lambda top: let(F.log(total(F.transform(v, lambda y: F.exp(y - top)))), lambda z: F.transform(v, lambda y: y - top - z))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(x: Column) -> Column:
    """0-based position of the first greatest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(target: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == target, 1.0).otherwise(0.0))


def cumulative(x: Column) -> Column:
    """Inclusive running sums."""
    return F.aggregate(x, F.array().cast("array<double>"), lambda a, y: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + y)))


def finite_or_zero(x: Column) -> Column:
    ok = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(x.isNotNull() & ok, x).otherwise(F.lit(0.0))


def log_likelihood(p: Column, target: Column) -> Column:
    return F.log(F.greatest(F.get(p, target), F.lit(EPSILON)))


def brier(p: Column, target: Column) -> Column:
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == target, 1.0).otherwise(0.0), F.lit(2.0))))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(EPSILON)))))


def mean_of(p: Column, centers: Column) -> Column:
    return dot(p, centers)


def std_of(p: Column, centers: Column) -> Column:
    return let(dot(p, centers), lambda m: F.sqrt(F.greatest(total(F.zip_with(p, centers, lambda x, c: x * c * c)) - m * m, F.lit(EPSILON))))


def emd(p: Column, q: Column, power: int = 1) -> Column:
    """Earth mover's distance of distributions on equal buckets, by their cumulative sums."""
    if power not in (1, 2):
        raise ValueError("power must be 1 or 2")
    gaps = F.zip_with(cumulative(p), cumulative(q), lambda a, b: a - b)
    return total(F.transform(gaps, F.abs)) if power == 1 else F.sqrt(total(F.transform(gaps, lambda g: g * g)))


def soft_cross_entropy(logits: Column, labels: Column) -> Column:
    return -dot(labels, log_softmax(logits))


def focal(p_target: Column, gamma: float = 2.0) -> Column:
    if gamma < 0:
        raise ValueError("gamma must be 0 or more")
    return F.pow(F.lit(1.0) - p_target, F.lit(float(gamma))) * -F.log(F.greatest(p_target, F.lit(EPSILON)))


def sums_to_one(p: Column, tolerance: float = 0.01) -> Column:
    return F.abs(total(p) - 1) <= tolerance
