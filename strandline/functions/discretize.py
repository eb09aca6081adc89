"""Return, volatility and volume buckets, their centers and soft labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import arrays as A


@dataclass(frozen=True)
class Buckets:
    """``edges`` (n + 1, rising, evenly spaced in the value or its logarithm) and ``centers`` (n)."""

    edges: tuple[float, ...]
    centers: tuple[float, ...]
    log_scale: bool = False

    @property
    def n(self) -> int:
        return len(self.centers)

    def bucket(self, value: Column) -> Column:
        """Upper edges strictly below the value, at most n - 1: a value on an edge goes to the lower bucket; null stays null.

        The even spacing gives the place to within one; the edges themselves decide, so no search walks them all.
        """
        low, high = self.edges[0], self.edges[-1]
        x = F.greatest(F.least(value, F.lit(high)), F.lit(low))
        place = F.log(x / F.lit(low)) / F.lit(math.log(high / low)) if self.log_scale else (x - F.lit(low)) / F.lit(high - low)
        near = F.greatest(F.least(F.floor(place * F.lit(float(self.n))).cast("int"), F.lit(self.n - 1)), F.lit(0))
        edges = F.array(*map(F.lit, self.edges))
        moved = near + F.when(F.get(edges, near + 1) < value, 1).when(F.get(edges, near) >= value, -1).otherwise(0)
        return F.when(value.isNotNull(), F.greatest(F.least(moved, F.lit(self.n - 1)), F.lit(0)))

    def center(self, bucket: Column) -> Column:
        """Center of a bucket; an error outside 0..n-1."""
        inside = (bucket >= 0) & (bucket < self.n)
        return F.when(bucket.isNull(), F.lit(None).cast("double")).when(inside, F.get(F.array(*map(F.lit, self.centers)), bucket)).otherwise(F.raise_error(F.lit("bucket out of range")).cast("double"))

    def bucket_of(self, value: float) -> int:
        return min(sum(b < value for b in self.edges[1:]), self.n - 1)

    def soft_labels(self, bucket: Column, sigma: float) -> Column:
        """Gaussian weights around a bucket that sum to 1; an error outside 0..n-1."""
        if sigma <= 0:
            raise ValueError("sigma must be positive")
        weights = F.transform(F.sequence(F.lit(0), F.lit(self.n - 1)), lambda i: F.exp(F.lit(-0.5) * F.pow((i - bucket) / F.lit(float(sigma)), F.lit(2.0))))
        # the sum is made once a row, not once an element
        normal = A.let(weights, lambda w: A.let(A.total(w), lambda s: F.transform(w, lambda x: x / s)))
        return F.when((bucket >= 0) & (bucket < self.n), normal).otherwise(F.when(bucket.isNotNull(), F.raise_error(F.lit("bucket out of range")).cast("array<double>")))


def _linear(low: float, high: float, n: int) -> Buckets:
    edges = np.linspace(low, high, n + 1)
    return Buckets(tuple(map(float, edges)), tuple(map(float, (edges[:-1] + edges[1:]) / 2)))


def return_buckets(n: int = 101, low: float = -50.0, high: float = 50.0) -> Buckets:
    """Log returns in basis points; n is odd so that one bucket holds zero."""
    if n < 3 or n % 2 == 0 or low >= high:
        raise ValueError("n must be odd and 3 or more, low below high")
    return _linear(low, high, n)


def zero_bucket(buckets: Buckets) -> int:
    return buckets.n // 2


def volatility_buckets(n: int = 51, low: float = 5.0, high: float = 150.0) -> Buckets:
    """Annualised percent."""
    if n < 2 or not 0 <= low < high:
        raise ValueError("n must be 2 or more, 0 <= low < high")
    return _linear(low, high, n)


def volume_buckets(n: int = 51, low: float = 0.1, high: float = 5.0, log_scale: bool = True) -> Buckets:
    """Ratios to the average volume, by default evenly spaced in their logarithm."""
    if n < 2 or not 0 < low < high:
        raise ValueError("n must be 2 or more, 0 < low < high")
    if not log_scale:
        return _linear(low, high, n)
    edges = np.geomspace(low, high, n + 1)
    return Buckets(tuple(map(float, edges)), tuple(math.sqrt(a * b) for a, b in zip(edges[:-1], edges[1:], strict=True)), True)


def average_volume_bucket(buckets: Buckets) -> int:
    return buckets.bucket_of(1.0)


def log_return_bps(current: Column, reference: Column, *, strict: bool = False) -> Column:
    """ln(current / reference) in basis points; where one isn't positive null, or an error if ``strict``."""
    bad = F.raise_error(F.lit("prices must be positive")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((current > 0) & (reference > 0), F.log(F.try_divide(current, reference)) * F.lit(1e4)).otherwise(bad)
