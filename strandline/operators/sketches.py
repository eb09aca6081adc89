"""Distinct counts as sketches that are stored, merged and intersected.

A theta sketch keeps the least hashes of what it saw, 2**size of them at most. Below that number counts are exact; beyond,
a union's relative standard error is about 1 / sqrt(2**size), and an intersection's is that of the union, times the union
over the intersection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 14


def standard_error(size: int = SIZE) -> float:
    """Relative standard error of the count of a union that is larger than its sketch."""
    return 1 / math.sqrt(2**size)


def sketch_by(df: DataFrame, keys: Sequence[str], value: str, *, size: int = SIZE, name: str = "sketch") -> DataFrame:
    """keys and a sketch of the different values of each group; nulls aren't values, a group of nulls has no sketch."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.theta_sketch_agg(F.col(value), F.lit(size)).alias(name))


def merged(sketches: DataFrame, keys: Sequence[str], *, size: int = SIZE, name: str = "sketch") -> DataFrame:
    """Sketches of coarser groups, without the rows they were made from."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg(F.col(name), F.lit(size)).alias(name))


def distinct(sketch: Column) -> Column:
    """The count that a sketch stands for."""
    return F.theta_sketch_estimate(sketch)


def both(a: Column, b: Column) -> Column:
    """The count of values that two sketches have in common."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def only_first(a: Column, b: Column) -> Column:
    """The count of values of the first sketch that the second one hasn't got."""
    return F.theta_sketch_estimate(F.theta_difference(a, b))
