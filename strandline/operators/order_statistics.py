"""Order statistics: quantiles of long moving frames, and exact percentiles of groups of any size."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import rolling as R
from strandline.sources.files import staged

#: Values of a block of a frame, at most.
BLOCK = 512
#: Bins of a histogram, and values that are sorted out in the end (of a wanted rank, in one task).
BINS, SORTED = 1024, 100_000
#: Ranges that are broadcast (some tens of bytes each).
MOST_RANGES = 100_000


class OrderedFrame:
    """Values of a moving frame in sorted blocks: adding, removing and picking by rank touch one block of BLOCK values."""

    def __init__(self) -> None:
        self.blocks: list[list[float]] = []
        self.lasts: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.lasts = [[x]], [x]
            return
        i = min(bisect_left(self.lasts, x), len(self.blocks) - 1)
        block = self.blocks[i]
        insort(block, x)
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.lasts[i : i + 1] = [block[half - 1], block[-1]]
        else:
            self.lasts[i] = block[-1]

    def remove(self, x: float) -> None:
        """One of the values equal to ``x``, which must be there."""
        self.size -= 1
        i = bisect_left(self.lasts, x)
        block = self.blocks[i]
        del block[bisect_left(block, x)]
        if block:
            self.lasts[i] = block[-1]
        else:
            del self.blocks[i], self.lasts[i]

    def pick(self, rank: int) -> float:
        for block in self.blocks:
            if rank < len(block):
                return block[rank]
            rank -= len(block)
        raise IndexError(rank)

    def quantile(self, q: float) -> float:
        place = q * (self.size - 1)
        low = math.floor(place)
        value = self.pick(low)
        return value if low == place else value + (self.pick(low + 1) - value) * (place - low)


def moving_quantiles(values: Sequence[float | None], n: int, quantiles: Sequence[float]) -> list[list[float | None] | None]:
    """Interpolated quantiles of the last n values, nulls skipped; null before n values have come, nulls inside without any."""
    frame, inside, out = OrderedFrame(), deque(), []
    for i, x in enumerate(values):
        inside.append(x)
        if x is not None:
            frame.add(x)
        if len(inside) > n and (old := inside.popleft()) is not None:
            frame.remove(old)
        out.append(None if i + 1 < n else [frame.quantile(q) if frame.size else None for q in quantiles])
    return out


def long_quantiles(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, n: int, quantiles: Sequence[float], name: str, chunk: int | None = None) -> DataFrame:
    """Adds ``name``: an array of the ``quantiles`` of the last n rows of a series, null before there are n.

    For frames too long to sort anew in each row: a frame is moved along, and a row costs about the same for any n. NaN
    counts as null, nulls are skipped. Series are cut into chunks with a halo of n - 1 rows, held in memory one at a time.
    """
    if n < 1 or any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("n must be 1 or more, quantiles in [0, 1]")
    keys, chunk = list(keys), max(chunk or R.CHUNK_ROWS, n)
    indexed = R.with_row_index(df, keys, order[0], order[1:], name="__i").withColumn("__x", R.clean(F.col(value).cast("double")))
    kind = T.ArrayType(T.DoubleType())

    def feature(rows: DataFrame, own: list[str]) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])

        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by("__i")
            first = table.column("__i")[0].as_py()
            got = moving_quantiles(table.column("__x").to_pylist(), n, quantiles)
            if first:  # of the copied rows before the chunk the frame is short, and so they are dropped
                got = [x if first + i + 1 >= n else None for i, x in enumerate(got)]
            return table.append_column(name, pa.array(got, pa.list_(pa.float64()))).select(schema.names)

        return rows.groupBy(*own).applyInArrow(work, schema)

    return R.in_chunks(indexed, keys, "__i", n - 1, feature, chunk=chunk).drop("__i", "__x")


def exact_percentiles(df: DataFrame, *, keys: Sequence[str], value: str, probabilities: Sequence[float], few: int | None = None) -> DataFrame:
    """keys, n and percentiles: the exact interpolated percentiles of each group's values, in the order asked for.

    For groups of any size: a histogram of a group's range says in which bin each wanted rank lies; the bin becomes the
    range, until it holds few values or a single one; the values of that bin are sorted. No task holds a group. Each
    round reads the rows once and narrows all ranks of all groups. few (SORTED unless given): values that a task may sort; if
    no group has more, Spark's own exact aggregate is used at once. Nulls and NaN don't count; groups without values, and
    those with a null key, are groups too, with n = 0 and nulls.
    """
    if not probabilities or any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities must be in [0, 1]")
    keys = list(keys)
    named = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], R.clean(F.col(value).cast("double")).alias("__x"))
    few = few or SORTED
    if (rows.groupBy(*named).agg(F.count("__x").alias("n")).agg(F.max("n")).first()[0] or 0) <= few:
        exact = F.percentile("__x", F.array(*[F.lit(float(p)) for p in probabilities]))
        nothing = F.array(*[F.lit(None).cast("double")] * len(probabilities))
        return rows.groupBy(*named).agg(F.count("__x").alias("n"), exact.alias("percentiles")).select(*[F.col(c).alias(k) for c, k in zip(named, keys, strict=True)], "n", F.coalesce("percentiles", nothing).alias("percentiles"))
    wide = f"held > {few} AND low < high"
    whole = staged(rows.groupBy(*named).agg(F.count("__x").alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")), "groups")
    places = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probabilities])
    ranks = F.explode(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p))))))
    # below: values under the range of a rank; held: values in it
    targets = staged(whole.where("n > 0").select(*named, ranks.alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("held")), "ranks")
    while targets.where(wide).limit(1).count():
        targets = staged(_narrowed(rows, targets, named, wide), "ranks")
    single = targets.where("low = high").select(*named, "rank", F.col("low").alias("x"))
    few = targets.where("low < high")
    inside = _within(rows, few, named)
    place = F.row_number().over(Window.partitionBy(*named, "low", "high").orderBy("__x")) - 1
    picked = few.join(inside.withColumn("place", place), _same(few, inside, [*named, "low", "high"]) & (F.col("place") == F.col("rank") - F.col("below")))
    values = single.unionByName(picked.select(*[few[c] for c in named], "rank", F.col("__x").alias("x"))).groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    out = whole.join(values, _same(whole, values, named), "left").select(*[whole[c].alias(k) for c, k in zip(named, keys, strict=True)], "n", "at")

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise(low + (high - low) * (p - F.floor(p)))

    nothing = F.array(*[F.lit(None).cast("double")] * len(probabilities))
    return out.select(*keys, "n", F.when(F.col("n") > 0, F.transform(places, between)).otherwise(nothing).alias("percentiles"))


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(right[c])
    return out


def _within(rows: DataFrame, targets: DataFrame, named: list[str]) -> DataFrame:
    """Rows of the different ranges of ``targets``, with the range; the ranges are broadcast while they are few."""
    ranges = targets.select(*named, "low", "high").distinct()
    if ranges.count() <= MOST_RANGES:
        ranges = F.broadcast(ranges)
    held = rows.join(ranges, _same(rows, ranges, named) & (F.col("__x") >= F.col("low")) & (F.col("__x") <= F.col("high")))
    return held.select(*[rows[c] for c in named], "low", "high", "__x")


def _narrowed(rows: DataFrame, targets: DataFrame, named: list[str], wide: str) -> DataFrame:
    """``targets`` with each wide range cut down to the bin that its rank lies in."""
    broad = targets.where(wide)
    # halves, so that the width of a range can't overflow; infinities have bins of their own
    most = 1.7976931348623157e308
    low, high = (F.greatest(F.least(F.col(c), F.lit(most)), F.lit(-most)) / 2 for c in ("low", "high"))
    share = (F.col("__x") / 2 - low) / (high - low)
    bin_ = F.when(F.col("__x") > most, BINS).when(F.col("__x") < -most, -1).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
    bins = _within(rows, broad, named).groupBy(*named, "low", "high", bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("size"), F.min("__x").alias("first"), F.max("__x").alias("last"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*named, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = bins.withColumn("before", before)
    inside = F.col("rank") - F.col("below")
    met = broad.join(counted, _same(broad, counted, [*named, "low", "high"]) & (inside >= F.col("before")) & (inside < F.col("before") + F.col("size")))
    done = met.select(*[broad[c] for c in named], "rank", F.col("first").alias("low"), F.col("last").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("size").alias("held"))
    return targets.where(f"NOT ({wide})").unionByName(done)
