"""Recurrences y[i] = a[i] * y[i-1] + b[i] along a series, in chunks: a chunk is itself such a map.

The maps of the rows of a chunk compose to one; the chunks' maps, one row each, give the value that each chunk starts
from, and every chunk is worked through by itself from there. So a series spreads over many tasks, and nothing but one row
a chunk meets in a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import rolling as R

#: Rows of a chunk: a Python task holds one at a time.
SCAN_ROWS = 50_000


def _run(a: pa.ChunkedArray, b: pa.ChunkedArray, start: float) -> tuple[list[float], float]:
    """Values from ``start`` on, and the product of the factors."""
    out, y, whole = [], start, 1.0
    for x, z in zip(a.to_pylist(), b.to_pylist(), strict=True):
        y = x * y + z
        whole *= x
        out.append(y)
    return out, whole


def affine_scan(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], maps: Mapping[str, tuple[Column, Column]], chunk: int | None = None, tasks: int = 0) -> DataFrame:
    """Adds a column for each of ``maps``, by name: y = a * y_before + b from 0, with (a, b) as columns of each row.

    A null a is 1 and a null b is 0, so that such a row changes nothing. ``order`` starts with a timestamp and is total.
    A chunk of rows (SCAN_ROWS unless given) is held in memory; results differ between chunk sizes by rounding alone.
    tasks: over how many tasks the rows go, if these are more than Spark's own number.
    """
    chunk = chunk or min(SCAN_ROWS, R.CHUNK_ROWS)
    if chunk < 1:
        raise ValueError("chunk must be 1 or more")
    names, keys = list(maps), list(keys)
    factors = {f"__a{i}": F.coalesce(maps[n][0].cast("double"), F.lit(1.0)) for i, n in enumerate(names)}
    terms = {f"__b{i}": F.coalesce(maps[n][1].cast("double"), F.lit(0.0)) for i, n in enumerate(names)}
    rows = df.withColumns(factors | terms)
    indexed = R.with_row_index(rows, keys, order[0], order[1:], name="__i", tasks=tasks).withColumn("__chunk", F.floor(F.col("__i") / F.lit(chunk)))

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        out = {k: table.column(k)[:1] for k in (*keys, "__chunk")}
        for i in range(len(names)):
            values, whole = _run(table.column(f"__a{i}"), table.column(f"__b{i}"), 0.0)
            out |= {f"__a{i}": pa.array([whole]), f"__b{i}": pa.array([values[-1]])}
        return pa.table(out)

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("__chunk")
        out = {k: table.column(k) for k in (*keys, "__chunk")}
        for i in range(len(names)):
            values, _ = _run(table.column(f"__a{i}"), table.column(f"__b{i}"), 0.0)
            out[f"__y{i}"] = pa.array([0.0, *values[:-1]])
        return pa.table(out)

    def worked(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        for i, name in enumerate(names):
            values, _ = _run(table.column(f"__a{i}"), table.column(f"__b{i}"), table.column(f"__y{i}")[0].as_py())
            table = table.append_column(name, pa.array(values, pa.float64()))
        return table.select([f.name for f in result])

    fields = lambda prefix: [T.StructField(f"{prefix}{i}", T.DoubleType()) for i in range(len(names))]
    of_chunk = [*(indexed.schema[k] for k in keys), T.StructField("__chunk", T.LongType())]
    narrow = R.spread(indexed.select(*keys, "__chunk", "__i", *factors, *terms), tasks, *keys, "__chunk")
    chunks = narrow.groupBy(*keys, "__chunk").applyInArrow(composed, T.StructType([*of_chunk, *fields("__a"), *fields("__b")]))
    starts = chunks.groupBy(*keys).applyInArrow(carried, T.StructType([*of_chunk, *fields("__y")]))
    same = [indexed[k].eqNullSafe(starts[k]) for k in (*keys, "__chunk")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    placed = indexed.join(starts, condition).select(*[indexed[c] for c in indexed.columns], *[starts[f"__y{i}"] for i in range(len(names))])
    result = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return placed.groupBy(*keys, "__chunk").applyInArrow(worked, result)


def exponential_vwap(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], seconds: Mapping[str, float], price: str = "price", volume: str = "size", chunk: int | None = None) -> DataFrame:
    """Adds, by the names of ``seconds``, prices weighted by volume and by exp(-age / seconds).

    Ticks without a price or volume only let the weights decay. Null until a tick with volume has come.
    """
    p, v = R.clean(F.col(price).cast("double")), R.clean(F.col(volume).cast("double"))
    counts = p.isNotNull() & v.isNotNull()
    before = R.with_row_index(df, keys, order[0], order[1:], name="__at")
    passed = lambda rows, own: rows.withColumn("__passed", (F.unix_micros(order[0]) - F.unix_micros(F.lag(order[0]).over(Window.partitionBy(*own).orderBy("__at")))) / F.lit(1e6))
    rows = R.in_chunks(before, keys, "__at", 1, passed, chunk=chunk)
    maps = {}
    for i, s in enumerate(seconds.values()):
        if s <= 0:
            raise ValueError("seconds must be positive")
        a = F.exp(-F.col("__passed") / F.lit(float(s)))
        maps |= {f"__n{i}": (a, F.when(counts, p * v)), f"__d{i}": (a, F.when(counts, v))}
    out = affine_scan(rows, keys=keys, order=order, maps=maps, chunk=chunk)
    ratio = {name: F.when(F.col(f"__d{i}") > 0, F.col(f"__n{i}") / F.col(f"__d{i}")) for i, name in enumerate(seconds)}
    return out.withColumns(ratio).drop("__at", "__passed", *maps)


def bar_variance(bars: DataFrame, *, keys: Sequence[str], time: str, chunk: int | None = None) -> DataFrame:
    """Adds ``variance`` to bars (open, high, low, close): squared jump from the last close, plus the range inside.

    ln(open / close before)^2 + ln(high / low)^2 / 2 - (2 ln 2 - 1) ln(close / open)^2; the first bar has no jump.
    """
    indexed = R.with_row_index(bars, keys, time, [], name="__at")
    before = lambda rows, own: rows.withColumn("__close", F.lag("close").over(Window.partitionBy(*own).orderBy("__at")))
    rows = R.in_chunks(indexed, keys, "__at", 1, before, chunk=chunk)
    square = lambda x: F.pow(F.log(x), F.lit(2.0))
    jump = F.coalesce(square(F.col("open") / F.col("__close")), F.lit(0.0))
    inside = square(F.col("high") / F.col("low")) * 0.5 - square(F.col("close") / F.col("open")) * (2 * math.log(2) - 1)
    return rows.withColumn("variance", jump + inside).drop("__at", "__close")


def cumulative_volatility(ticks: DataFrame, *, keys: Sequence[str], order: Sequence[str], bar_us: int, bars_per_year: float, price: str = "price", chunk: int | None = None) -> DataFrame:
    """keys, bar (start), n (bars so far) and volatility: the root of the mean bar variance so far, annualised.

    Bars without a positive price don't exist; the next bar's jump goes over them.
    """
    at = F.timestamp_micros(F.floor(F.unix_micros(order[0]) / F.lit(bar_us)) * F.lit(bar_us))
    good = ticks.where(F.col(price) > 0).withColumn("bar", at)
    first, last = F.struct(*order), F.struct(*order)
    bars = good.groupBy(*keys, "bar").agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, last).alias("close"))
    one = F.lit(1.0)
    out = affine_scan(bar_variance(bars, keys=keys, time="bar", chunk=chunk), keys=keys, order=["bar"], maps={"__sum": (one, F.col("variance")), "__n": (one, one)}, chunk=chunk)
    return out.select(*keys, "bar", F.col("__n").cast("bigint").alias("n"), F.sqrt(F.greatest(F.col("__sum"), F.lit(0.0)) / F.col("__n") * F.lit(bars_per_year)).alias("volatility"))
