"""Row frames over ordered series, gated until full; long frames as differences of running sums.

A series is worked through in one task while it is short (the length is checked). A longer one is cut into chunks of rows
with a halo, or into spans of time with the last known value carried from span to span, so one symbol with a third of all
ticks spreads over many tasks, and running sums start anew in each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Longest frames whose deviation, and whose sum or count, is worked out directly: Spark walks a sliding frame anew for each row.
DIRECT_ROWS, SUM_ROWS = 60, 12
#: Rows of a series beyond which it is cut, and rows of a chunk.
CHUNK_ROWS = 1_000_000
#: Rows that a task sorts, as far as their number is known, and rows of a span where a series is dense.
TASK_ROWS, SPAN_ROWS = 500_000, 250_000
#: Time of a span, in microseconds; shorter where a series is dense.
SPAN_US = 86_400_000_000


def clean(x: Column) -> Column:
    """NaN as null: missing is null everywhere here."""
    return F.when(~F.isnan(x), x)


def series(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def gated(w: WindowSpec, n: int, value: Column) -> Column:
    """``value`` once the frame has n rows, null before."""
    return F.when(F.row_number().over(w) >= n, value)


def rolling_sum(w: WindowSpec, n: int, x: Column) -> Column:
    """Sum of the last n rows without nulls (0 if there are none)."""
    x = F.coalesce(x, F.lit(0.0))
    if n <= SUM_ROWS:
        return F.sum(x).over(last_rows(w, n))
    until = lambda end: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, end))
    return until(0) - F.coalesce(until(-n), F.lit(0.0))


def rolling_count(w: WindowSpec, n: int, x: Column) -> Column:
    """Rows of the last n where ``x`` isn't null."""
    if n <= SUM_ROWS:
        return F.count(x).over(last_rows(w, n))
    until = lambda end: F.count(x).over(w.rowsBetween(Window.unboundedPreceding, end))
    return until(0) - F.coalesce(until(-n), F.lit(0))


def rolling_std(w: WindowSpec, n: int, x: Column) -> Column:
    """Population standard deviation of the values among the last n rows; null without values.

    Long frames use running sums of the value and its square. Returns are near 0, so little cancels.
    """
    if n <= DIRECT_ROWS:
        return F.stddev_pop(x).over(last_rows(w, n))
    count = rolling_count(w, n, x)
    mean = rolling_sum(w, n, x) / F.nullif(count, F.lit(0))
    return F.sqrt(F.greatest(rolling_sum(w, n, x * x) / F.nullif(count, F.lit(0)) - mean * mean, F.lit(0.0)))


def tasks_for(df: DataFrame) -> int:
    """Tasks of about TASK_ROWS rows each; counts the rows."""
    return -(-df.count() // TASK_ROWS)


def spread(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """The rows by these columns over ``tasks`` tasks; unchanged if Spark's own number is as high."""
    return df.repartition(tasks, *columns) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_row_index(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], *, span_us: int = SPAN_US, name: str = "row_index", tasks: int = 0) -> DataFrame:
    """0-based position in the series by (time, order), numbered in time spans so that no task sorts a whole series."""
    spanned = df.withColumn("__span", F.floor(F.unix_micros(time) / F.lit(span_us)))
    starts = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spanned.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(starts), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys, "__span").orderBy(time, *order)
    return spread(spanned, tasks, *keys, "__span").join(counts, [*keys, "__span"]).withColumn(name, F.col("__start") + F.row_number().over(within) - 1).drop("__span", "__start")


def in_chunks(df: DataFrame, keys: Sequence[str], index: str, halo: int, feature: Callable[[DataFrame, list[str]], DataFrame], *, chunk: int | None = None, ahead: int = 0, tasks: int = 0) -> DataFrame:
    """``feature(df, keys)`` of row frames of up to ``halo`` rows back and ``ahead`` rows on, with series cut into chunks.

    The last ``halo`` rows of a chunk are copied to the next one, the first ``ahead`` to the one before, and the copies'
    results dropped, so one very long series spreads over many tasks and each row still sees its whole frame. Needs the
    position column ``index``, from 0, and keeps it.
    """
    chunk = chunk or CHUNK_ROWS
    if not 0 <= halo <= chunk or not 0 <= ahead <= chunk:
        raise ValueError("halo and ahead must be 0 to chunk")
    at = F.floor(F.col(index) / F.lit(chunk))
    rest = F.col(index) % F.lit(chunk)
    own = [at, F.when(rest >= chunk - halo, at + 1), F.when((rest < ahead) & (at > 0), at - 1)]
    placed = df.withColumn("__chunk", F.explode(F.array_compact(F.array(*own)) if halo or ahead else F.array(at)))
    return feature(spread(placed, tasks, *keys, "__chunk"), [*keys, "__chunk"]).where(F.floor(F.col(index) / F.lit(chunk)) == F.col("__chunk")).drop("__chunk")


def is_long(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a series has more than CHUNK_ROWS rows; counts the rows, and the keys only if all rows together are more."""
    if df.count() <= CHUNK_ROWS:
        return False
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > CHUNK_ROWS


def spans_of(df: DataFrame, keys: Sequence[str], time_us: str) -> tuple[int, int] | None:
    """(time of a span, tasks) for series in ``df`` of which one has more than CHUNK_ROWS rows; None if none has.

    A span of the densest series holds about SPAN_ROWS rows, a task about TASK_ROWS, however many rows there are.
    """
    rows = df.count()
    if rows <= CHUNK_ROWS:
        return None
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(time_us) - F.min(time_us) + 1).alias("t"))
    share = F.min(F.when(F.col("n") > CHUNK_ROWS, F.col("t") / F.col("n")))
    longest, us = sizes.agg(F.max("n"), share).first()
    if longest <= CHUNK_ROWS:
        return None
    return max(1, min(SPAN_US, int((us or SPAN_US) * SPAN_ROWS))), -(-rows // TASK_ROWS)


def by_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int, feature: Callable[[DataFrame, list[str]], DataFrame], *, ahead: int = 0) -> DataFrame:
    """``feature(df, keys)`` of row frames, in chunks if a series is long; ``order`` starts with a timestamp then."""
    if not is_long(df, keys):
        return feature(df, list(keys))
    time, *rest = order
    indexed = with_row_index(df, keys, time, rest, name="__index")
    return in_chunks(indexed, keys, "__index", halo, feature, ahead=ahead).drop("__index")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], time_us: Column, value: Column, name: str, *, cut: bool, span_us: int | None = None, tasks: int = 0) -> DataFrame:
    """Adds ``name``: the last value that isn't null at or before each row.

    cut: series in spans of time (span_us, or SPAN_US), the last value of each carried to the next ones; over ``tasks``
    tasks if these are more than Spark's own number.
    """
    back = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not cut:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(back(series(keys, order))))
    spans = df.withColumns({"__span": F.floor(time_us / F.lit(span_us or SPAN_US)), "__value": value})
    ends = spans.where(F.col("__value").isNotNull()).groupBy(*keys, "__span").agg(F.max_by("__value", F.struct(*order)).alias("__end"))
    every = spans.select(*keys, "__span").distinct().join(ends, [*keys, "__span"], "left")
    carried = every.withColumn("__carried", F.last("__end", ignorenulls=True).over(series(keys, ["__span"]).rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
    inside = F.last("__value", ignorenulls=True).over(back(series([*keys, "__span"], order)))
    return spread(spans, tasks, *keys, "__span").withColumn("__inside", inside).join(carried, [*keys, "__span"]).withColumn(name, F.coalesce("__inside", "__carried")).drop("__span", "__value", "__inside", "__carried")


def annualization(trading_days: int = 252, hours: float = 6.5) -> float:
    """Root of the seconds in a trading year."""
    return math.sqrt(trading_days * hours * 3600)
