"""Temporal alignment: regular grids, as-of joins, volume cells, overnight gaps and valid runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import rolling as R


class OvernightStrategy(Enum):
    RESET = "reset"
    MASK = "mask"
    INTERPOLATE = "interpolate"


@dataclass(frozen=True)
class SequenceConfig:
    lookback_seconds: int = 300
    interval_seconds: int = 1
    gap_seconds: float = 4 * 3600.0
    strategy: OvernightStrategy = OvernightStrategy.RESET
    least_valid: float = 0.8

    def __post_init__(self) -> None:
        if self.lookback_seconds < 1 or self.interval_seconds < 1 or self.lookback_seconds < self.interval_seconds or self.gap_seconds <= 0 or not 0 < self.least_valid <= 1:
            raise ValueError("lookback and interval must be positive with lookback the longer, gap positive, least_valid in (0, 1]")

    @property
    def length(self) -> int:
        return self.lookback_seconds // self.interval_seconds


def time_grid(ends: DataFrame, cfg: SequenceConfig, *, end_us: str = "end_us") -> DataFrame:
    """One row for each grid time (``grid_us``, ``grid_index``) up to and with each row's end, in microseconds."""
    step = cfg.interval_seconds * 1_000_000
    start = F.col(end_us) - F.lit((cfg.length - 1) * step)
    return ends.select("*", F.posexplode(F.sequence(start, F.col(end_us), F.lit(step))).alias("grid_index", "grid_us"))


def as_of(grid: DataFrame, obs: DataFrame, *, keys: Sequence[str], grid_us: str, obs_us: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each grid row the last observation at or before it: adds ``values`` and ``valid``.

    Later rows by ``order`` win among equal times; null values carry as values. One shuffle and one sort of both sides:
    the observations are put among the grid rows and filled forward, in spans of time if a series has many of both.
    """
    carried = [c for c in grid.columns if c not in (*keys, grid_us)]
    value = F.struct(*values)
    order_cols = [F.col(c) for c in order]
    left = obs.select(*keys, F.col(obs_us).alias("__t"), F.lit(0).alias("__kind"), F.struct(*order_cols).alias("__seq"), value.alias("__v"), *[F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in carried])
    none = left.schema
    right = grid.select(*keys, F.col(grid_us).alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(none["__seq"].dataType).alias("__seq"), F.lit(None).cast(none["__v"].dataType).alias("__v"), *carried)
    rows = left.unionByName(right)
    cut = R.spans_of(rows.select(*keys, "__t"), keys, "__t")
    span_us, tasks = cut or (None, 0)
    filled = R.last_known(rows, keys, ["__t", "__kind", "__seq"], F.col("__t"), F.col("__v"), "__last", cut=cut is not None, span_us=span_us, tasks=tasks).where("__kind = 1").drop("__v").withColumnRenamed("__last", "__v")
    return filled.select(*keys, F.col("__t").alias(grid_us), *carried, *[F.col("__v")[c].alias(c) for c in values], F.col("__v").isNotNull().alias("valid"))


def volume_cells(grid: DataFrame, trades: DataFrame, *, keys: Sequence[str], origin_us: int, step_us: int, time_us: str, volume: str, trailing: bool = False) -> DataFrame:
    """Adds the volume of each grid row's cell, 0 if it is empty: [t, t + step), or (t - step, t] if ``trailing``."""
    offset = F.col(time_us) - F.lit(origin_us)
    cell = F.ceil(offset / F.lit(step_us)) if trailing else F.floor(offset / F.lit(step_us))
    sums = trades.groupBy(*keys, cell.cast("bigint").alias("__cell")).agg(F.sum(volume).alias("__volume"))
    placed = grid.withColumn("__cell", F.floor((F.col("grid_us") - F.lit(origin_us)) / F.lit(step_us)).cast("bigint"))
    return placed.join(sums, [*keys, "__cell"], "left").withColumn("volume", F.coalesce("__volume", F.lit(0)).cast("double")).drop("__cell", "__volume")


def gap_flag(keys: Sequence[str], order: Sequence[str], seconds: Column, gap_seconds: float = 14_400.0) -> Column:
    """True where more than ``gap_seconds`` passed since the row before; False at the first row. See also :func:`with_gaps`."""
    return F.coalesce(seconds - F.lag(seconds).over(Window.partitionBy(*keys).orderBy(*order)) > gap_seconds, F.lit(False))


def with_gaps(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], gap_seconds: float = 14_400.0, name: str = "gap", passed: str | None = None) -> DataFrame:
    """Adds ``name``: whether more than ``gap_seconds`` passed since the row before; False at the first row.

    ``order`` starts with a timestamp. passed: adds the microseconds since the row before under this name. Long series
    are cut into chunks.
    """

    def add(rows: DataFrame, own: list[str]) -> DataFrame:
        us = F.unix_micros(order[0])
        since = rows.withColumn("__passed", us - F.lag(us).over(R.series(own, order)))
        out = since.withColumn(name, F.coalesce(F.col("__passed") / F.lit(1e6) > gap_seconds, F.lit(False)))
        return out.withColumnRenamed("__passed", passed) if passed else out.drop("__passed")

    return R.by_series(df, keys, order, 1, add)


def handle_overnight(df: DataFrame, strategy: OvernightStrategy, *, keys: Sequence[str], index: str, gap: str, columns: Sequence[str]) -> DataFrame:
    """RESET: null before the last gap. MASK: null at gaps. INTERPOLATE: unchanged."""
    if strategy is OvernightStrategy.INTERPOLATE:
        return df
    if strategy is OvernightStrategy.MASK:
        keep = ~F.col(gap)
    else:
        # a row a series, so no task holds a series; series with a null key have gaps of their own
        last = df.where(F.col(gap)).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max(index).alias("__last"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & df[k].eqNullSafe(last[f"__k{i}"])
        df = df.join(last, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        keep = F.coalesce(F.col(index) >= F.col("__last"), F.lit(True))
        return df.withColumns({c: F.when(keep, F.col(c)) for c in columns}).drop("__last")
    return df.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def valid_mask(strategy: OvernightStrategy, valid: Column, price: Column) -> Column:
    return valid if strategy is OvernightStrategy.INTERPOLATE else valid & price.isNotNull()


def longest_valid_run(df: DataFrame, *, keys: Sequence[str], index: str, valid: str, least_valid: float = 0.8, chunk: int | None = None) -> DataFrame:
    """First longest run of valid rows as half-open [run_start, run_end); nulls if it is under the share of all rows.

    Without a valid row there are nulls at any share; at 0 every run counts. Runs are found in chunks of rows; those that touch the edge of a chunk are joined to their neighbours.
    """
    keys, chunk = list(keys), chunk or R.CHUNK_ROWS
    rows = df.withColumn("__chunk", F.floor(F.col(index) / F.lit(chunk)))
    islands = rows.withColumn("__island", F.col(index) - F.row_number().over(Window.partitionBy(*keys, "__chunk", valid).orderBy(index)))
    runs = islands.where(F.col(valid)).groupBy(*keys, "__chunk", "__island").agg(F.min(index).alias("s"), F.count(F.lit(1)).alias("len")).select(*keys, "s", "len")
    at_edge = (F.col("s") % chunk == 0) | ((F.col("s") + F.col("len")) % chunk == 0)
    w = Window.partitionBy(*keys).orderBy("s")
    opens = F.coalesce(F.col("s") != F.lag(F.col("s") + F.col("len")).over(w), F.lit(True)).cast("int")
    edge = runs.where(at_edge).withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*keys, "__run").agg(F.min("s").alias("s"), F.sum("len").alias("len")).select(*keys, "s", "len")
    best = runs.where(~at_edge).unionByName(joined).groupBy(*keys).agg(F.max_by(F.struct("s", "len"), F.struct("len", -F.col("s"))).alias("b"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    enough = F.col("b.len") / F.col("__n") >= least_valid
    return sizes.join(best, keys, "left").select(*keys, F.when(enough, F.col("b.s")).alias("run_start"), F.when(enough, F.col("b.s") + F.col("b.len")).alias("run_end"))


def band_join(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_us: str, right_us: str, band_us: int, how: str = "inner") -> DataFrame:
    """Rows with equal keys whose times differ by less than ``band_us``, strictly.

    The right side is copied to the band cells around its own, so the join is an equality on (keys, cell) and a key with
    many rows meets only those near in time. Time columns need different names.
    """
    l_cell = F.floor(F.col(left_us) / F.lit(band_us))
    r_cell = F.floor(F.col(right_us) / F.lit(band_us))
    a = left.withColumn("__cell", l_cell)
    b = right.withColumn("__cell", F.explode(F.array(r_cell - 1, r_cell, r_cell + 1)))
    near = F.abs(a[left_us] - b[right_us]) < band_us
    on = [a[k] == b[k] for k in keys] + [a["__cell"] == b["__cell"], near]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    out = a.join(b, condition, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("__cell")
    return out.select(*[a[c] for c in left.columns], *[b[c] for c in right.columns if c not in keys])
