"""Price, volatility and order-flow features of ordered tick series.

Missing is null, and NaN counts as missing. A feature of n rows is null until n rows exist. Columns are named by window, see
``names`` of the configurations. Long series are cut, see :mod:`strandline.operators.rolling`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from strandline.operators import rolling as R


@dataclass(frozen=True)
class PriceConfig:
    return_windows: tuple[int, ...] = (1, 5, 10, 30, 60, 120, 300)
    vwap_window: int = 60
    sample_interval: int = 1

    def __post_init__(self) -> None:
        if not self.return_windows or min(self.return_windows) < 1 or self.vwap_window < 1 or self.sample_interval < 1:
            raise ValueError("windows and interval must be 1 or more")

    def names(self) -> list[str]:
        return [f"log_return_{w}s" for w in self.return_windows] + ["vwap_deviation"]


@dataclass(frozen=True)
class VolatilityConfig:
    windows: tuple[int, ...] = (60, 300, 600)
    vol_of_vol_window: int = 60
    sample_interval: int = 1
    annualization: float = R.annualization()

    def __post_init__(self) -> None:
        if not self.windows or min(self.windows) < 2 or self.vol_of_vol_window < 2 or self.sample_interval < 1:
            raise ValueError("windows must be 2 or more, the interval 1 or more")

    def names(self) -> list[str]:
        return [f"rv_{w}s" for w in self.windows] + ["iv_rv_spread", "vol_of_vol"]


@dataclass(frozen=True)
class OrderFlowConfig:
    imbalance_window: int = 30
    quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)
    arrival_window: int = 30

    def __post_init__(self) -> None:
        if self.imbalance_window < 1 or self.arrival_window < 2 or any(not 0 <= q <= 1 for q in self.quantiles):
            raise ValueError("imbalance window 1 or more, arrival window 2 or more, quantiles in [0, 1]")

    def names(self) -> list[str]:
        return ["trade_imbalance", *(f"size_q{int(q * 100)}" for q in self.quantiles), "arrival_rate"]


def log_return(w: WindowSpec, price: Column, k: int) -> Column:
    """ln(p[i] / p[i-k]); null unless both are positive."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    before = F.lag(price, k).over(w)
    return F.when((price > 0) & (before > 0), F.log(F.try_divide(price, before)))


def vwap(w: WindowSpec, price: Column, volume: Column, n: int) -> Column:
    """Volume-weighted price of the last n rows, divisor at least 1e-10; null if the frame has a null."""
    full = R.rolling_count(w, n, price * volume) == n
    return R.gated(w, n, F.when(full, R.rolling_sum(w, n, price * volume) / F.greatest(R.rolling_sum(w, n, volume.cast("double")), F.lit(1e-10))))


def vwap_deviation(w: WindowSpec, price: Column, volume: Column, n: int) -> Column:
    v = vwap(w, price, volume, n)
    return F.when((price > 0) & (v > 0), F.log(F.try_divide(price, v)))


def realized_volatility(w: WindowSpec, returns: Column, n: int, annualization: float) -> Column:
    """Annualised percent; null unless the frame has n returns."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    return F.when(R.rolling_count(w, n, returns) == n, R.rolling_std(w, n, returns) * F.lit(annualization * 100))


def vol_of_vol(w: WindowSpec, rv: Column, n: int) -> Column:
    """Deviation of the last n volatilities, nulls skipped, of which there must be two."""
    return R.gated(w, n, F.when(R.rolling_count(w, n, rv) >= 2, R.rolling_std(w, n, rv)))


def trade_direction(w: WindowSpec, price: Column, before: Column | None = None) -> Column:
    """Tick rule from the price and the price before (a column where given): last non-zero sign, 0 at the start."""
    sign = F.signum(price - (before if before is not None else F.lag(price).over(w)))
    return F.coalesce(F.last(F.when(sign != 0, sign), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).cast("int")


def trade_imbalance(w: WindowSpec, direction: Column, size: Column, n: int) -> Column:
    total = R.rolling_sum(w, n, F.abs(size).cast("double"))
    return R.gated(w, n, F.when(total > 0, R.rolling_sum(w, n, (direction * size).cast("double")) / total))


def rolling_quantiles(w: WindowSpec, x: Column, n: int, quantiles: Sequence[float]) -> Column:
    """Array of interpolated quantiles of the last n rows, from one sorted array a row."""
    values = F.sort_array(F.collect_list(x.cast("double")).over(R.last_rows(w, n)))

    def pick(v: Column) -> Column:
        def one(q: float) -> Column:
            place = F.lit(q) * (F.size(v) - 1)
            low, high = F.get(v, F.floor(place).cast("int")), F.get(v, F.ceil(place).cast("int"))
            return low + (high - low) * (place - F.floor(place))

        return F.array(*[one(q) for q in quantiles])

    return R.gated(w, n, F.element_at(F.transform(F.array(values), pick), 1))


def arrival_rate(w: WindowSpec, seconds: Column, n: int) -> Column:
    """(n - 1) / seconds spanned by the last n rows; null unless time passes."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    passed = seconds - F.lag(seconds, n - 1).over(w)
    return F.when(passed > 0, F.lit(float(n - 1)) / passed)


def price_features(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], cfg: PriceConfig = PriceConfig(), price: str = "price", volume: str = "volume") -> DataFrame:
    """Adds the columns of ``cfg.names()``, all over one sort; a window shorter than the interval gives nulls."""
    p, v = R.clean(F.col(price).cast("double")), R.clean(F.col(volume).cast("double"))

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = R.series(keys, order)
        out = {f"log_return_{s}s": log_return(w, p, s // cfg.sample_interval) if s >= cfg.sample_interval else F.lit(None).cast("double") for s in cfg.return_windows}
        return rows.withColumns(out | {"vwap_deviation": vwap_deviation(w, p, v, cfg.vwap_window)})

    return R.by_series(df, keys, order, max(*cfg.return_windows, cfg.vwap_window), add)


def volatility_features(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], cfg: VolatilityConfig = VolatilityConfig(), price: str = "price", iv: str | None = None) -> DataFrame:
    """Adds the columns of ``cfg.names()``; spread and vol-of-vol use the first window, no iv column gives a null spread."""
    rows_of = {f"rv_{s}s": s // cfg.sample_interval for s in cfg.windows}
    first = F.col(next(iter(rows_of)))

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = R.series(keys, order)
        step = rows.withColumn("__r", log_return(w, R.clean(F.col(price).cast("double")), 1))
        step = step.withColumns({c: realized_volatility(w, F.col("__r"), n, cfg.annualization) if n >= 2 else F.lit(None).cast("double") for c, n in rows_of.items()})
        return step.withColumns({"iv_rv_spread": (R.clean(F.col(iv).cast("double")) - first) if iv else F.lit(None).cast("double"), "vol_of_vol": vol_of_vol(w, first, cfg.vol_of_vol_window)}).drop("__r")

    return R.by_series(df, keys, order, max(cfg.windows) + 1 + cfg.vol_of_vol_window, add)


def order_flow_features(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], cfg: OrderFlowConfig = OrderFlowConfig(), price: str = "price", size: str = "size", time: str = "time") -> DataFrame:
    """Adds ``direction`` and the columns of ``cfg.names()``."""
    p, n, long = R.clean(F.col(price).cast("double")), cfg.imbalance_window, R.is_long(df, keys)
    amount = R.clean(F.col(size).cast("double"))

    def add_before(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("__before", F.lag(p).over(R.series(keys, order)))

    def add(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = R.series(keys, order)
        step = rows.withColumns({"trade_imbalance": trade_imbalance(w, F.col("direction"), amount, n), "__q": rolling_quantiles(w, amount, n, cfg.quantiles), "arrival_rate": arrival_rate(w, F.unix_micros(time) / F.lit(1e6), cfg.arrival_window)})
        return step.withColumns({f"size_q{int(q * 100)}": F.get("__q", F.lit(i)) for i, q in enumerate(cfg.quantiles)}).drop("__q")

    if not long:
        step = add_before(df, list(keys))
        return add(step.withColumn("direction", trade_direction(R.series(keys, order), p, F.col("__before"))).drop("__before"), list(keys))
    first, *rest = order
    indexed = R.with_row_index(df, keys, first, rest, name="__index")
    sign = F.signum(p - F.col("__before"))
    known = R.last_known(R.in_chunks(indexed, keys, "__index", 1, add_before), keys, order, F.unix_micros(first), F.when(sign != 0, sign), "__sign", cut=True)
    step = known.withColumn("direction", F.coalesce("__sign", F.lit(0.0)).cast("int")).drop("__before", "__sign")
    return R.in_chunks(step, keys, "__index", max(n, cfg.arrival_window), add).drop("__index")
