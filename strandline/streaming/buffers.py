"""Online features: per-series buffers of the last ticks as streaming state, bars by event time, and a scoring hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators import rolling

#: Columns of the online feature matrix: seven returns, VWAP deviation and three volatilities.
RETURN_WINDOWS, VWAP_WINDOW, RV_WINDOWS = (1, 5, 10, 30, 60, 120, 300), 60, (60, 300, 600)
FEATURES = [f"log_return_{w}s" for w in RETURN_WINDOWS] + ["vwap_deviation"] + [f"rv_{w}s" for w in RV_WINDOWS]
TICK_SCHEMA = "series string, ts_us long, seq long, price double, volume double"


@dataclass(frozen=True)
class BufferConfig:
    lookback_seconds: int = 300
    frequency_hz: float = 1.0
    sequence_length: int = 60
    reset_gap_seconds: float | None = None  # clears the buffer over a market close
    idle_timeout: str | None = None  # e.g. "2 hours": drops the state of a series that went quiet

    def __post_init__(self) -> None:
        if self.capacity < 1 or not 1 <= self.sequence_length <= self.capacity:
            raise ValueError("the buffer must hold the sequence")

    @property
    def capacity(self) -> int:
        return int(self.lookback_seconds * self.frequency_hz)


class RollingBuffer:
    """Last ``capacity`` ticks (rows of ts_us, price, volume), oldest first."""

    def __init__(self, capacity: int, rows: np.ndarray | None = None) -> None:
        self.capacity = capacity
        self.rows = np.zeros((0, 3)) if rows is None else rows[-capacity:]

    def push(self, rows: np.ndarray) -> None:
        self.rows = np.concatenate((self.rows, rows))[-self.capacity :]

    def clear(self) -> None:
        self.rows = self.rows[:0]

    @property
    def is_full(self) -> bool:
        return len(self.rows) == self.capacity

    def __len__(self) -> int:
        return len(self.rows)

    def last_n(self, n: int) -> np.ndarray | None:
        return self.rows[-n:] if len(self.rows) >= n else None


def feature_matrix(price: np.ndarray, volume: np.ndarray, length: int) -> np.ndarray:
    """Last ``length`` rows of FEATURES; values that don't exist are 0, as a model needs them."""
    p, v = pd.Series(price).where(pd.Series(price) > 0), pd.Series(volume)
    logs = np.log(p)
    out = {f"log_return_{w}s": logs - logs.shift(w) for w in RETURN_WINDOWS}
    vwap = (p * v).rolling(VWAP_WINDOW).sum() / np.maximum(v.rolling(VWAP_WINDOW).sum(), 1e-10)
    out["vwap_deviation"] = logs - np.log(vwap.where(vwap > 0))
    returns = logs - logs.shift(1)
    for w in RV_WINDOWS:
        out[f"rv_{w}s"] = returns.rolling(w).std(ddof=0) * rolling.annualization() * 100
    m = pd.DataFrame(out)[FEATURES].to_numpy()[-length:]
    return np.where(np.isfinite(m), m, 0.0)


def online_features(ticks: DataFrame, cfg: BufferConfig = BufferConfig()) -> DataFrame:
    """(series, ts_us, ready rows, feature vector of the newest tick, matrix) for each series and trigger with news.

    ticks: stream or batch of TICK_SCHEMA. A trigger's ticks of a series are taken in (ts_us, seq) order. Nothing comes
    out until the buffer holds ``sequence_length`` ticks. State is bounded by the capacity for each series.
    """
    out_schema = "series string, ts_us long, buffered int, last array<double>, matrix array<array<double>>"
    state_schema = "ts_us array<double>, price array<double>, volume array<double>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer = RollingBuffer(cfg.capacity)
        if state.exists:
            buffer.push(np.array([list(x) for x in state.get]).T.reshape(-1, 3))
        news = pd.DataFrame()
        for frame in frames:  # no more rows are kept than the buffer takes
            news = pd.concat([news, frame] if len(news) else [frame]).sort_values(["ts_us", "seq"]).tail(cfg.capacity)
        rows = news[["ts_us", "price", "volume"]].to_numpy(float)
        if cfg.reset_gap_seconds is not None:
            times = np.concatenate((buffer.rows[-1:, 0], rows[:, 0]))
            gaps = np.flatnonzero(np.diff(times) > cfg.reset_gap_seconds * 1e6)
            if len(gaps):
                rows = rows[gaps[-1] + 1 - (len(times) - len(rows)) :] if gaps[-1] + 1 >= len(times) - len(rows) else rows
                buffer.clear()
        buffer.push(rows)
        state.update(tuple(buffer.rows[:, i].tolist() for i in range(3)))
        if cfg.idle_timeout:
            state.setTimeoutDuration(cfg.idle_timeout)
        if len(buffer) >= cfg.sequence_length:
            m = feature_matrix(buffer.rows[:, 1], buffer.rows[:, 2], cfg.sequence_length)
            yield pd.DataFrame({"series": [key[0]], "ts_us": [int(buffer.rows[-1, 0])], "buffered": [len(buffer)], "last": [m[-1].tolist()], "matrix": [m.tolist()]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if cfg.idle_timeout else GroupStateTimeout.NoTimeout
    return ticks.groupBy("series").applyInPandasWithState(step, out_schema, state_schema, "append", timeout)


def bars(trades: DataFrame, *, time: str = "time", key: str = "ticker", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling event-time bars: average price, volume and count, final once the watermark passes."""
    return trades.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.avg("price").alias("avg_price"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("bar_start"), "avg_price", "volume", "n")


def score_with(features: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], horizons: int, buckets: int) -> DataFrame:
    """Applies a model to the matrices of :func:`online_features`, in Arrow batches.

    scorer takes (rows, sequence, features) and returns (rows, horizons, buckets) probabilities; a distribution that
    doesn't sum to 1 within 0.01 is an error.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x = np.stack([np.array([list(r) for r in m]) for m in pdf["matrix"]]).astype(np.float32)
            p = np.asarray(scorer(x), float)
            if p.shape != (len(pdf), horizons, buckets) or np.abs(p.sum(-1) - 1).max() > 0.01:
                raise ValueError("the scorer's output isn't a set of distributions")
            yield pd.DataFrame({"series": pdf["series"], "ts_us": pdf["ts_us"], "distributions": [[list(h) for h in row] for row in p]})

    return features.mapInPandas(work, "series string, ts_us long, distributions array<array<double>>")
