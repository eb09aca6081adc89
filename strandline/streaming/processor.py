"""Tick buffers as list state: new ticks are appended, old ones trimmed now and then, and timers end a market's session.

The state store must be RocksDB, see :func:`rocksdb_state`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import repeat
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.streaming.buffers import BufferConfig, feature_matrix

DAY_US = 86_400_000_000
OUT_SCHEMA = "series string, ts_us long, buffered int, last array<double>, matrix array<array<double>>"
_STATE_SCHEMA = "ts_us long, seq long, price double, volume double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class SessionConfig:
    """buffer: what is held. close_us: time of day (UTC) at which a session ends. late: how late ticks may come."""

    buffer: BufferConfig = BufferConfig()
    close_us: int | None = None
    late: str = "10 minutes"

    def __post_init__(self) -> None:
        if self.close_us is not None and not 0 <= self.close_us < DAY_US:
            raise ValueError("close_us must lie in a day")
        if self.close_us is not None and self.buffer.idle_timeout:
            raise ValueError("timers of event time and time to live of processing time exclude each other")

    def next_close(self, ts_us: int) -> int:
        """First end of a session after a time."""
        return ((ts_us - self.close_us) // DAY_US + 1) * DAY_US + self.close_us

    def current(self, times: np.ndarray) -> int:
        """Place of the first tick (of rising times) that counts: of the newest session, after the last long gap, and as many as the buffer holds."""
        first = max(0, len(times) - self.buffer.capacity)
        if self.close_us is not None:
            first = max(first, int(np.searchsorted(times, self.next_close(int(times[-1])) - DAY_US)))
        if self.buffer.reset_gap_seconds is not None:
            gaps = np.flatnonzero(np.diff(times) > self.buffer.reset_gap_seconds * 1e6)
            first = max(first, int(gaps[-1]) + 1 if len(gaps) else 0)
        return first


class TickProcessor(StatefulProcessor):
    """One series: its ticks as a list, a timer at the next close."""

    def __init__(self, cfg: SessionConfig) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        idle = self.cfg.buffer.idle_timeout
        self.ticks = handle.getListState("ticks", _STATE_SCHEMA, int(pd.Timedelta(idle).total_seconds() * 1000)) if idle else handle.getListState("ticks", _STATE_SCHEMA)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        capacity, place = self.cfg.buffer.capacity, itemgetter(0, 1)
        held = [(*x, False) for x in self.ticks.get()]
        # only the last ``capacity`` ticks can count, so a trigger's rows are taken frame by frame and no more are kept
        last_ones = sorted(held, key=place)[-capacity:]
        for frame in rows:
            news = frame.sort_values(["ts_us", "seq"]).tail(capacity)
            fresh = zip(news["ts_us"].tolist(), news["seq"].tolist(), *([None if pd.isna(x) else x for x in news[c]] for c in ("price", "volume")), repeat(True), strict=False)
            last_ones = sorted([*last_ones, *fresh], key=place)[-capacity:]
        times = np.array([x[0] for x in last_ones], np.int64)
        mine = [x[:4] for x in last_ones[self.cfg.current(times) :]]
        added = [x[:4] for x in last_ones if x[4]]
        if len(held) + len(added) - len(mine) > capacity:
            self.ticks.put(mine)
        elif added:
            self.ticks.appendList(added)
        if self.cfg.close_us is not None:
            at = self.cfg.next_close(int(times[-1])) // 1000
            if at not in set(self.handle.listTimers()):
                self.handle.registerTimer(at)
        last = matrix = None
        if len(mine) >= self.cfg.buffer.sequence_length:
            price, volume = (np.array([np.nan if x[i] is None else x[i] for x in mine], float) for i in (2, 3))
            m = feature_matrix(price, volume, self.cfg.buffer.sequence_length)
            last, matrix = m[-1].tolist(), m.tolist()
        yield pd.DataFrame({"series": [key[0]], "ts_us": [int(times[-1])], "buffered": [len(mine)], "last": [last], "matrix": [matrix]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """The close has passed: ticks of the session go; those that came after it stay."""
        close = expiredTimerInfo.getExpiryTimeInMs() * 1000
        later = [tuple(x) for x in self.ticks.get() if x[0] >= close]
        if later:
            self.ticks.put(later)
        else:
            self.ticks.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_features(ticks: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Newest features of each series and trigger with news; null until the buffer holds ``sequence_length`` ticks.

    ticks: a stream of TICK_SCHEMA. The ticks of a session that has ended never meet later ones, whether its timer has
    fired or not, so the last row of a series doesn't depend on how ticks are dealt to triggers. A series' state is at
    most twice the buffer. With an idle timeout the store drops the ticks of a series that went quiet by itself;
    Spark then goes on with empty batches, so such a query is stopped, not awaited.
    """
    timed = ticks.withColumn("time", F.timestamp_micros("ts_us"))
    mode = "ProcessingTime" if cfg.buffer.idle_timeout else "EventTime" if cfg.close_us is not None else "None"
    if mode == "EventTime":
        timed = timed.withWatermark("time", cfg.late)
    return timed.groupBy("series").transformWithStateInPandas(TickProcessor(cfg), OUT_SCHEMA, "Append", mode)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
