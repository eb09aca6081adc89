"""What a task holds or does for a row doesn't grow with the series, the trigger or the number of buckets squared."""

from __future__ import annotations

import time
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import discretize
from strandline.operators import scan
from strandline.streaming import buffers, processor


class _State:
    """Stands in for a handle and its list state."""

    def __init__(self):
        self.rows, self.timers = [], []

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


def _frames(n, size, alive=None):
    seen = []
    for i in range(n):
        # frames come in any order of time
        at = (i * 7 % n) * size
        frame = pd.DataFrame({"series": "a", "ts_us": [(at + k) * 1_000_000 for k in range(size)], "seq": range(at, at + size), "price": [100.0 + (at + k) % 13 for k in range(size)], "volume": 1.0})
        seen.append(weakref.ref(frame))
        if alive is not None:
            alive.append(sum(r() is not None for r in seen))
        yield frame
        del frame


def test_a_trigger_is_taken_frame_by_frame():
    cfg = processor.SessionConfig(buffers.BufferConfig(lookback_seconds=20, sequence_length=5), close_us=0)
    out, alive = [], []
    for frames in (_frames(30, 40, alive), iter([pd.concat(list(_frames(30, 40)))])):
        state = _State()
        work = processor.TickProcessor(cfg)
        work.init(state)
        out.append([next(iter(work.handleInputRows(("a",), frames, None))).iloc[0].tolist(), sorted(state.rows)[-20:]])
    assert out[0] == out[1] and out[0][0][1:3] == [1199 * 1_000_000, 20]
    assert max(alive) <= 3 and len(state.rows) <= 40


def test_scan_holds_short_chunks(spark, monkeypatch):
    plain = scan._run

    def checked(a, b, start):
        if len(a) > 100_000:
            raise ValueError("a chunk of too many rows")
        return plain(a, b, start)

    monkeypatch.setattr(scan, "_run", checked)
    rows = spark.range(220_000).select(F.lit("a").alias("k"), F.timestamp_seconds("id").alias("time"), "id")
    out = scan.affine_scan(rows, keys=["k"], order=["time", "id"], maps={"n": (F.lit(1.0), F.lit(1.0))})
    assert out.where(F.col("n") != F.col("id") + 1).count() == 0 and out.count() == 220_000


def test_soft_labels_take_linear_time(spark):
    made = discretize.return_buckets(1601)
    began = time.perf_counter()
    total = spark.range(4000).select(F.aggregate(made.soft_labels((F.col("id") % 1601).cast("int"), 1.5), F.lit(0.0), lambda a, x: a + x).alias("t")).agg(F.sum("t")).first()[0]
    assert total == pytest.approx(4000) and time.perf_counter() - began < 20
