"""Recurrences, order statistics, co-movement and the sampler against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.operators import cross, order_statistics, rolling, sampler, scan

START = 1_704_067_200


def ticks(spark, rows, schema="key string, s double, seq int, price double, size double"):
    return spark.createDataFrame(rows, schema).withColumn("time", F.timestamp_micros((F.col("s") * 1e6).cast("bigint") + START * 1_000_000))


def plain_lead_lag(series, lags):
    """All pairs of intervals of two lists of (second, price)."""
    steps = [[(x[0], y[0], math.log(y[1] / x[1])) for x, y in zip(s, s[1:], strict=False)] for s in series]
    out = {}
    for lag in lags:
        met = [r * q for s, e, r in steps[0] for t, f, q in steps[1] if s < f + lag and t + lag < e]
        norm = math.sqrt(sum(r * r for *_, r in steps[0]) * sum(q * q for *_, q in steps[1]))
        out[lag] = (len(met), sum(met), sum(met) / norm if norm else None)
    return out


def test_lead_lag_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    series = [sorted({rng.randrange(0, 4000) for _ in range(n)}) for n in (120, 60)]
    series = [[(float(s), 100 * math.exp(rng.gauss(0, 0.2))) for s in times] for times in series]
    rows = [(k, s, i, p, 1.0) for k, part in zip("ab", series, strict=True) for i, (s, p) in enumerate(part)]
    rows += [("a", series[0][3][0], -1, 5.0, 1.0), ("a", 77.5, 0, None, 1.0), ("b", 78.5, 0, -1.0, 1.0), (None, 5.0, 0, 1.0, 1.0), ("c", 1.0, 0, 9.0, 1.0)]  # an earlier tick of the same time, no prices
    lags = [-5000, -300, -7, 0, 7, 300, 5000]
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "c"), ("a", "none")], "a string, b string")
    for chunk, span in ((1_000_000, 86_400_000_000), (10, 500_000_000)):
        monkeypatch.setattr(rolling, "CHUNK_ROWS", chunk)
        monkeypatch.setattr(rolling, "SPAN_US", span)
        steps = cross.tick_steps(ticks(spark, rows), key="key", time="time", order=["seq"], price="price")
        got = {(r["a"], r["b"], r["lag_us"] // 1_000_000): (r["n_overlaps"], r["covariance"], r["correlation"]) for r in cross.lead_lag(steps, pairs, [x * 1_000_000 for x in lags]).collect()}
        for other, part in (("b", series[1]), ("a", series[0])):
            for lag, want in plain_lead_lag([series[0], part], lags).items():
                have = got["a", other, lag]
                assert have[0] == want[0] and have[1] == pytest.approx(want[1], abs=1e-9) and have[2] == pytest.approx(want[2], abs=1e-9)
        assert got["a", "a", 0][2] > 0.99 and got["a", "c", 0][2] is None and got["a", "none", 0] == (0, 0.0, None)
    best = {(r["a"], r["b"]): r for r in cross.best_lag(cross.lead_lag(steps, pairs, [0, 7_000_000])).collect()}
    assert best["a", "a"]["lag_us"] == 0 and ("a", "c") not in best


def test_index_of_series(spark):
    rows = [("a", 0.0, 0, 1.0, 1.0), ("b", 5.0, 0, 4.0, 1.0), ("a", 10.0, 0, 2.0, 1.0), ("b", 10.0, 0, 8.0, 1.0), ("a", 20.0, 0, 1.0, 1.0), ("c", 7.0, 0, 3.0, 1.0)]
    steps = cross.tick_steps(ticks(spark, rows), key="key", time="time", order=["seq"], price="price")
    groups = spark.createDataFrame([("a", "two"), ("b", "two"), ("c", "one"), ("a", "one"), ("none", "one")], "key string, index string")
    got = {(r["key"], r["time"].second): r["price"] for r in cross.index_ticks(steps, groups=groups).collect()}
    half = math.log(2) / 2
    assert {k: pytest.approx(math.log(v), abs=1e-12) for k, v in got.items()} == {("two", 0): 0, ("two", 5): 0, ("two", 10): 2 * half, ("two", 20): half, ("one", 0): 0, ("one", 7): 0, ("one", 10): half, ("one", 20): 0}
    assert {r["key"] for r in cross.index_ticks(steps).collect()} == {"all"}


def test_follower_is_found(spark):
    rng = random.Random(11)
    price, leader = 100.0, []
    for i in range(600):
        price *= math.exp(rng.gauss(0, 0.01))
        leader.append((10.0 * i, price))
    rows = [("lead", s, 0, p, 1.0) for s, p in leader] + [("late", s + 30 + rng.random(), 0, p, 1.0) for s, p in leader]
    steps = cross.tick_steps(ticks(spark, rows), key="key", time="time", order=["seq"], price="price")
    got = cross.best_lag(cross.lead_lag(steps, spark.createDataFrame([("late", "lead")], "a string, b string"), [s * 1_000_000 for s in range(-60, 61, 10)])).first()
    assert got["lag_us"] == 30_000_000 and got["correlation"] > 0.9 and got["lead_ratio"] > 10


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_scan_and_vwap(spark, chunk):
    rng = random.Random(3)
    rows = [(k, rng.random() * 900, i, None if i % 11 == 3 else 10 + rng.random(), None if i % 13 == 5 else float(rng.randrange(4))) for k in "xy" for i in range(60)]
    df = ticks(spark, rows).withColumns({"a": F.lit(0.5) + F.col("seq") / 100, "b": F.col("size")})
    got = {(r["key"], r["seq"]): r["y"] for r in scan.affine_scan(df, keys=["key"], order=["time", "seq"], maps={"y": (F.when(F.col("seq") % 5 != 0, F.col("a")), F.col("b"))}, chunk=chunk).collect()}
    vwap = {(r["key"], r["seq"]): r["v"] for r in scan.exponential_vwap(df, keys=["key"], order=["time", "seq"], seconds={"v": 120.0}, chunk=chunk).collect()}
    for k in "xy":
        y = num = den = 0.0
        before = None
        for _, s, seq, price, size in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            y = (0.5 + seq / 100 if seq % 5 else 1.0) * y + (size or 0.0)
            decay = 0.0 if before is None else math.exp(-(s - before) / 120)
            good = price is not None and size is not None
            num, den, before = num * decay + (price * size if good else 0), den * decay + (size if good else 0), s
            assert got[k, seq] == pytest.approx(y, rel=1e-9)
            assert vwap[k, seq] == (pytest.approx(num / den, rel=1e-6) if den > 0 else None)
    assert scan.affine_scan(df.limit(0), keys=["key"], order=["time", "seq"], maps={"y": (F.lit(1.0), F.lit(1.0))}).collect() == []
    with pytest.raises(ValueError):
        scan.exponential_vwap(df, keys=["key"], order=["time", "seq"], seconds={"v": 0.0})


def test_cumulative_volatility(spark):
    rows = [("x", 0.0, 0, 10.0, 1.0), ("x", 5.0, 1, 12.0, 1.0), ("x", 9.0, 2, 11.0, 1.0), ("x", 61.0, 3, 13.0, 1.0), ("x", 62.0, 4, None, 1.0), ("x", 190.0, 5, 9.0, 1.0), ("x", 191.0, 6, 9.5, 1.0)]
    got = scan.cumulative_volatility(ticks(spark, rows), keys=["key"], order=["time", "seq"], bar_us=60_000_000, bars_per_year=100.0, chunk=1).orderBy("bar").collect()
    square = lambda x: math.log(x) ** 2
    inside = [square(h / low) / 2 - square(c / o) * (2 * math.log(2) - 1) for o, h, low, c in ((10, 12, 10, 11), (13, 13, 13, 13), (9, 9.5, 9, 9.5))]
    total = np.cumsum([inside[0], inside[1] + square(13 / 11), inside[2] + square(9 / 13)])
    assert [r["n"] for r in got] == [1, 2, 3]
    assert [r["volatility"] for r in got] == pytest.approx([math.sqrt(t / (i + 1) * 100) for i, t in enumerate(total)])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), max_size=60), st.integers(1, 12), st.sampled_from([1, 2, 512]))
def test_moving_quantiles(values, n, block):
    before = order_statistics.BLOCK
    order_statistics.BLOCK = block
    try:
        got = order_statistics.moving_quantiles(values, n, [0.0, 0.3, 1.0])
    finally:
        order_statistics.BLOCK = before
    for i, have in enumerate(got):
        frame = [x for x in values[max(0, i - n + 1) : i + 1] if x is not None]
        if i + 1 < n:
            assert have is None
        else:
            assert have == (pytest.approx(np.quantile(frame, [0, 0.3, 1]).tolist()) if frame else [None] * 3)


def test_long_quantiles_in_chunks(spark):
    rng = random.Random(2)
    rows = [(k, float(i), i, float("nan") if i % 9 == 4 else rng.random(), None) for k in "ab" for i in range(50)]
    for chunk in (5, 8, 1000):
        got = order_statistics.long_quantiles(ticks(spark, rows), keys=["key"], order=["time", "seq"], value="price", n=5, quantiles=[0.5], name="q", chunk=chunk).collect()
        assert len(got) == 100
        for r in got:
            frame = [x[3] for x in rows if x[0] == r["key"] and r["seq"] - 5 < x[2] <= r["seq"] and not math.isnan(x[3])]
            assert r["q"] == (None if r["seq"] < 4 else [pytest.approx(float(np.median(frame)))])


@pytest.mark.parametrize(("bins", "held", "most"), [(3, 2, 0), (64, 1, 100_000), (1024, 20_000, 100_000)])
def test_exact_percentiles(spark, monkeypatch, bins, held, most):
    monkeypatch.setattr(order_statistics, "BINS", bins)
    monkeypatch.setattr(order_statistics, "MOST_RANGES", most)
    rng = random.Random(1)
    groups = {"u": [rng.random() for _ in range(40)], "ties": [1.0] * 30 + [2.0] * 11, "one": [5.0], "wide": [-1e308, 1e308, 0.0, 1.0, 2.0**-1000], None: [3.0, 4.0], "inf": [math.inf, -math.inf, math.inf, 1.0, 2.0]}
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("none", None), ("none", math.nan), ("one", None)]
    p = [0.0, 0.25, 0.5, 1.0]
    got = {r["k"]: r for r in order_statistics.exact_percentiles(spark.createDataFrame(rows, "k string, x double"), keys=["k"], value="x", probabilities=p, few=held).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["n"] == 0 and got["none"]["percentiles"] == [None] * 4
    for k, xs in groups.items():
        if k != "inf":
            assert got[k]["n"] == len(xs) and got[k]["percentiles"] == pytest.approx(np.quantile(xs, p).tolist())
    assert got["inf"]["percentiles"] == [-math.inf, 1.0, 2.0, math.inf]
    whole = order_statistics.exact_percentiles(spark.createDataFrame(rows, "k string, x double").where("k = 'u'"), keys=[], value="x", probabilities=[0.5], few=held).first()
    assert whole["percentiles"][0] == pytest.approx(float(np.median(groups["u"])))
    with pytest.raises(ValueError):
        order_statistics.exact_percentiles(spark.range(1), keys=[], value="id", probabilities=[2.0])


def test_sampler(spark, tmp_path):
    rows = [("k", float(x % 7), x, 1.0, 1.0) for x in range(200)]
    one = sampler.TemporalSampler.write(ticks(spark, rows), str(tmp_path / "s"), ["time", "seq"], 5)
    want = sorted(range(200), key=lambda x: (x % 7, x))
    assert len(one) == 200 and [r["seq"] for r in one.read().orderBy("position").collect()] == want
    again = sampler.TemporalSampler.open(spark, str(tmp_path / "s"), ticks(spark, rows).schema)
    part = again.batches(8, start=90).orderBy("position").collect()
    assert again.offsets == one.offsets and [r["seq"] for r in part] == want[90:] and [r["batch"] for r in part] == [i // 8 for i in range(110)]
    assert [r["position"] for r in again.read(17, 23).orderBy("position").collect()] == list(range(17, 23)) and again.read(500).count() == 0
    plan = again.read(0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__range" in plan and "(__range" in plan
    empty = sampler.TemporalSampler.write(ticks(spark, rows).limit(0), str(tmp_path / "e"), ["time", "seq"], 5)
    assert len(empty) == 0 and empty.read().count() == 0
    with pytest.raises(ValueError):
        one.batches(0)
