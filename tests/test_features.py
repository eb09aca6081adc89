from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from strandline.operators import features, rolling

KEYS, ORDER = ["k"], ["i"]


def run(spark, rows, schema, **columns):
    df = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], f"k string, i int, {schema}")
    return [r.asDict() for r in df.withColumns(columns).orderBy("i").collect()]


def test_log_returns(spark):
    w = rolling.series(KEYS, ORDER)
    got = run(spark, [(float(p),) for p in range(100, 106)], "p double", r1=features.log_return(w, F.col("p"), 1), r2=features.log_return(w, F.col("p"), 2))
    assert [r["r1"] for r in got][0] is None and got[1]["r2"] is None
    assert got[3]["r1"] == pytest.approx(math.log(103 / 102)) and got[5]["r2"] == pytest.approx(math.log(105 / 103))


@pytest.mark.parametrize("prices", [[100.0, 0.0, 102.0, 103.0], [100.0, -101.0, 102.0, 103.0]])
def test_bad_prices_give_null(spark, prices):
    got = run(spark, [(p,) for p in prices], "p double", r=features.log_return(rolling.series(KEYS, ORDER), F.col("p"), 1))
    assert [r["r"] is None for r in got] == [True, True, True, False]


def test_short_input_and_bad_k(spark):
    w = rolling.series(KEYS, ORDER)
    assert all(r["r"] is None for r in run(spark, [(100.0,), (101.0,)], "p double", r=features.log_return(w, F.col("p"), 5)))
    with pytest.raises(ValueError):
        features.log_return(w, F.col("p"), 0)


def test_vwap_deviation(spark):
    p, v = [100, 101, 100.5, 102, 101.5], [1000, 2000, 1500, 1800, 1200]
    got = run(spark, [(float(a), float(b)) for a, b in zip(p, v, strict=True)], "p double, v double", d=features.vwap_deviation(rolling.series(KEYS, ORDER), F.col("p"), F.col("v"), 3))
    want = [None, None] + [math.log(p[i] / (sum(p[j] * v[j] for j in range(i - 2, i + 1)) / sum(v[i - 2 : i + 1]))) for i in range(2, 5)]
    assert [r["d"] for r in got] == [None if w is None else pytest.approx(w) for w in want]


def test_zero_volume_window_gives_null(spark):
    got = run(spark, [(1.0, 0.0), (1.0, 0.0)], "p double, v double", d=features.vwap_deviation(rolling.series(KEYS, ORDER), F.col("p"), F.col("v"), 2))
    assert got[1]["d"] is None


def test_realized_volatility(spark):
    got = run(spark, [(r,) for r in (0.01, -0.01, 0.01, -0.01, 0.01)], "r double", v=features.realized_volatility(rolling.series(KEYS, ORDER), F.col("r"), 4, 1.0))
    assert [r["v"] for r in got] == [None, None, None, pytest.approx(1.0), pytest.approx(1.0)]


def test_vol_of_vol_skips_nulls(spark):
    values = [None, 20.0, 22.0, 19.0, 23.0]
    got = run(spark, [(v,) for v in values], "rv double", v=features.vol_of_vol(rolling.series(KEYS, ORDER), F.col("rv"), 3))
    assert got[1]["v"] is None and got[2]["v"] == pytest.approx(statistics.pstdev([20, 22])) and got[4]["v"] == pytest.approx(statistics.pstdev([22, 19, 23]))


def test_long_frames_equal_direct_ones(spark):
    w, n = rolling.series(KEYS, ORDER), rolling.DIRECT_ROWS + 20
    x = F.col("x")
    got = run(spark, [(math.sin(i * 1.7),) for i in range(200)], "x double", s=rolling.rolling_sum(w, n, x), d=rolling.rolling_std(w, n, x), s0=F.sum(x).over(rolling.last_rows(w, n)), d0=F.stddev_pop(x).over(rolling.last_rows(w, n)))
    assert all(r["s"] == pytest.approx(r["s0"], abs=1e-9) and r["d"] == pytest.approx(r["d0"], abs=1e-6) for r in got)


def test_order_flow(spark):
    prices, sizes = [100, 101, 100.5, 100.5, 101.5, 101], [10, 20, 15, 12, 18, 25]
    df = spark.createDataFrame([("a", i, float(p), s) for i, (p, s) in enumerate(zip(prices, sizes, strict=True))], "k string, i int, price double, size int").withColumn("time", F.timestamp_seconds("i"))
    cfg = features.OrderFlowConfig(imbalance_window=3, arrival_window=3)
    got = features.order_flow_features(df, keys=KEYS, order=ORDER, cfg=cfg).orderBy("i").collect()
    assert [r["direction"] for r in got] == [0, 1, -1, -1, 1, -1]
    assert got[2]["trade_imbalance"] == pytest.approx(5 / 45) and got[1]["trade_imbalance"] is None
    assert got[2]["size_q50"] == 15 and got[2]["size_q25"] == 12.5 and got[2]["arrival_rate"] == 1.0


def test_zero_ticks_keep_the_last_direction(spark):
    got = run(spark, [(float(p),) for p in (100, 100, 100, 101, 101, 99)], "p double", b=F.lag("p").over(rolling.series(KEYS, ORDER)))
    df = spark.createDataFrame([("a", r["i"], r["p"], r["b"]) for r in got], "k string, i int, p double, b double")
    out = df.withColumn("d", features.trade_direction(rolling.series(KEYS, ORDER), F.col("p"), F.col("b"))).orderBy("i").collect()
    assert [r["d"] for r in out] == [0, 0, 0, 1, 1, -1]


def test_names():
    assert features.PriceConfig().names()[0] == "log_return_1s" and features.OrderFlowConfig().names()[1:4] == ["size_q25", "size_q50", "size_q75"]
    with pytest.raises(ValueError):
        features.VolatilityConfig(windows=(1,))


def test_row_index_and_chunks(spark):
    df = spark.createDataFrame([("a", i, float(100 + i % 7)) for i in range(500)], "k string, i int, price double").withColumns({"time": F.timestamp_seconds(F.col("i") * 3600), "volume": F.lit(1.0)})
    indexed = rolling.with_row_index(df, KEYS, "time", ["i"])
    assert indexed.where("row_index <> i").count() == 0
    cfg = features.PriceConfig(return_windows=(1, 30), vwap_window=20)
    whole = features.price_features(indexed, keys=KEYS, order=ORDER, cfg=cfg)
    cut = rolling.in_chunks(indexed, KEYS, "row_index", 30, lambda x, keys: features.price_features(x, keys=keys, order=ORDER, cfg=cfg), chunk=64)
    both = whole.join(cut.select("i", *[F.col(c).alias(f"{c}_") for c in cfg.names()]), "i")
    assert both.count() == 500
    assert both.where(" or ".join(f"not (round({c}, 9) <=> round({c}_, 9))" for c in cfg.names())).count() == 0
