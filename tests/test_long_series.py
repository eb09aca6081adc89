"""Long series, cut into chunks and spans, against the same queries in one piece; NaN; the loader bundle."""

from __future__ import annotations

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.operators import features, rolling, splits
from strandline.plans import registry

SF = "/root/testdata/sf0.01"
CUT = ["j01_as_of", "j02_as_of_vector", "j03_aligned_sequence", "w07_price_features", "w11_volatility_features", "w16_order_flow_features", "w22_rolling_correlation", "j10_horizon_labels", "x03_sequences", "a11_longest_valid_run", "w17_gap_reset", "q29_gap_profile", "w20_exponential_vwap", "w23_lead_lag"]


def _rows(df):
    return sorted(tuple(f"{x + 0.0:.4f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", CUT)
def test_cut_series_give_the_same(spark, monkeypatch, name):
    query = registry.queries()[name]
    whole = _rows(query(spark, SF))
    monkeypatch.setattr(rolling, "CHUNK_ROWS", 700)
    monkeypatch.setattr(rolling, "SPAN_US", 40_000_000_000)
    assert _rows(query(spark, SF)) == whole


def _series(spark, n=1500):
    return spark.range(n).select(F.lit("a").alias("k"), F.timestamp_seconds(F.col("id")).alias("time"), F.col("id"), (100 + F.sin(F.col("id") / 7)).alias("price"), (1 + F.col("id") % 5).cast("double").alias("size"))


def test_nan_is_missing_and_passes(spark):
    rows = _series(spark).withColumns({"price": F.when(F.col("id") == 50, F.lit(math.nan)).otherwise(F.col("price")), "size": F.when(F.col("id") == 60, F.lit(math.nan)).otherwise(F.col("size"))})
    keys, order = ["k"], ["time", "id"]
    out = features.volatility_features(rows, keys=keys, order=order)
    out = features.price_features(out, keys=keys, order=order, volume="size")
    got = {r["id"]: r for r in features.order_flow_features(out, keys=keys, order=order).collect()}
    assert got[55]["rv_60s"] is None and got[50]["log_return_1s"] is None and got[51]["log_return_1s"] is None
    for column in ("rv_60s", "rv_300s", "rv_600s", "vol_of_vol", "vwap_deviation", "log_return_300s", "trade_imbalance", "size_q50"):
        assert math.isfinite(got[1000][column]), column
    assert got[51]["direction"] == got[49]["direction"]


def test_loader_bundle(spark):
    rows = _series(spark, 200)
    bundle = splits.split_loaders(rows, keys=["k"], index="id", features=["price"], targets=[("price", 2)], length=10, batch_size=16, cfg=splits.SplitConfig(0.7, 0.15, 0.15))
    counts = {name: df and {r["batch"]: r["count"] for r in df.groupBy("batch").count().collect()} for name, df in bundle.items()}
    assert counts == {"train": {i: 16 for i in range(8)}, "val": {0: 16, 1: 3}, "test": {0: 16, 1: 3}}
    first = bundle["val"].where("start = 0").first()
    assert first["features"][0][0] == pytest.approx(100 + math.sin(140 / 7)) and first["target_2"] == pytest.approx(100 + math.sin(151 / 7))
    short = splits.split_loaders(rows, keys=["k"], index="id", features=["price"], targets=[("price", 2)], length=29, batch_size=16)
    assert short["val"] is None and short["test"] is None and short["train"] is not None
