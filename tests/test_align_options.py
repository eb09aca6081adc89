from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandline.functions import discretize as D
from strandline.operators import align, options, splits


def as_of(spark, obs, grid):
    o = spark.createDataFrame([("a", t, i, v) for i, (t, v) in enumerate(obs)], "k string, t long, seq int, v double")
    g = spark.createDataFrame([("a", t) for t in grid], "k string, g long")
    out = align.as_of(g, o, keys=["k"], grid_us="g", obs_us="t", order=["seq"], values=["v"]).orderBy("g").collect()
    return [r["v"] for r in out], [r["valid"] for r in out]


def test_as_of(spark):
    assert as_of(spark, [(0, 10.0), (2, 20.0), (5, 30.0)], range(6))[0] == [10, 10, 20, 20, 20, 30]
    assert as_of(spark, [(5, 100.0), (10, 200.0)], [0, 2, 5, 7, 10]) == ([None, None, 100, 100, 200], [False, False, True, True, True])


def test_as_of_ties_and_null_values(spark):
    assert as_of(spark, [(1, 20.0), (1, 21.0), (3, None)], [1, 2, 3, 4]) == ([21, 21, None, None], [True] * 4)


def test_grid(spark):
    ends = spark.createDataFrame([("a", 1_000_000_000)], "k string, end_us long")
    got = [r["grid_us"] // 1_000_000 for r in align.time_grid(ends, align.SequenceConfig(10, 1)).orderBy("grid_us").collect()]
    assert got == list(range(991, 1001))
    ends = spark.createDataFrame([("a", 100_000_000)], "k string, end_us long")
    assert [r["grid_us"] // 1_000_000 for r in align.time_grid(ends, align.SequenceConfig(20, 5)).orderBy("grid_us").collect()] == [85, 90, 95, 100]
    with pytest.raises(ValueError):
        align.SequenceConfig(1, 5)


def test_volume_cells(spark):
    g = spark.createDataFrame([("a", t) for t in (0, 2, 4, 6, 8)], "k string, grid_us long")
    t = spark.createDataFrame([("a", s, v) for s, v in ((0, 10), (1, 50), (2, 40), (3, 50), (4, 20), (5, 40))], "k string, t long, v int")
    got = align.volume_cells(g, t, keys=["k"], origin_us=0, step_us=2, time_us="t", volume="v").orderBy("grid_us").collect()
    assert [r["volume"] for r in got] == [60, 90, 60, 0, 0]


def test_gaps(spark):
    df = spark.createDataFrame([("a", i, float(t), float(i + 1)) for i, t in enumerate([0, 1, 2, 18002, 18003])], "k string, i int, t double, v double")
    flagged = df.withColumn("gap", align.gap_flag(["k"], ["i"], F.col("t")))
    assert [r["gap"] for r in flagged.orderBy("i").collect()] == [False, False, False, True, False]
    values = lambda s: [r["v"] for r in align.handle_overnight(flagged, s, keys=["k"], index="i", gap="gap", columns=["v"]).orderBy("i").collect()]
    assert values(align.OvernightStrategy.RESET) == [None, None, None, 4, 5]
    assert values(align.OvernightStrategy.MASK) == [1, 2, 3, None, 5]
    assert values(align.OvernightStrategy.INTERPOLATE) == [1, 2, 3, 4, 5]


def test_longest_valid_run(spark):
    df = spark.createDataFrame([("a", i, c == "1") for i, c in enumerate("0111011101")], "k string, i int, ok boolean")
    assert align.longest_valid_run(df, keys=["k"], index="i", valid="ok", least_valid=0.3).first()[1:] == (1, 4)
    assert align.longest_valid_run(df, keys=["k"], index="i", valid="ok").first()[1:] == (None, None)


def test_band_join_is_strict(spark):
    a = spark.createDataFrame([(1, 0), (1, 100)], "k int, l long")
    b = spark.createDataFrame([(1, 10), (1, 9), (1, 95), (2, 0)], "k int, r long")
    got = sorted((r["l"], r["r"]) for r in align.band_join(a, b, keys=["k"], left_us="l", right_us="r", band_us=10).collect())
    assert got == [(0, 9), (100, 95)]


def test_options(spark):
    rows = [("call", 0.4, 0.02, 10.0, -0.5, 100.0), ("put", -0.1, 0.015, 12.0, -0.6, 200.0), ("call", 0.3, 0.015, 11.0, -0.4, 100.0)]
    df = spark.createDataFrame([("u", *r) for r in rows], "k string, kind string, delta double, gamma double, vega double, theta double, oi double")
    g = options.net_greeks(*(F.col(c) for c in ("delta", "gamma", "vega", "theta", "oi")))
    got = df.groupBy("k").agg(*[v.alias(n) for n, v in g.items()]).first()
    assert got["net_delta"] == pytest.approx((40 - 20 + 30) / 400) and got["net_gamma"] == pytest.approx(6.5 / 400) and got["net_theta"] == pytest.approx(-(50 + 120 + 40) / 400)
    r = options.put_call_ratios(F.col("kind"), F.col("oi"), F.col("oi"))
    assert df.groupBy("k").agg(r["pc_oi_ratio"].alias("x")).first()["x"] == 1.0
    assert df.where("kind = 'call'").groupBy("k").agg(r["pc_oi_ratio"].alias("x")).first()["x"] == 0.0
    slope = options.term_slope([(7, F.lit(0.20)), (30, F.lit(0.22)), (60, F.lit(0.24)), (90, F.lit(0.26))])
    assert spark.range(1).select(slope.alias("s")).first()["s"] == pytest.approx(7.1415e-4, rel=1e-3)
    assert options.OptionsConfig().names()[1] == "iv_7d_m97" and len(options.OptionsConfig().names()) == 27
    with pytest.raises(ValueError):
        options.options_features(df, keys=["k"])


def test_moneyness_and_days(spark):
    df = spark.range(1).select(options.moneyness(F.lit(95.0), F.lit(100.0)).alias("m"), options.moneyness(F.lit(95.0), F.lit(0.0)).alias("n"), options.days_to_expiry(F.to_timestamp(F.lit("2024-01-08")), F.to_timestamp(F.lit("2024-01-01"))).alias("d"), options.days_to_expiry(F.to_timestamp(F.lit("2023-12-31")), F.to_timestamp(F.lit("2024-01-01"))).alias("e"))
    assert tuple(df.first()) == (0.95, None, 7.0, 0.0)


def test_discretize_edges(spark):
    b = D.return_buckets()
    values = [-60.0, 0.0, 60.0, b.edges[1], b.edges[50], b.edges[51], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("b", b.bucket(F.col("v")))
    assert [r["b"] for r in df.orderBy("i").collect()] == [0, 50, 100, 0, 49, 50, None]
    soft = df.where("b = 50").select(b.soft_labels(F.col("b"), 2.0).alias("s")).first()["s"]
    assert sum(soft) == pytest.approx(1.0) and max(soft) == soft[50] and soft[49] == pytest.approx(soft[51])
    assert D.average_volume_bucket(D.volume_buckets()) == sum(e < 1.0 for e in D.volume_buckets().edges[1:])
    with pytest.raises(ValueError):
        D.return_buckets(100)


def test_splits_and_folds(spark):
    assert {k: v[1] - v[0] for k, v in splits.split_bounds(1000, splits.SplitConfig()).items()} == {"train": 700, "val": 150, "test": 150}
    assert {k: v[1] - v[0] for k, v in splits.split_bounds(1000, splits.SplitConfig(gap=50)).items()} == {"train": 630, "val": 135, "test": 135}
    df = spark.range(1000).selectExpr("'a' as k", "id as i")
    got = {r["split"]: r["count"] for r in splits.chronological_split(df, keys=["k"], index="i", cfg=splits.SplitConfig(gap=50)).groupBy("split").count().collect()}
    assert got == {"train": 630, "val": 135, "test": 135, None: 100}
    folds = splits.rolling_folds(df, keys=["k"], index="i", size=200, step=200).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3, 4] and {r["count"] for r in folds} == {200}
    starts = splits.rolling_folds(df, keys=["k"], index="i", size=200, step=100).select("fold_start").distinct().orderBy("fold_start").collect()
    assert [r[0] for r in starts][:3] == [0, 100, 200] and len(starts) == 9
    with pytest.raises(ValueError):
        splits.split_bounds(100, splits.SplitConfig(gap=50))
