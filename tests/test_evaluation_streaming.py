from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import evaluation as E
from strandline.sources import config, files
from strandline.streaming import buffers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_distribution_expressions(spark):
    x = [0.3, -1.0, 2.0, 0.5]
    p = np.exp(np.array(x) - 2.0)
    p /= p.sum()
    lit = F.array(*map(F.lit, x))
    got = one(spark, s=A.softmax(lit), l=A.log_softmax(lit), h=A.entropy(A.softmax(lit)), c=A.cumulative(A.softmax(lit)), e=A.emd(A.softmax(lit), A.one_hot(F.lit(1), F.lit(4)), 2), m=A.argmax(lit))
    assert np.allclose(got["s"], p) and np.allclose(got["l"], np.log(p)) and got["h"] == pytest.approx(-(p * np.log(p)).sum()) and np.allclose(got["c"], p.cumsum()) and got["m"] == 2
    assert got["e"] == pytest.approx(math.sqrt(((p.cumsum() - np.array([0, 1, 1, 1])) ** 2).sum()))


def test_brier_and_finite(spark):
    uniform = F.array(*[F.lit(0.25)] * 4)
    got = one(spark, b=A.brier(uniform, F.lit(0)), n=A.finite_or_zero(F.lit(float("nan"))), i=A.finite_or_zero(F.lit(float("inf"))), v=A.finite_or_zero(F.lit(2.0)), z=A.finite_or_zero(F.lit(None).cast("double")))
    assert tuple(got) == (pytest.approx(0.75), 0.0, 0.0, 2.0, 0.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "horizon int, probs array<double>, target int")


def test_mean_direction_and_bins(spark):
    centers = E.default_centers(101)
    hot = lambda i: [1.0 if j == i else 0.0 for j in range(101)]
    rows = E.with_moments(frame(spark, [(1, hot(50), 50), (1, hot(60), 70)]), centers).orderBy("target").collect()
    assert [r["mean_bps"] for r in rows] == [pytest.approx(0.0), pytest.approx(10.0)]
    m = E.metrics_by_horizon(frame(spark, [(1, hot(50), 50)]), centers, threshold=1.0).first()
    assert m["directional_accuracy"] == 0.5
    bins = one(spark, a=E.confidence_bin(F.lit(0.1), 10), b=E.confidence_bin(F.lit(0.0999), 10), c=E.confidence_bin(F.lit(1.0), 10))
    assert tuple(bins) == (1, 0, 9)


def test_pnl_without_trades(spark):
    got = E.simulate_pnl(frame(spark, [(1, [0.5, 0.5], 1)]), [-1.0, 1.0], confidence=0.9).first()
    assert (got["total_pnl"], got["sharpe"], got["n_trades"]) == (0.0, 0.0, 0)


def test_temperature_finds_the_optimum(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 4))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = [int(rng.choice(4, p=q)) for q in p]
    df = spark.createDataFrame([(1, [float(3 * v) for v in r], t) for r, t in zip(z, y, strict=True)], "horizon int, logits array<double>, target int")
    t = E.TemperatureScaling().fit(df).temperatures[1]

    def nll(t):
        s = 3 * z / t
        return -(s[np.arange(400), y] - np.log(np.exp(s).sum(1))).mean()

    assert nll(t) <= min(nll(x) for x in np.linspace(1, 6, 101)) + 1e-9
    with pytest.raises(RuntimeError):
        E.TemperatureScaling().transform(df)


def test_losses_and_weights(spark):
    with pytest.raises(ValueError):
        E.loss("other", F.col("l"), F.col("t"), 4)
    by = spark.createDataFrame([(1, 2.0), (5, 4.0)], "horizon int, loss double")
    assert E.multi_horizon_loss(by, {1: 1.0, 5: 3.0}).first()["loss"] == pytest.approx(3.5)
    with pytest.raises(ValueError):
        E.multi_horizon_loss(by, {1: 1.0})


def test_buffer_and_matrix():
    b = buffers.RollingBuffer(3)
    b.push(np.arange(12.0).reshape(4, 3))
    assert len(b) == 3 and b.is_full and b.rows[0, 0] == 3 and b.last_n(4) is None and b.last_n(2)[0, 0] == 6
    b.clear()
    assert len(b) == 0
    price = 100 + np.sin(np.arange(400))
    m = buffers.feature_matrix(price, np.ones(400), 10)
    assert m.shape == (10, len(buffers.FEATURES)) and m[-1, 0] == pytest.approx(math.log(price[-1] / price[-2])) and m[-1, -1] == 0.0 or np.isfinite(m).all()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i * 1_000_000, i, 100.0 + (i * 37 % 11), 1.0 + i % 3) for i in range(120)] + [("b", i, i, 50.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, buffers.TICK_SCHEMA)
    for part in range(3):
        df.where(f"seq % 120 div 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    cfg = buffers.BufferConfig(lookback_seconds=80, sequence_length=20)
    stream = buffers.online_features(files.stream_table(spark, str(tmp_path / "in"), df.schema, files_per_trigger=100), cfg)
    q = stream.writeStream.format("memory").queryName("online_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("online_out").collect()
    assert [r["series"] for r in got] == ["a"] and got[0]["buffered"] == 80
    want = buffers.feature_matrix(np.array([r[3] for r in rows[40:120]]), np.array([r[4] for r in rows[40:120]]), 20)
    assert np.allclose(np.array(got[0]["matrix"]), want)
    scored = buffers.score_with(spark.table("online_out"), lambda x: np.full((len(x), 2, 4), 0.25), 2, 4).first()
    assert scored["distributions"] == [[0.25] * 4] * 2


def test_config(tmp_path):
    text = "# comment\n\nDB_HOST = h\nDB_PORT=5432\nDB_NAME=n\nDB_USER=u\nDB_PASSWORD=a=b\n"
    (tmp_path / "env").write_text(text)
    cfg = config.DatabaseConfig.from_env_file(str(tmp_path / "env"))
    assert cfg.password == "a=b" and cfg.jdbc_options()["url"] == "jdbc:postgresql://h:5432/n"
    with pytest.raises(FileNotFoundError):
        config.DatabaseConfig.from_env_file(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        config.DatabaseConfig.from_mapping({})


def test_sql_parameters(spark):
    assert config.query_rows(spark, "SELECT :x + 1 AS y", {"x": 2}) == [{"y": 3}]
    assert config.query_one(spark, "SELECT ? AS y", [5]) == {"y": 5}
    assert config.query_one(spark, "SELECT 1 AS y WHERE false") is None


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("nan")]), (2, 3.0, None)], "i int, v double, a array<double>")
    files.write_vectors(df, str(tmp_path / "v"))
    got = files.read_vectors(spark, str(tmp_path / "v"), df.schema).orderBy("i").collect()
    assert got[0]["v"] is None and got[0]["a"] == [1.0, None] and got[1]["v"] == 3.0
    dated = df.withColumn("time", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    files.write_table(dated, str(tmp_path / "t"))
    assert files.read_table(spark, str(tmp_path / "t")).where("date = '2024-01-01'").count() == 2


def test_parity_can_fail(spark):
    left = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1e-7, 5.0])], "id long, x array<double>")
    right = spark.createDataFrame([(1, [1.0, 2.1]), (2, [1.0, 2.0000001]), (3, [3e-7, 5.0])], "id long, x array<double>")
    out = E.parity(left, right, keys=["id"], column="x")
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["passed"] for i in (1, 2, 3)] == [False, True, True]
    assert got[1]["rel_diff"] == pytest.approx(0.1 / 2.1) and got[3]["rel_diff"] == pytest.approx(2 / 3)
    assert E.parity_report(out).startswith("FAILED: 3 compared, 1 over")


def test_calibration_tail_and_report(spark):
    rows = spark.range(10).selectExpr("'a' as k", "id as i").unionByName(spark.range(1).selectExpr("'b' as k", "id as i"))
    tail = E.calibration_tail(rows, keys=["k"], index="i", share=0.3)
    assert sorted((r["k"], r["i"]) for r in tail.collect()) == [("a", 7), ("a", 8), ("a", 9), ("b", 0)]
    text = E.calibration_report({1: {"nll": 2.0, "ece": 0.2}}, {1: {"nll": 1.5, "ece": 0.04}}, {1: 1.25})
    assert "1.250" in text and text.endswith("mean ece 0.0400: excellent")


def test_history_is_appended(spark, tmp_path):
    path = str(tmp_path / "history")
    assert E.append_history(spark.createDataFrame([(1, 0.5)], "epoch int, val_loss double"), path) == 1
    assert E.append_history(spark.createDataFrame([(2, 0.4), (3, 0.6)], "epoch int, val_loss double"), path) == 2
    assert [r["epoch"] for r in E.keep_best(spark.read.parquet(path), 2).collect()] == [2, 1]


def test_state_over_triggers_and_gaps(spark, tmp_path):
    """One file a trigger gives the state of one batch; a gap clears the buffer."""
    ticks = [("a", i * 1_000_000 + (10**10 if i >= 70 else 0), i, 100.0 + i % 9, 1.0 + i % 4) for i in range(140)]
    for n in range(4):
        spark.createDataFrame(ticks[n * 35 : n * 35 + 35], buffers.TICK_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))

    def run(name, per_trigger, gap):
        stream = spark.readStream.schema(buffers.TICK_SCHEMA).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        cfg = buffers.BufferConfig(lookback_seconds=100, sequence_length=60, reset_gap_seconds=gap)
        out = buffers.online_features(stream, cfg).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        out.awaitTermination()
        return max(spark.read.parquet(str(tmp_path / name)).collect(), key=lambda r: r["ts_us"])

    once, often = run("once", 100, None), run("often", 1, None)
    assert once == often and once["buffered"] == 100
    assert run("gap", 1, 3600.0)["buffered"] == 70
