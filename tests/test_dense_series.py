"""Series so dense that a day of them would be one task's: spans and tasks follow the number of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import align, rolling


def test_dense_spans_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(rolling, "CHUNK_ROWS", 1000)
    monkeypatch.setattr(rolling, "SPAN_ROWS", 500)
    monkeypatch.setattr(rolling, "TASK_ROWS", 600)
    obs = spark.range(6000).select(F.lit("a").alias("k"), (F.col("id") * 2000).alias("t"), "id")
    grid = spark.range(6000).select(F.lit("a").alias("k"), (F.col("id") * 2000 + 1999).alias("g"))
    # twelve thousand rows in twelve seconds: spans of half a second, twenty tasks
    span_us, tasks = rolling.spans_of(obs.selectExpr("k", "t").unionByName(grid.selectExpr("k", "g AS t")), ["k"], "t")
    assert 499_000 <= span_us <= 501_000 and tasks == 20
    out = align.as_of(grid, obs, keys=["k"], grid_us="g", obs_us="t", order=["id"], values=["id"])
    assert out.where(F.col("id") * 2000 + 1999 != F.col("g")).count() == 0 and out.count() == 6000
