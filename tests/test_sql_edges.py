"""Rows that the test tables lack, against the queries' SQL: windows with nulls, short runs in long series."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.plans import registry


def _written(rows, tmp_path):
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def _events(spark, n, value):
    return spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id)").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.expr(value).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 50, F.lit("}")).alias("props"))


def _against_sql(spark, name, d):
    df = registry.queries()[name](spark, d)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    cell = lambda x: "null" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()), sorted(tuple(map(cell, r)) for r in want)


def test_sequences_with_nulls(spark, tmp_path):
    # a value of 0 is no price; rows 100 to 130 have none, so some windows have no price at all
    rows = _events(spark, 200, "if(id = 40 OR id BETWEEN 100 AND 130, 0D, id + 0.25D)")
    ours, want = _against_sql(spark, "x03_sequences", _written(rows, tmp_path))
    assert ours == want and len(ours) == 171 and any(r[1] == "null" for r in ours)


@pytest.mark.parametrize(("value", "n"), [("if(id % 3 = 0 OR id = 1000, 50D, 150D)", 1), ("150D", 0)])
def test_short_run_of_a_long_series(spark, tmp_path, value, n):
    ours, want = _against_sql(spark, "a11_longest_valid_run", _written(_events(spark, 3000, value), tmp_path))
    assert ours == want and len(ours) == n
