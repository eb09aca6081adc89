"""Every registered market query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return f"{round(float(x), 4) + 0.0:.4f}" if abs(x) < 1e12 else str(float(x))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(_cell(r[c]) for c in columns) for r in df.collect())
    con = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})")
    assert ours == sorted(tuple(map(_cell, r)) for r in con.fetchall())
