"""A table dealt over embedded databases, with two executors in processes of their own."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.sources.shards import ShardedTable

REPO, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"

#: Only processes of a cluster show that no two of them open one database.
ON_CLUSTER = f"""
import sys
from pyspark.sql import SparkSession
from strandline.plans import registry
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.executorEnv.PYTHONPATH", {str(REPO)!r}).config("spark.checkpoint.dir", sys.argv[1]).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
print("rows", registry.queries()["s08_database_round_trip"](spark, {SF!r}).count())
spark.stop()
"""


def test_sharded_table(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id * 0.5D) AS x", "concat('name ', id % 7) AS `a \"b`", "timestamp_seconds(1700000000 + id) AS at", "timestamp_ntz '2024-01-01 10:00:00.5' AS ntz")
    first, n = ShardedTable.write(rows, str(tmp_path / "t"), "id", 4)
    assert n == 1000 and len(first.shards) == 4
    assert sorted(map(tuple, first.read(spark).collect())) == sorted(map(tuple, rows.collect()))
    second, gone = first.execute(spark, "DELETE FROM rows WHERE x IS NULL AND id < ?", [500])
    assert gone == 167 and second.read(spark).count() == 833 and first.read(spark).count() == 1000  # the first stays
    some = second.read(spark, ["id"], "id > ? AND x IS NOT NULL", [900])
    assert {r["id"] for r in some.collect()} == {i for i in range(901, 1000) if i % 3} and some.columns == ["id"]
    empty, n = ShardedTable.write(rows.where(F.col("id") < 0), str(tmp_path / "e"), "id")
    assert n == 0 and empty.read(spark).count() == 0 and empty.execute(spark, "DELETE FROM rows")[1] == 0
    with pytest.raises(ValueError):
        ShardedTable.write(rows, str(tmp_path / "z"), "id", 0)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")
def test_round_trip_on_a_cluster(tmp_path):
    done = subprocess.run([sys.executable, "-c", ON_CLUSTER, str(tmp_path)], cwd=REPO, capture_output=True, text=True, timeout=240, check=False)
    want = duckdb.sql(f"SELECT count(*) FROM '{SF}/orders.parquet' WHERE o_orderstatus = 'F' AND o_totalprice > 1000").fetchall()[0][0]
    assert f"rows {want}" in done.stdout, done.stderr[-2000:]
