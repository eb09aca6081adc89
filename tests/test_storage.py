"""Databases, file indexes, vectors and sketches."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import sketches
from strandline.sources import database, file_index, files


def test_database(spark, tmp_path):
    db = database.Database.derby(str(tmp_path / "db"))
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id * 0.5) AS x", "concat('name ', id % 7) AS name", "timestamp_seconds(1700000000 + id) AS at")
    assert db.write(rows, "things", mode="overwrite") == 1000
    assert db.write(rows.where("id < 10").withColumn("id", F.col("id") + 1000), "things") == 10  # appended
    back = db.read_ranges(spark, "things", "id", 4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.where("id < 1000").collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    some = back.where((F.col("id") > 990) & (F.col("name") == "name 3"))
    assert any("GreaterThan(id,990)" in x and "EqualTo(name,name 3)" in x for x in database.pushed_filters(some))
    assert {r["id"] for r in some.collect()} == {i for i in range(991, 1000) if i % 7 == 3} | {1003}
    assert db.read_ranges(spark, "things", "at", 3).count() == 1010
    assert db.execute(spark, 'UPDATE things SET "x" = ? WHERE "id" >= ?', [1.5, 1000]) == 10
    assert db.execute(spark, 'DELETE FROM things WHERE "x" IS NULL', []) == 334 and db.read(spark, '(SELECT * FROM things WHERE "id" < 5) t').count() == 3
    assert db.execute(spark, "DELETE FROM things") == 676 and db.read_ranges(spark, "things", "id", 4).count() == 0
    with pytest.raises(ValueError):
        db.read_ranges(spark, "things", "id", 0)


def test_file_index(spark, tmp_path):
    path, at = str(tmp_path / "rows"), str(tmp_path / "index")
    rows = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, id) AS x", "concat('s', id) AS s")
    rows.repartitionByRange(8, "id").write.parquet(path)
    index = file_index.FileIndex.write(spark, path, ["x"], at)
    assert index.total(spark) == 1000
    listed = index.files(spark, "x", 300, 310)
    assert 1 <= len(listed) <= 2
    got = index.read(spark, "x", 300, 310)
    assert sorted(r["id"] for r in got.collect()) == list(range(301, 310)) and {x.rsplit("/", 1)[1] for x in got.inputFiles()} == {x.rsplit("/", 1)[1] for x in listed}
    assert index.read(spark, "x", 5000, None).count() == 0 and index.files(spark, "x", 5000, None) == []
    for low, high in ((None, None), (0, 999), (123, 777), (500, None), (None, 4), (7, 7), (900, 100)):
        want = rows.where(F.col("x").isNotNull() & (F.lit(low is None) | (F.col("x") >= low)) & (F.lit(high is None) | (F.col("x") <= high))).count()
        assert index.count(spark, "x", low, high) == want
    # a later file isn't known until the index is written again
    rows.where("id = 999").write.mode("append").parquet(path)
    assert index.total(spark) == 1000 and file_index.FileIndex.write(spark, path, ["x"], at).total(spark) == 1001


def test_index_of_nulls_only(spark, tmp_path):
    spark.range(5).selectExpr("cast(null as int) AS x", "id").write.parquet(str(tmp_path / "n"))
    index = file_index.FileIndex.write(spark, str(tmp_path / "n"), ["x"], str(tmp_path / "i"))
    assert index.count(spark, "x") == 0 and index.total(spark) == 5 and index.read(spark, "x", 0, 9).count() == 0


def test_infinities_both_ways(spark, tmp_path):
    inf, nan = math.inf, math.nan
    kind = "id int, b double, a array<double>, m array<array<double>>, `a.b` float, s string, p struct<x:double,y:array<double>>"
    rows = [(1, inf, [1.0, nan, inf, -inf], [[inf], []], -inf, '"Infinity"', (inf, [-inf, None])), (2, None, None, [[1.5, nan]], 2.0, "inf", (1.0, [])), (3, nan, [], None, nan, None, None)]
    files.write_vectors(spark.createDataFrame(rows, kind), str(tmp_path / "v"))
    text = {json.loads(r["value"])["id"]: json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "v")).collect()}
    assert text[1] == {"id": 1, "b": "inf", "a": [1.0, None, "inf", "-inf"], "m": [["inf"], []], "a.b": "-inf", "s": '"Infinity"', "p": {"x": "inf", "y": ["-inf", None]}}
    assert text[2]["s"] == "inf" and text[2]["b"] is None and text[3]["p"] is None
    back = {r["id"]: r for r in files.read_vectors(spark, str(tmp_path / "v"), kind).collect()}
    assert (back[1]["b"], back[1]["a"], back[1]["a.b"], back[1]["p"]["y"]) == (inf, [1.0, None, inf, -inf], -inf, [-inf, None])
    assert back[2]["a"] is None and back[3]["b"] is None and back[3]["a"] == [] and back[1]["s"] == '"Infinity"'
    (tmp_path / "given.json").write_text('{"a":[1.0,null,"inf","-inf"],"b":"inf"}\n')
    given = files.read_vectors(spark, str(tmp_path / "given.json"), "a array<double>, b double").first()
    assert given["a"] == [1.0, None, inf, -inf] and given["b"] == inf


def test_sketches(spark):
    rows = spark.range(60_000).selectExpr("id % 2 AS k", "if(id % 97 = 0, null, id % 30000) AS v", "id % 5 AS day").unionByName(spark.range(100).selectExpr("2L AS k", "cast(null as bigint) AS v", "id AS day"))
    daily = sketches.sketch_by(rows, ["k", "day"], "v")
    got = {r["k"]: r["n"] for r in sketches.merged(daily, ["k"]).select("k", sketches.distinct(F.col("sketch")).alias("n")).collect()}
    exact = {r["k"]: r["n"] for r in rows.where("v IS NOT NULL").groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert got.keys() == exact.keys() == {0, 1} and all(abs(got[k] - exact[k]) <= 5 * sketches.standard_error() * exact[k] for k in got)
    small = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(30, 90)], "k string, v int")
    s = {k: sketches.sketch_by(small.where(F.col("k") == k), [], "v", name=k) for k in "ab"}
    one = s["a"].join(s["b"], F.lit(True)).select(sketches.both(F.col("a"), F.col("b")).alias("both"), sketches.only_first(F.col("a"), F.col("b")).alias("first")).first()
    assert (one["both"], one["first"]) == (20, 30)
