"""Queries of sources and sinks: a database and back, files by their index, vectors as JSON, stored sketches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import sketches
from strandline.sources import file_index, files, introspect, shards

LOW, HIGH = "2024-01-10 12:00:00", "2024-01-12 06:00:00"
INDEX_FILES = 16


def _path(spark: SparkSession, name: str) -> str:
    return f"{files.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def database_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written to embedded databases, changed there and read again with filters that the databases apply."""
    table, _ = shards.ShardedTable.write(schema.table(spark, d, "orders"), _path(spark, "orders-db"), "o_orderkey")
    table, _ = table.execute(spark, "DELETE FROM rows WHERE o_orderstatus = ?", ["P"])
    rows = table.read(spark, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "o_orderstatus = ? AND o_totalprice > ?", ["F", 1000.0])
    return rows.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("date_us"))


def _indexed_events(spark: SparkSession, d: str) -> file_index.FileIndex:
    """Events in files by time, with an index of them."""
    path = _path(spark, "events")
    schema.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(INDEX_FILES, "ts").write.parquet(path)
    return file_index.FileIndex.write(spark, path, ["ts", "event_id"], _path(spark, "index"))


def indexed_range(spark: SparkSession, d: str) -> DataFrame:
    index = _indexed_events(spark, d)
    low, high = (F.lit(x).cast("timestamp") for x in (LOW, HIGH))
    return index.read(spark, "ts", low, high).select("event_id", "event_type", F.unix_micros("ts").alias("ts_us"))


def file_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What the index says of all files together."""
    entries = _indexed_events(spark, d).entries(spark)
    return entries.agg(F.sum("rows").alias("n"), F.unix_micros(F.min("least_ts")).alias("first_us"), F.unix_micros(F.max("greatest_ts")).alias("last_us"), F.min("least_event_id").alias("least_id"), F.max("greatest_event_id").alias("greatest_id"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings with infinities and NaN written as JSON and read again."""
    rows = schema.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    odd = F.when(F.col("label") % 7 == 0, F.lit(float("inf"))).when(F.col("label") % 7 == 1, F.lit(float("-inf"))).when(F.col("label") % 7 == 2, F.lit(float("nan"))).otherwise(F.get("v", F.lit(0)))
    changed = rows.select("vec_id", F.transform("v", lambda x, i: F.when(i == 0, odd).otherwise(x)).alias("v"), odd.alias("first"))
    path = _path(spark, "vectors")
    files.write_vectors(changed, path)
    back = files.read_vectors(spark, path, changed.schema)
    kind = lambda x: F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x.isNull(), "null").otherwise("number")
    finite = F.filter("v", lambda x: x.isNotNull() & (F.abs(x) < 1e300))
    return back.select("vec_id", kind(F.get("v", F.lit(0))).alias("kind"), kind(F.col("first")).alias("kind_alone"), F.size("v").alias("n"), F.round(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def sketched_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Users of each two types of events, from sketches by day and type that are merged and intersected.

    estimate is within five standard errors of the exact count (``within``); below 2**SIZE users it is exact.
    """
    events = schema.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = files.staged(sketches.sketch_by(events, ["day", "event_type"], "user_id"), "sketches")
    whole = sketches.merged(daily, ["event_type"])
    a, b = whole.select(F.col("event_type").alias("a"), F.col("sketch").alias("x")), whole.select(F.col("event_type").alias("b"), F.col("sketch").alias("y"))
    found = a.join(b, F.col("a") < F.col("b")).select("a", "b", sketches.distinct(F.col("x")).alias("in_a"), sketches.distinct(F.col("y")).alias("in_b"), sketches.both(F.col("x"), F.col("y")).alias("estimate"), sketches.distinct(F.theta_union("x", "y")).alias("either"))
    users = events.select("user_id", "event_type").where("user_id IS NOT NULL").distinct()
    pairs = users.withColumnRenamed("event_type", "a").join(users.withColumnRenamed("event_type", "b"), "user_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("in_both"))
    within = F.abs(F.col("estimate") - F.col("in_both")) <= 5 * sketches.standard_error() * F.col("either")
    return found.join(pairs, ["a", "b"]).select("a", "b", "in_both", within.alias("within"))


def all_columns(spark: SparkSession, d: str) -> DataFrame:
    """Name, place, type, nullability and nulls of the columns of all tables; the nulls are counted in the rows."""
    out: DataFrame | None = None
    for name in TABLES:
        table = schema.table(spark, d, name)
        nulls = table.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(table.columns, 1)])
        each = nulls.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal_position"), F.col(f"n{i}").alias("nulls")) for i in range(1, len(table.columns) + 1)])).alias("x")).select("x.*")
        part = introspect.table_schema(table).join(each, "ordinal_position").select(F.lit(name).alias("table_name"), "column_name", "ordinal_position", _sql_type(F.col("data_type")).alias("data_type"), "is_nullable", "nulls")
        out = part if out is None else out.unionByName(part)
    return out


#: The driver's tables. Fixed names of types: Spark's, and those of information_schema.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOAT[]", "array<double>": "DOUBLE[]"}


def _sql_type(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


_NULLS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, nulls FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE nulls)" for t in TABLES)
_TABLES = ", ".join(f"'{t}'" for t in TABLES)

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "s08_database_round_trip": (database_round_trip, "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, epoch_us(o_orderdate) AS date_us FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    "s11_indexed_range": (indexed_range, f"SELECT event_id, event_type, epoch_us(ts) AS ts_us FROM events WHERE ts BETWEEN TIMESTAMP '{LOW}' AND TIMESTAMP '{HIGH}'"),
    "s12_file_ranges": (file_ranges, "SELECT count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, min(event_id) AS least_id, max(event_id) AS greatest_id FROM events"),
    "s15_vectors": (vectors, """SELECT vec_id, k AS kind, k AS kind_alone, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - CASE WHEN k <> 'number' THEN embedding[1]::DOUBLE ELSE 0 END, 4) AS total
FROM (SELECT *, CASE label % 7 WHEN 0 THEN 'inf' WHEN 1 THEN '-inf' WHEN 2 THEN 'null' ELSE 'number' END AS k FROM embeddings)"""),
    "a02_sketched_overlap": (sketched_overlap, "WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id IS NOT NULL) SELECT x.event_type AS a, y.event_type AS b, count(*) AS in_both, true AS within FROM u x JOIN u y ON x.user_id = y.user_id AND x.event_type < y.event_type GROUP BY x.event_type, y.event_type"),
    "s10_all_columns": (all_columns, f"SELECT c.table_name, c.column_name, c.ordinal_position, c.data_type, c.is_nullable, n.nulls FROM information_schema.columns c JOIN ({_NULLS}) n ON n.table_name = c.table_name AND n.column_name = c.column_name WHERE c.table_name IN ({_TABLES})"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
