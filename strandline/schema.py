"""Logical tables and the views that carry them over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Horizons of prediction, in seconds.
HORIZONS = (1, 5, 10, 30, 60, 120, 300, 600)

TRADES = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("time", T.TimestampType()), ("ticker", T.StringType()), ("dsecs", T.DoubleType()), ("gkyz_vol_1min_annual", T.DoubleType()), ("gkyz_vol_5min_annual", T.DoubleType()),
        ("conditions", T.StringType()), ("correction", T.IntegerType()), ("exchange", T.IntegerType()), ("id", T.LongType()), ("participant_timestamp", T.LongType()), ("price", T.DoubleType()),
        ("sequence_number", T.IntegerType()), ("sip_timestamp", T.LongType()), ("size", T.IntegerType()), ("tape", T.IntegerType()), ("trf_id", T.IntegerType()), ("trf_timestamp", T.LongType()),
        ("vwap_exp_3min", T.DoubleType()), ("vwap_exp_10min", T.DoubleType()),
    )]
)
OPTIONS = T.StructType(
    [T.StructField("time", T.TimestampType()), T.StructField("raw_ticker", T.StringType()), T.StructField("underlying_ticker", T.StringType()), T.StructField("exp_date", T.DateType()), T.StructField("option_type", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("strike_price", "option_price", "option_volume", "underlying_price", "lag_ms", "min_distance_ms", "avg_distance_ms")]
    + [T.StructField("buckets_used", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("time_to_expiry", "moneyness", "days_to_expiry", "delta", "gamma", "theta", "vega", "rho", "implied_vol", "gkyz_vol_1min_annual", "gkyz_vol_5min_annual", "theoretical_price_1m", "theoretical_price_5m")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades; (time, sequence_number) is the total order of a ticker."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("sequence_number"),
        F.when(F.col("value") > 0, F.col("value")).alias("price"), F.get_json_object("props", "$.k").cast("int").alias("size"), F.col("user_id").alias("exchange"),
    )


TRADES_SQL = """trades AS (SELECT event_id AS id, event_type AS ticker, ts AS time, event_id AS sequence_number, CASE WHEN value > 0 THEN value END AS price,
  CAST(json_extract_string(props, '$.k') AS INT) AS size, user_id AS exchange FROM events)"""


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as options contracts; constants are doubles on purpose (band edges)."""
    d = lambda x: F.lit(float(x))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    call = F.col("l_linestatus") == "F"
    delta = d(0.1) + d(10) * F.col("l_tax")
    moneyness = d(0.9) + d(0.005) * (F.col("l_partkey") % 41).cast("double")
    return rows.select(
        F.col("l_shipdate").cast("timestamp").alias("time"), F.col("p_type").alias("underlying_ticker"), F.when(call, "call").otherwise("put").alias("option_type"), d(100).alias("underlying_price"),
        moneyness.alias("moneyness"), (d(100) * moneyness).alias("strike_price"), (d(2) * F.col("l_quantity")).alias("days_to_expiry"), (d(0.15) + d(2) * F.col("l_discount")).alias("implied_vol"),
        F.when(call, delta).otherwise(-delta).alias("delta"), (d(0.01) + F.col("l_tax")).alias("gamma"), (d(0.1) + F.col("l_discount")).alias("vega"), (d(-0.01) - F.col("l_tax")).alias("theta"),
        F.col("l_quantity").alias("option_volume"), (d(100) * F.col("l_linenumber")).alias("open_interest"),
    )


OPTIONS_SQL = """options AS (SELECT l_shipdate AS time, p_type AS underlying_ticker, CASE WHEN l_linestatus = 'F' THEN 'call' ELSE 'put' END AS option_type, 100::DOUBLE AS underlying_price,
  0.9::DOUBLE + 0.005::DOUBLE * (l_partkey % 41)::DOUBLE AS moneyness, 100::DOUBLE * (0.9::DOUBLE + 0.005::DOUBLE * (l_partkey % 41)::DOUBLE) AS strike_price, 2::DOUBLE * l_quantity AS days_to_expiry,
  0.15::DOUBLE + 2::DOUBLE * l_discount AS implied_vol, (CASE WHEN l_linestatus = 'F' THEN 1::DOUBLE ELSE -1::DOUBLE END) * (0.1::DOUBLE + 10::DOUBLE * l_tax) AS delta, 0.01::DOUBLE + l_tax AS gamma,
  0.1::DOUBLE + l_discount AS vega, -0.01::DOUBLE - l_tax AS theta, l_quantity AS option_volume, 100::DOUBLE * l_linenumber AS open_interest FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as model outputs: 64 logits, the label as target bucket, the horizon from the id."""
    horizons = F.array(*map(F.lit, HORIZONS))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.element_at(horizons, (F.col("vec_id") % 8 + 1).cast("int")).alias("horizon"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").alias("target")
    )


PREDICTIONS_SQL = f"""predictions AS (SELECT vec_id AS id, list_extract([{", ".join(map(str, HORIZONS))}], vec_id % 8 + 1) AS horizon,
  list_transform(embedding, lambda x: x::DOUBLE) AS logits, label AS target FROM embeddings),
probabilities AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM predictions))"""
