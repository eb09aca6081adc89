"""Queries of the streaming operators: a finite stream is run to its end and its output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import rolling, sampler
from strandline.sources import files
from strandline.streaming import buffers, processor, sinks

#: Files of a trigger of the sliced stream.
SLICE_FILES = 2
SESSION = processor.SessionConfig(buffers.BufferConfig(lookback_seconds=301, sequence_length=5), close_us=12 * 3_600_000_000)


def _finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Output of a stream over all that is there now."""
    path = f"{files.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _as_ticks(events: DataFrame) -> DataFrame:
    time = F.col("ts").cast("timestamp")
    return events.select(F.col("event_type").alias("series"), F.unix_micros(time).alias("ts_us"), F.col("event_id").alias("seq"), F.when(F.col("value") > 0, F.col("value")).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), time.alias("time"))


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return _as_ticks(spark.readStream.schema(schema.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d))


def online(spark: SparkSession, d: str) -> DataFrame:
    ticks = _ticks(spark, d).drop("time")
    out = _finished(spark, buffers.online_features(ticks, buffers.BufferConfig(lookback_seconds=301)))
    return out.select("series", "ts_us", "buffered", *[F.round(F.get("last", F.lit(i)), 5).alias(c) for i, c in enumerate(buffers.FEATURES)])


def _in_slices(spark: SparkSession, d: str, slices: int = 4) -> DataFrame:
    """The events as a stream that comes in ``slices`` triggers, in order of time."""
    events = schema.table(spark, d, "events")
    base = f"{files.shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    ordered = sampler.TemporalSampler.write(events, f"{base}/ordered", ["ts", "event_id"], 16)
    for i in range(slices):
        ordered.read(len(ordered) * i // slices, len(ordered) * (i + 1) // slices).drop("position").repartition(SLICE_FILES).write.mode("append").parquet(f"{base}/events")
    return _as_ticks(files.stream_table(spark, f"{base}/events", events.schema, files_per_trigger=SLICE_FILES))


def session_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Features at the newest tick of each series within its session; four triggers, state as lists with timers."""
    with processor.rocksdb_state(spark):
        out = _finished(spark, processor.session_features(_in_slices(spark, d).drop("time"), SESSION))
    last = sinks.newest(out.drop("matrix"), keys=["series"], order=["ts_us"])
    return last.select("series", "ts_us", "buffered", *[F.round(F.get("last", F.lit(i)), 5).alias(c) for i, c in enumerate(buffers.FEATURES)])


def _moves(x: np.ndarray) -> np.ndarray:
    """Distributions over down, level and up for two horizons, from the newest return alone."""
    weights = np.exp(x[:, -1, 0][:, None, None] * np.arange(1, 3)[None, :, None] * np.arange(-1, 2)[None, None, :])
    return weights / weights.sum(-1, keepdims=True)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Records of a scorer at the newest tick of each series, written batch by batch."""
    path = f"{files.shared_dir(spark)}/predictions-{uuid.uuid4().hex}"
    kind = "series string, ts_us long, distributions array<array<double>>"
    score = lambda batch: buffers.score_with(batch.where("matrix IS NOT NULL"), _moves, 2, 3)
    with processor.rocksdb_state(spark):
        features = processor.session_features(_in_slices(spark, d).drop("time"), SESSION)
        sinks.write_batches(features, f"{path}/out", "moves", change=score).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    last = sinks.newest(sinks.read_batches(spark, f"{path}/out", kind).drop("query", "batch"), keys=["series"], order=["ts_us"])
    shares = [F.round(F.get(F.get("distributions", F.lit(h)), F.lit(k)), 4).alias(f"p{h}_{name}") for h in range(2) for k, name in ((0, "down"), (2, "up"))]
    return last.select("series", "ts_us", *shares)


def bars(spark: SparkSession, d: str) -> DataFrame:
    rows = _ticks(spark, d).select(F.col("series").alias("ticker"), "time", "price", F.col("volume").alias("size"))
    out = _finished(spark, buffers.bars(rows))
    return out.select("ticker", F.unix_micros("bar_start").alias("bar_us"), F.round("avg_price", 6).alias("avg_price"), "volume", "n")


_RV = ", ".join(f"CASE WHEN count(CASE WHEN k <= {w} THEN r END) = {w} THEN round(stddev_pop(CASE WHEN k <= {w} THEN r END) * {rolling.annualization()} * 100, 5) ELSE 0 END AS rv_{w}s" for w in buffers.RV_WINDOWS)
_LAST = f"""WITH {schema.TRADES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY time DESC, sequence_number DESC) AS k FROM trades),
b AS (SELECT ticker AS series, max(CASE WHEN k = 1 THEN epoch_us(time) END) AS ts_us, least(count(*), 301)::INT AS buffered, {", ".join(f"max(CASE WHEN k = {w + 1} THEN price END) AS p{w}" for w in (0, *buffers.RETURN_WINDOWS))},
  sum(CASE WHEN k <= 60 THEN price * size END) / greatest(sum(CASE WHEN k <= 60 THEN size END), 1e-10) AS vwap FROM r GROUP BY ticker),
held AS (SELECT ticker, k, ln(price / lead(price) OVER (PARTITION BY ticker ORDER BY k)) AS r FROM r WHERE k <= 301),
v AS (SELECT ticker AS series, {_RV} FROM held GROUP BY ticker)
SELECT b.series, ts_us, buffered, {", ".join(f"coalesce(round(ln(p0 / p{w}), 5), 0) AS log_return_{w}s" for w in buffers.RETURN_WINDOWS)}, coalesce(round(ln(p0 / vwap), 5), 0) AS vwap_deviation, {", ".join(f"coalesce(rv_{w}s, 0) AS rv_{w}s" for w in buffers.RV_WINDOWS)} FROM b JOIN v ON b.series = v.series WHERE buffered >= 60"""
_CLOSE, _DAY = SESSION.close_us, processor.DAY_US
_SESSIONS = f"""{schema.TRADES_SQL}, placed AS (SELECT *, (epoch_us(time) - {_CLOSE} + {_DAY}) // {_DAY} AS session FROM trades),
r AS (SELECT ticker, time, price, size, row_number() OVER (PARTITION BY ticker ORDER BY time DESC, sequence_number DESC) AS k FROM (SELECT *, max(session) OVER (PARTITION BY ticker) AS newest FROM placed) WHERE session = newest)"""
_session_return = lambda w: f"CASE WHEN buffered >= {SESSION.buffer.sequence_length} THEN coalesce(round(ln(p0 / p{w}), 5), 0) END AS log_return_{w}s"
_session_rv = lambda w: f"CASE WHEN buffered >= {SESSION.buffer.sequence_length} THEN CASE WHEN n{w} = {w} THEN round(s{w} * {rolling.annualization()} * 100, 5) ELSE 0 END END AS rv_{w}s"
_SESSION_LAST = f"""WITH {_SESSIONS},
b AS (SELECT ticker AS series, max(epoch_us(time)) AS ts_us, least(count(*), 301)::INT AS buffered, {", ".join(f"max(CASE WHEN k = {w + 1} THEN price END) AS p{w}" for w in (0, *buffers.RETURN_WINDOWS))},
  CASE WHEN count(CASE WHEN k <= 60 THEN price * size END) = 60 THEN sum(CASE WHEN k <= 60 THEN price * size END) / greatest(sum(CASE WHEN k <= 60 THEN size END), 1e-10) END AS vwap FROM r GROUP BY ticker),
steps AS (SELECT ticker, k, ln(price / lead(price) OVER (PARTITION BY ticker ORDER BY k)) AS r FROM r WHERE k <= 301),
v AS (SELECT ticker AS series, {", ".join(f"count(CASE WHEN k <= {w} THEN r END) AS n{w}, stddev_pop(CASE WHEN k <= {w} THEN r END) AS s{w}" for w in buffers.RV_WINDOWS)} FROM steps GROUP BY ticker)
SELECT b.series, ts_us, buffered, {", ".join(map(_session_return, buffers.RETURN_WINDOWS))}, CASE WHEN buffered >= {SESSION.buffer.sequence_length} THEN coalesce(round(ln(p0 / vwap), 5), 0) END AS vwap_deviation, {", ".join(map(_session_rv, buffers.RV_WINDOWS))} FROM b JOIN v ON b.series = v.series"""
# a record is the newest of those slices at whose end a session held enough ticks
_SLICED = f"""WITH {schema.TRADES_SQL}, numbered AS (SELECT *, row_number() OVER (ORDER BY time, sequence_number) - 1 AS i, count(*) OVER () AS n FROM trades),
sliced AS (SELECT *, CASE WHEN i < n // 4 THEN 0 WHEN i < n * 2 // 4 THEN 1 WHEN i < n * 3 // 4 THEN 2 ELSE 3 END AS slice FROM numbered),
ends AS (SELECT *, lag(price) OVER w AS before, row_number() OVER (PARTITION BY ticker, (epoch_us(time) - {_CLOSE} + {_DAY}) // {_DAY} ORDER BY time, sequence_number) AS held,
  row_number() OVER (PARTITION BY ticker, slice ORDER BY time DESC, sequence_number DESC) AS k FROM sliced WINDOW w AS (PARTITION BY ticker ORDER BY time, sequence_number)),
best AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY slice DESC) AS q FROM ends WHERE k = 1 AND held >= {SESSION.buffer.sequence_length}),
x AS (SELECT ticker AS series, epoch_us(time) AS ts_us, coalesce(ln(price / before), 0) AS r FROM best WHERE q = 1)
SELECT series, ts_us, {", ".join(f"round(exp({s}r * {h + 1}) / (exp(-r * {h + 1}) + 1 + exp(r * {h + 1})), 4) AS p{h}_{name}" for h in range(2) for s, name in (("-", "down"), ("", "up")))} FROM x"""
# bars are out once the watermark, two hours behind the newest tick, has passed their end
_BARS = f"""WITH {schema.TRADES_SQL}, b AS (SELECT ticker, epoch_us(time) // 3600000000 * 3600000000 AS bar_us, round(avg(price), 6) AS avg_price, sum(size)::DOUBLE AS volume, count(*) AS n FROM trades GROUP BY 1, 2)
SELECT * FROM b WHERE bar_us + 3600000000 <= (SELECT max(epoch_us(time)) FROM trades) - 7200000000"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "st4_online_features": (online, _LAST),
    "st5_session_buffers": (session_buffers, _SESSION_LAST),
    "st6_prediction_sink": (predictions, _SLICED),
    "st8_streaming_bars": (bars, _BARS),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
