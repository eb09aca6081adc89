"""Queries of the operators that carry state along a series or select by rank, with DuckDB SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schema
from strandline.operators import align, cross, order_statistics, sampler, scan
from strandline.sources import files

KEYS, ORDER = ["ticker"], ["time", "sequence_number"]
LAGS_US = tuple(s * 1_000_000 for s in (-3600, -1200, -300, 0, 300, 1200, 3600))
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
QUARTILES = (0.25, 0.5, 0.75)
SHARES = (0.01, 0.5, 0.95, 0.999)
DECAYS = {"vwap_exp_3min": 180.0, "vwap_exp_10min": 600.0}
BARS_PER_YEAR = 252 * 6.5
SAMPLER_RANGES = 16


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return files.staged(cross.tick_steps(schema.trades(spark, d), key="ticker", time="time", order=["sequence_number"], price="price"), "steps")


def _pairs(steps: DataFrame) -> DataFrame:
    """Each two symbols once; a symbol is a row here."""
    symbols = steps.select("key").distinct()
    return symbols.select(F.col("key").alias("a")).join(symbols.select(F.col("key").alias("b")), F.col("a") < F.col("b"))


def lead_lag(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    out = cross.lead_lag(steps, _pairs(steps), LAGS_US)
    return out.select("a", "b", "lag_us", "n_overlaps", F.round("covariance", 5).alias("covariance"), F.round("correlation", 6).alias("correlation"))


def best_lag(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    out = cross.best_lag(cross.lead_lag(steps, _pairs(steps), LAGS_US))
    return out.select("a", "b", "lag_us", F.round("correlation", 6).alias("correlation"), F.round("lead_ratio", 4).alias("lead_ratio"))


def daily_comovement(spark: SparkSession, d: str) -> DataFrame:
    steps = _steps(spark, d)
    out = cross.lead_lag(steps, _pairs(steps), [0], window_us=DAY_US)
    return out.select("a", "b", F.col("window").alias("day"), "n_overlaps", F.round("correlation", 6).alias("correlation"))


def index_comovement(spark: SparkSession, d: str) -> DataFrame:
    """How each symbol moves with an index of all symbols, and with one of the symbols of its own initial's half."""
    steps = _steps(spark, d)
    halves = steps.select("key").distinct().withColumn("index", F.when(F.col("key") < "p", "a to o").otherwise("p to z"))
    groups = halves.unionByName(halves.withColumn("index", F.lit("all")))
    indexes = cross.tick_steps(files.staged(cross.index_ticks(steps, groups=groups), "index"), key="key", time="time", order=["order"], price="price")
    every = files.staged(steps.unionByName(indexes.select(*steps.columns)), "steps")
    out = cross.lead_lag(every, groups.select(F.col("key").alias("a"), F.col("index").alias("b")), [0])
    return out.select("a", F.col("b").alias("index_name"), "n_overlaps", F.round("correlation", 5).alias("correlation"))


def long_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all ticks as one series, over the last 600 and 3,600 of them."""
    rows = schema.trades(spark, d).select("id", "time", "sequence_number", "size")
    for n in (600, 3600):
        rows = order_statistics.long_quantiles(rows, keys=[], order=ORDER, value="size", n=n, quantiles=QUARTILES, name=f"q{n}", chunk=20_000)
    return rows.select("id", *[F.get(f"q{n}", F.lit(i)).alias(f"size_q{int(q * 100)}_{n}") for n in (600, 3600) for i, q in enumerate(QUARTILES)])


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of groups that no task may sort more than a thousand values of."""
    lines = schema.table(spark, d, "lineitem")
    out = order_statistics.exact_percentiles(lines, keys=["l_returnflag", "l_linestatus"], value="l_extendedprice", probabilities=SHARES, few=1000)
    return out.select("l_returnflag", "l_linestatus", "n", *[F.round(F.get("percentiles", F.lit(i)), 4).alias(f"p{i}") for i in range(len(SHARES))])


def lag_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Lags by symbol; the percentiles are selected, as no task should hold a symbol's values."""
    trades = schema.trades(spark, d).where("size IS NOT NULL").select("ticker", "size")
    sums = trades.groupBy("ticker").agg(F.round(F.avg("size"), 6).alias("avg_lag"), F.min("size").alias("min_lag"), F.max("size").alias("max_lag"))
    exact = order_statistics.exact_percentiles(trades, keys=["ticker"], value="size", probabilities=[0.5, 0.95])
    return sums.join(exact, "ticker").select("ticker", "avg_lag", "min_lag", "max_lag", *[F.round(F.get("percentiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("median_lag", "p95_lag"))])


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Shares of values that are there, days, and selected price percentiles, by symbol."""
    trades = schema.trades(spark, d)
    share = lambda c: F.round(F.count(c).cast("double") / F.count(F.lit(1)), 6)
    sums = trades.groupBy("ticker").agg(share("price").alias("price_share"), share("size").alias("size_share"), F.count_distinct(F.to_date("time")).alias("days"))
    exact = order_statistics.exact_percentiles(trades, keys=["ticker"], value="price", probabilities=[0.5, 0.95, 0.99])
    return sums.join(exact, "ticker").select("ticker", "price_share", "size_share", *[F.round(F.get("percentiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("median_price", "p95_price", "p99_price"))], "days")


def gap_profile(spark: SparkSession, d: str) -> DataFrame:
    """Times between the ticks of each symbol; long series are cut."""
    rows = align.with_gaps(schema.trades(spark, d).select("ticker", "time", "sequence_number"), keys=KEYS, order=ORDER, gap_seconds=3600.0, passed="gap_us")
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gap_us"), 3).alias("avg_gap_us"), F.max("gap_us").alias("max_gap_us"), F.count_if("gap").alias("long_gaps"))


def exponential_vwap(spark: SparkSession, d: str) -> DataFrame:
    out = scan.exponential_vwap(schema.trades(spark, d), keys=KEYS, order=ORDER, seconds=DECAYS)
    return out.select("id", *[F.round(c, 6).alias(c) for c in DECAYS])


def exponential_vwap_chunked(spark: SparkSession, d: str) -> DataFrame:
    """The same with series cut into chunks of 97 rows, each started from its carry."""
    out = scan.exponential_vwap(schema.trades(spark, d), keys=KEYS, order=ORDER, seconds=DECAYS, chunk=97)
    return out.select("id", *[F.round(c, 6).alias(c) for c in DECAYS])


def cumulative_volatility(spark: SparkSession, d: str) -> DataFrame:
    out = scan.cumulative_volatility(schema.trades(spark, d), keys=KEYS, order=ORDER, bar_us=HOUR_US, bars_per_year=BARS_PER_YEAR)
    return out.select("ticker", F.unix_micros("bar").alias("bar_us"), "n", F.round("volatility", 6).alias("volatility"))


def temporal_sampler(spark: SparkSession, d: str) -> DataFrame:
    """All events in order of time in batches of 100, resumed after the first third."""
    events = schema.table(spark, d, "events").select("event_id", "ts")
    out = sampler.TemporalSampler.write(events, f"{files.shared_dir(spark)}/sampler-{uuid.uuid4().hex}", ["ts", "event_id"], SAMPLER_RANGES)
    return out.batches(100, start=len(out) // 3).select("event_id", "position", "batch")


_T = f"WITH {schema.TRADES_SQL}"
_STEPS = f"""{_T}, single AS (SELECT ticker, epoch_us(time) AS e, arg_max(ln(price), sequence_number) AS x FROM trades WHERE price > 0 GROUP BY ticker, epoch_us(time)),
steps AS (SELECT * FROM (SELECT ticker, lag(e) OVER w AS s, e, x - lag(x) OVER w AS r FROM single WINDOW w AS (PARTITION BY ticker ORDER BY e)) WHERE r IS NOT NULL),
lags AS (SELECT unnest([{", ".join(map(str, LAGS_US))}])::BIGINT AS lag_us),
names AS (SELECT DISTINCT ticker FROM single),
pairs AS (SELECT x.ticker AS a, y.ticker AS b FROM names x JOIN names y ON x.ticker < y.ticker)"""
# intervals overlap where each starts before the other ends
_LAGGED = f"""{_STEPS}, c AS (
  SELECT p.a, p.b, l.lag_us, count(y.r) AS n_overlaps, coalesce(sum(x.r * y.r), 0) AS cov
  FROM pairs p CROSS JOIN lags l JOIN steps x ON x.ticker = p.a LEFT JOIN steps y ON y.ticker = p.b AND x.s < y.e + l.lag_us AND y.s + l.lag_us < x.e GROUP BY ALL),
v AS (SELECT ticker, sum(r * r) AS r2 FROM steps GROUP BY ticker),
lagged AS (SELECT c.*, cov / sqrt(va.r2 * vb.r2) AS corr FROM c JOIN v va ON va.ticker = c.a JOIN v vb ON vb.ticker = c.b)"""
_DAILY = f"""{_STEPS}, c AS (
  SELECT p.a, p.b, x.e // {DAY_US} AS day, count(y.r) AS n_overlaps, sum(x.r * y.r) AS cov
  FROM pairs p JOIN steps x ON x.ticker = p.a LEFT JOIN steps y ON y.ticker = p.b AND x.s < y.e AND y.s < x.e GROUP BY ALL),
v AS (SELECT ticker, e // {DAY_US} AS day, sum(r * r) AS r2 FROM steps GROUP BY ALL)
SELECT a, b, c.day AS day, n_overlaps, CASE WHEN va.r2 > 0 AND vb.r2 > 0 THEN round(coalesce(cov, 0) / sqrt(va.r2 * vb.r2), 6) END AS correlation FROM c JOIN v va ON va.ticker = a AND va.day = c.day LEFT JOIN v vb ON vb.ticker = b AND vb.day = c.day"""
_INDEX = f"""{_T}, single AS (SELECT ticker, epoch_us(time) AS e, arg_max(ln(price), sequence_number) AS x FROM trades WHERE price > 0 GROUP BY ticker, epoch_us(time)),
every AS (SELECT ticker, lag(e) OVER w AS s, e, x - lag(x) OVER w AS r FROM single WINDOW w AS (PARTITION BY ticker ORDER BY e)),
member AS (SELECT DISTINCT ticker, CASE WHEN ticker < 'p' THEN 'a to o' ELSE 'p to z' END AS name FROM single UNION ALL SELECT DISTINCT ticker, 'all' FROM single),
size AS (SELECT name, count(*) AS m FROM member GROUP BY name),
moves AS (SELECT name, e, sum(coalesce(r, 0)) / any_value(m) AS r FROM every JOIN member USING (ticker) JOIN size USING (name) GROUP BY name, e),
idx AS (SELECT * FROM (SELECT name, lag(e) OVER (PARTITION BY name ORDER BY e) AS s, e, r FROM moves) WHERE s IS NOT NULL),
c AS (SELECT a.ticker, i.name, count(*) AS n, sum(a.r * i.r) AS cov FROM every a JOIN member g USING (ticker) JOIN idx i ON i.name = g.name AND a.s < i.e AND i.s < a.e WHERE a.r IS NOT NULL GROUP BY ALL)
SELECT c.ticker AS a, c.name AS index_name, n AS n_overlaps, round(cov / sqrt(va.r2 * vi.r2), 5) AS correlation
FROM c JOIN (SELECT ticker, sum(r * r) AS r2 FROM every GROUP BY ticker) va ON va.ticker = c.ticker JOIN (SELECT name, sum(r * r) AS r2 FROM idx GROUP BY name) vi ON vi.name = c.name"""
_QUANTILES = ", ".join(f"CASE WHEN i >= {n} THEN quantile_cont(size::DOUBLE, {q}) OVER w{n} END AS size_q{int(q * 100)}_{n}" for n in (600, 3600) for q in QUARTILES)
_VWAP = f"""{_T.replace("WITH ", "WITH RECURSIVE ")}, rows_ AS (SELECT ticker, id, price, size, row_number() OVER w AS i, (epoch_us(time) - epoch_us(lag(time) OVER w)) / 1e6::DOUBLE AS passed FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY time, sequence_number)),
b AS (SELECT ticker, id, i, passed, coalesce(price * size, 0)::DOUBLE AS pv, CASE WHEN price IS NOT NULL THEN coalesce(size, 0) ELSE 0 END::DOUBLE AS v FROM rows_),
y AS (SELECT ticker, id, i, pv AS n3, v AS d3, pv AS n10, v AS d10 FROM b WHERE i = 1
  UNION ALL SELECT b.ticker, b.id, b.i, n3 * exp(-passed / 180) + pv, d3 * exp(-passed / 180) + v, n10 * exp(-passed / 600) + pv, d10 * exp(-passed / 600) + v FROM y JOIN b ON b.ticker = y.ticker AND b.i = y.i + 1)
SELECT id, CASE WHEN d3 > 0 THEN round(n3 / d3, 6) END AS vwap_exp_3min, CASE WHEN d10 > 0 THEN round(n10 / d10, 6) END AS vwap_exp_10min FROM y"""
_VOLATILITY = f"""{_T}, bars AS (SELECT ticker, epoch_us(time) // {HOUR_US} * {HOUR_US} AS bar_us, arg_min(price, (epoch_us(time), sequence_number)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (epoch_us(time), sequence_number)) AS c FROM trades WHERE price > 0 GROUP BY 1, 2),
v AS (SELECT ticker, bar_us, coalesce(power(ln(o / lag(c) OVER (PARTITION BY ticker ORDER BY bar_us)), 2), 0) + 0.5::DOUBLE * power(ln(h / l), 2) - {2 * math.log(2) - 1}::DOUBLE * power(ln(c / o), 2) AS v FROM bars)
SELECT ticker, bar_us, row_number() OVER w AS n, round(sqrt(greatest(sum(v) OVER w, 0) / row_number() OVER w * {BARS_PER_YEAR}), 6) AS volatility FROM v WINDOW w AS (PARTITION BY ticker ORDER BY bar_us)"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "q12_lag_distribution": (lag_distribution, f"{_T} SELECT ticker, round(avg(size), 6) AS avg_lag, min(size) AS min_lag, max(size) AS max_lag, round(quantile_cont(size, 0.5), 6) AS median_lag, round(quantile_cont(size, 0.95), 6) AS p95_lag FROM trades WHERE size IS NOT NULL GROUP BY ticker"),
    "q32_completeness": (completeness, f"{_T} SELECT ticker, round(count(price)::DOUBLE / count(*), 6) AS price_share, round(count(size)::DOUBLE / count(*), 6) AS size_share, round(quantile_cont(price, 0.5), 6) AS median_price, round(quantile_cont(price, 0.95), 6) AS p95_price, round(quantile_cont(price, 0.99), 6) AS p99_price, count(DISTINCT time::DATE) AS days FROM trades GROUP BY ticker"),
    "q29_gap_profile": (gap_profile, f"""{_T}, gaps AS (SELECT ticker, epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY ticker ORDER BY time, sequence_number) AS gap_us FROM trades)
SELECT ticker, count(*) AS n, round(avg(gap_us), 3) AS avg_gap_us, max(gap_us) AS max_gap_us, count(CASE WHEN gap_us > 3600000000 THEN 1 END) AS long_gaps FROM gaps GROUP BY ticker"""),
    "a03_exact_percentiles": (percentiles, "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {p}), 4) AS p{i}" for i, p in enumerate(SHARES)) + " FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "w14_long_quantiles": (long_quantiles, f"{_T}, r AS (SELECT *, row_number() OVER (ORDER BY time, sequence_number) AS i FROM trades) SELECT id, {_QUANTILES} FROM r WINDOW w600 AS (ORDER BY i ROWS 599 PRECEDING), w3600 AS (ORDER BY i ROWS 3599 PRECEDING)"),
    "w20_exponential_vwap": (exponential_vwap, _VWAP),
    "w20_exponential_vwap_chunked": (exponential_vwap_chunked, _VWAP),
    "w21_cumulative_volatility": (cumulative_volatility, _VOLATILITY),
    "w23_lead_lag": (lead_lag, f"{_LAGGED} SELECT a, b, lag_us, n_overlaps, round(cov, 5) AS covariance, round(corr, 6) AS correlation FROM lagged"),
    "w24_best_lag": (best_lag, f"""{_LAGGED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(corr) DESC, abs(lag_us), lag_us) AS k FROM lagged)
SELECT a, b, max(CASE WHEN k = 1 THEN lag_us END) AS lag_us, round(max(CASE WHEN k = 1 THEN corr END), 6) AS correlation, round(sum(CASE WHEN lag_us > 0 THEN corr * corr END) / sum(CASE WHEN lag_us < 0 THEN corr * corr END), 4) AS lead_ratio FROM ranked GROUP BY a, b"""),
    "w25_daily_comovement": (daily_comovement, _DAILY),
    "w26_index_comovement": (index_comovement, _INDEX),
    "t06_temporal_sampler": (temporal_sampler, "WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position, count(*) OVER () // 3 AS start FROM events) SELECT event_id, position, (position - start) // 100 AS batch FROM p WHERE position >= start"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
