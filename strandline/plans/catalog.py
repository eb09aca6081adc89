"""The exploration and data-quality queries, as Spark SQL over the views ``trades`` and ``options``.

Each entry is one SQL text. The DuckDB text of the same query differs by function names only, see ``_DUCKDB``, but for
the band joins, see ``_PLAIN``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from strandline import schema

# Spark function and its DuckDB name.
_DUCKDB = (("unix_micros(", "epoch_us("), ("percentile(", "quantile_cont("), ("from_utc_timestamp(time, 'America/New_York')", "timezone('America/New_York', timezone('UTC', time))"))

# band joins meet by cells of the band's width: one side lies in its own, the other in that and both beside it
_CELL = "CAST(FLOOR(unix_micros(time) / 60000000) AS BIGINT)"
_NEAR = "SELECT *, 0 AS beside FROM {0} UNION ALL SELECT *, -1 AS beside FROM {0} UNION ALL SELECT *, 1 AS beside FROM {0}"
_BANDED = f"""
WITH o AS (SELECT *, {_CELL} AS cell FROM trades WHERE ticker = 'click'), t AS (SELECT *, {_CELL} AS cell FROM trades WHERE ticker = 'view')
SELECT o.id AS option_id, t.id AS trade_id, o.size % 5 AS symbol, ABS(unix_micros(o.time) - unix_micros(t.time)) AS gap_us
FROM o JOIN ({_NEAR.format("t")}) t ON o.size % 5 = t.size % 5 AND o.cell = t.cell + t.beside AND ABS(unix_micros(o.time) - unix_micros(t.time)) < 60000000"""

QUERIES: dict[str, str] = {
    "q04_underlyings": "SELECT DISTINCT underlying_ticker FROM options ORDER BY underlying_ticker LIMIT 100",
    "q05_tickers": "SELECT DISTINCT ticker FROM trades ORDER BY ticker LIMIT 100",
    "q06_symbol_overlap": "SELECT DISTINCT exchange FROM trades a WHERE ticker = 'click' AND EXISTS (SELECT 1 FROM trades b WHERE b.ticker = 'purchase' AND b.exchange = a.exchange) ORDER BY exchange LIMIT 100",
    "q07_options_time_range": "SELECT unix_micros(MIN(time)) AS min_us, unix_micros(MAX(time)) AS max_us, COUNT(*) AS n FROM options WHERE underlying_ticker = 'STANDARD' OR underlying_ticker LIKE '%A%'",
    "q08_trades_time_range": "SELECT ticker, unix_micros(MIN(time)) AS min_us, unix_micros(MAX(time)) AS max_us, COUNT(*) AS n FROM trades GROUP BY ticker",
    "q09_daily_availability": "SELECT CAST(CAST(time AS DATE) AS STRING) AS day, COUNT(*) AS n, COUNT(DISTINCT ticker) AS tickers FROM trades WHERE time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY CAST(time AS DATE) ORDER BY day",
    "q10_options_nulls": "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN implied_vol IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_iv, CAST(SUM(CASE WHEN delta IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_delta, CAST(SUM(CASE WHEN underlying_price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_spot FROM options",
    "q11_trades_nulls": "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN price IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_price, CAST(SUM(CASE WHEN size IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_size, CAST(SUM(CASE WHEN exchange IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_exchange FROM trades",
    "q13_value_range": "SELECT ticker, ROUND(AVG(price), 6) AS avg_rv, MIN(price) AS min_rv, MAX(price) AS max_rv, COUNT(*) AS n FROM trades WHERE price IS NOT NULL GROUP BY ticker",
    "q14_iv_range_by_type": "SELECT underlying_ticker, option_type, ROUND(AVG(implied_vol), 6) AS avg_iv, ROUND(MIN(implied_vol), 6) AS min_iv, ROUND(MAX(implied_vol), 6) AS max_iv, COUNT(*) AS n FROM options WHERE implied_vol IS NOT NULL GROUP BY underlying_ticker, option_type",
    "q15_price_history": "SELECT unix_micros(time) AS ts_us, price, size, sequence_number FROM trades WHERE ticker = 'click' AND time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00' ORDER BY time, sequence_number",
    "q16_iv_surface_snapshot": "SELECT option_type, ROUND(strike_price, 6) AS strike, days_to_expiry, ROUND(implied_vol, 6) AS iv, COUNT(*) AS n FROM options WHERE time >= TIMESTAMP '1995-03-01 00:00:00' AND time < TIMESTAMP '1995-04-01 00:00:00' AND implied_vol IS NOT NULL GROUP BY option_type, strike_price, days_to_expiry, implied_vol ORDER BY strike, days_to_expiry",
    "q17_atm_term_structure": """
WITH ranked AS (SELECT CAST(CAST(time AS DATE) AS STRING) AS day, option_type, days_to_expiry, moneyness, implied_vol,
    ROW_NUMBER() OVER (PARTITION BY CAST(time AS DATE), option_type, days_to_expiry ORDER BY ABS(moneyness - 1), implied_vol, moneyness) AS rn FROM options WHERE days_to_expiry > 0)
SELECT day, option_type, days_to_expiry, ROUND(moneyness, 6) AS moneyness, ROUND(implied_vol, 6) AS iv FROM ranked WHERE rn = 1""",
    "q18_put_call_ratio": "SELECT CAST(CAST(time AS DATE) AS STRING) AS day, SUM(CASE WHEN option_type = 'put' THEN option_volume ELSE 0 END) AS put_volume, SUM(CASE WHEN option_type = 'call' THEN option_volume ELSE 0 END) AS call_volume, ROUND(SUM(CASE WHEN option_type = 'put' THEN option_volume ELSE 0 END) / NULLIF(SUM(CASE WHEN option_type = 'call' THEN option_volume ELSE 0 END), 0), 6) AS ratio FROM options GROUP BY CAST(time AS DATE)",
    "q19_greeks_by_bucket": "SELECT m, ROUND(days_to_expiry / 7) * 7 AS week_days, ROUND(AVG(delta), 6) AS avg_delta, ROUND(AVG(gamma), 6) AS avg_gamma, ROUND(AVG(vega), 6) AS avg_vega, SUM(option_volume) AS volume FROM (SELECT FLOOR((FLOOR(moneyness * 1000 + 0.5) + 5) / 10) / 100 AS m, days_to_expiry, delta, gamma, vega, option_volume FROM options) x GROUP BY m, ROUND(days_to_expiry / 7) * 7",
    "q20_band_join": f"{_BANDED} ORDER BY option_id, trade_id LIMIT 1000",
    "q21_iv_rv_spread": f"""
WITH iv AS (SELECT size % 5 AS symbol, unix_micros(time) AS us, {_CELL} AS cell, AVG(price) AS iv FROM trades WHERE ticker = 'click' GROUP BY size % 5, unix_micros(time), {_CELL}),
rv AS (SELECT size % 5 AS symbol, unix_micros(time) AS us, {_CELL} AS cell, price AS rv FROM trades WHERE ticker = 'view')
SELECT iv.symbol, iv.us AS ts_us, ROUND(iv.iv, 6) AS iv, rv.rv, ROUND(iv.iv - rv.rv, 6) AS spread FROM iv JOIN ({_NEAR.format("rv")}) rv ON iv.symbol = rv.symbol AND iv.cell = rv.cell + rv.beside AND ABS(iv.us - rv.us) < 60000000 ORDER BY iv.us, iv.symbol, rv.rv LIMIT 1000""",
    "q22_lookback": "SELECT unix_micros(time) AS ts_us, price, size FROM trades WHERE ticker = 'view' AND time >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 300 MINUTES AND time <= TIMESTAMP '2024-01-10 12:00:00' ORDER BY time",
    "q23_horizon_labels": """
WITH reference_time AS (SELECT unix_micros(MIN(time)) AS t0 FROM trades WHERE ticker = 'click' AND time >= TIMESTAMP '2024-01-10 00:00:00')
SELECT t.id, unix_micros(t.time) - r.t0 AS after_us, t.price FROM trades t, reference_time r WHERE t.ticker = 'view' AND unix_micros(t.time) >= r.t0 AND unix_micros(t.time) <= r.t0 + 36000000000""",
    "q24_regular_hours": "SELECT id, unix_micros(time) AS ts_us, price FROM trades WHERE ticker = 'purchase' AND time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND HOUR(from_utc_timestamp(time, 'America/New_York')) BETWEEN 9 AND 16 AND NOT (HOUR(from_utc_timestamp(time, 'America/New_York')) = 9 AND MINUTE(from_utc_timestamp(time, 'America/New_York')) < 30) AND NOT (HOUR(from_utc_timestamp(time, 'America/New_York')) = 16 AND MINUTE(from_utc_timestamp(time, 'America/New_York')) > 0)",
    "q25_time_bucket": "SELECT ticker, CAST(FLOOR(unix_micros(time) / 3600000000) AS BIGINT) AS bucket, ROUND(AVG(price), 6) AS avg_price, COUNT(*) AS n FROM trades GROUP BY ticker, CAST(FLOOR(unix_micros(time) / 3600000000) AS BIGINT)",
    "q26_recent_history": "SELECT id, unix_micros(time) AS ts_us, price, size FROM trades WHERE ticker = 'click' AND time > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 DAY AND time <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY time DESC",
    "q27_dictionary_snapshot": "SELECT option_type, COUNT(*) AS n, ROUND(AVG(implied_vol), 6) AS avg_iv FROM options WHERE time >= TIMESTAMP '1996-06-01 00:00:00' AND time < TIMESTAMP '1996-06-02 00:00:00' GROUP BY option_type",
    "q28_symbol_coverage": """
SELECT COUNT(DISTINCT CASE WHEN a.exchange IS NOT NULL THEN a.exchange END) AS left_symbols, COUNT(DISTINCT CASE WHEN b.exchange IS NOT NULL THEN b.exchange END) AS right_symbols,
  COUNT(DISTINCT CASE WHEN a.exchange IS NOT NULL AND b.exchange IS NOT NULL THEN a.exchange END) AS in_both
FROM (SELECT DISTINCT exchange FROM trades WHERE ticker = 'click') a FULL OUTER JOIN (SELECT DISTINCT exchange FROM trades WHERE ticker = 'signup') b ON a.exchange = b.exchange""",
    "q30_sanity": "SELECT option_type, COUNT(*) AS n, ROUND(MIN(delta), 6) AS min_delta, ROUND(MAX(delta), 6) AS max_delta, ROUND(MIN(implied_vol), 6) AS min_iv, ROUND(MAX(implied_vol), 6) AS max_iv, CAST(SUM(CASE WHEN option_type = 'call' AND delta < 0 THEN 1 WHEN option_type = 'put' AND delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_sign FROM options GROUP BY option_type",
    "q31_options_filter": "SELECT COUNT(*) AS n, SUM(option_volume) AS volume FROM options WHERE implied_vol IS NOT NULL AND implied_vol > 0 AND implied_vol <= 2.0 AND option_volume > 0 AND underlying_price > 0 AND moneyness BETWEEN 0.95 AND 1.05 AND days_to_expiry >= 7",
    "q31_trades_filter": "SELECT ticker, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS volume FROM trades WHERE price > 0 AND size > 0 AND ticker NOT LIKE '%err%' GROUP BY ticker",
}


#: Band joins by their definition, for the check.
_PLAIN = {
    "q20_band_join": """
SELECT o.id AS option_id, t.id AS trade_id, o.size % 5 AS symbol, ABS(unix_micros(o.time) - unix_micros(t.time)) AS gap_us
FROM (SELECT * FROM trades WHERE ticker = 'click') o JOIN (SELECT * FROM trades WHERE ticker = 'view') t
  ON o.size % 5 = t.size % 5 AND ABS(unix_micros(o.time) - unix_micros(t.time)) < 60000000 ORDER BY option_id, trade_id LIMIT 1000""",
    "q21_iv_rv_spread": """
WITH iv AS (SELECT size % 5 AS symbol, unix_micros(time) AS us, AVG(price) AS iv FROM trades WHERE ticker = 'click' GROUP BY size % 5, unix_micros(time)),
rv AS (SELECT size % 5 AS symbol, unix_micros(time) AS us, price AS rv FROM trades WHERE ticker = 'view')
SELECT iv.symbol, iv.us AS ts_us, ROUND(iv.iv, 6) AS iv, rv.rv, ROUND(iv.iv - rv.rv, 6) AS spread FROM iv JOIN rv ON iv.symbol = rv.symbol AND ABS(iv.us - rv.us) < 60000000 ORDER BY iv.us, iv.symbol, rv.rv LIMIT 1000""",
}


def run(spark: SparkSession, sf_dir: str, sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """The SQL text over the views, where they stand after FROM or JOIN; named parameters as ``:name``.

    The session's own views stay as they are.
    """
    for view, frame in (("trades", schema.trades), ("options", schema.options)):
        name, place = f"{view}_{zlib.crc32(sf_dir.encode()):08x}", rf"\b(FROM|JOIN)(\s+){view}\b"
        if re.search(place, sql, re.IGNORECASE):
            frame(spark, sf_dir).createOrReplaceTempView(name)
            sql = re.sub(place, rf"\g<1>\g<2>{name}", sql, flags=re.IGNORECASE)
    return spark.sql(sql, args=args or {})


def duckdb_sql(sql: str) -> str:
    for ours, theirs in _DUCKDB:
        sql = sql.replace(ours, theirs)
    views = ", ".join(v for v in (schema.TRADES_SQL, schema.OPTIONS_SQL) if v.split()[0] in sql)
    body = sql.strip()
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, sql=sql: run(spark, sf_dir, sql)) for name, sql in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_sql(_PLAIN.get(name, sql)) for name, sql in QUERIES.items()}
