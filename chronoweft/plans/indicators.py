"""Registered queries over technical features."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import features as ft
from chronoweft.operators.positions import number_rows
from chronoweft.operators.recurrence import exponential_average
from chronoweft.plans.common import (
    CHUNK, hourly, numbered, query, r, sql_candles, table, tidy,
)
from chronoweft.settings import RETURN_PERIODS, IndicatorSpec
from chronoweft.sources.adapters import candles_from_ticks

W = "PARTITION BY symbol ORDER BY pos"


def full(rows: int, expr: str) -> str:
    return f"CASE WHEN pos >= {rows - 1} THEN {expr} END"


@query("lagged_returns", f"""
WITH {sql_candles()}
SELECT symbol, pos, {', '.join(f"{r(f'c / lag(c, {n}) OVER ({W}) - 1')} AS return_{n}" for n in RETURN_PERIODS)}
FROM candles""")
def lagged_returns(spark, sf):
    """Row-shifted returns, never filled."""
    out = ft.lagged_returns(numbered(spark, sf), ["symbol"], RETURN_PERIODS, chunk_rows=CHUNK)
    return tidy(out.select("symbol", "pos", *[f"return_{n}" for n in RETURN_PERIODS]))


@query("volume_features", f"""
WITH {sql_candles()}
SELECT symbol, pos, {r(f'v / lag(v, 1) OVER ({W}) - 1')} AS volume_change,
  {r(full(20, f'v / avg(v) OVER ({W} ROWS 19 PRECEDING) - 1'))} AS volume_ma_ratio
FROM candles""")
def volume_features(spark, sf):
    """Volume change and ratio to its full 20-bar mean."""
    out = ft.volume_features(numbered(spark, sf), ["symbol"], chunk_rows=CHUNK)
    return tidy(out.select("symbol", "pos", "volume_change", "volume_ma_ratio"))


@query("bollinger_bands", f"""
WITH {sql_candles()},
x AS (SELECT symbol, pos, c, avg(c) OVER w AS m, stddev_pop(c) OVER w AS s FROM candles
      WINDOW w AS ({W} ROWS 19 PRECEDING))
SELECT symbol, pos, {r(full(20, '4 * s / m'))} AS bb_width,
       {r(full(20, '(c - (m - 2 * s)) / (4 * s)'))} AS bb_pct FROM x""")
def bollinger_bands(spark, sf):
    """Band width and relative position, population deviation."""
    out = ft.bollinger_features(numbered(spark, sf), ["symbol"], chunk_rows=CHUNK)
    return tidy(out.select("symbol", "pos", "bb_width", "bb_pct"))


@query("candle_ratios", f"""
WITH {sql_candles()}
SELECT symbol, t AS timestamp, {r('(h - l) / c')} AS candle_range_pct, {r('c / o - 1')} AS body_return
FROM bars""")
def candle_ratios(spark, sf):
    """Range and body of each candle."""
    out = ft.candle_ratios(hourly(spark, sf))
    return tidy(out.select("symbol", "timestamp", "candle_range_pct", "body_return"))


@query("exponential_average", """
WITH RECURSIVE days AS (
  SELECT l_returnflag AS symbol, epoch_us(l_shipdate) // 86400000000 AS d,
         sum(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS pos FROM days),
e AS (
  SELECT symbol, pos, x AS y FROM s WHERE pos = 0
  UNION ALL
  SELECT s.symbol, s.pos, s.x * 2.0 / 21 + e.y * 19.0 / 21 FROM e JOIN s
    ON s.symbol = e.symbol AND s.pos = e.pos + 1)
SELECT symbol, pos, CASE WHEN pos >= 19 THEN round(y, 2) + 0.0 END AS ema FROM e""")
def exponential_average_query(spark, sf):
    """Recursive average of daily shipped revenue per return flag."""
    daily = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("symbol"),
        F.date_trunc("day", "l_shipdate").alias("timestamp"),
    ).agg(F.sum("l_extendedprice").alias("x"))
    rows = number_rows(daily, ["symbol"], block_seconds=365 * 86_400)
    out = exponential_average(rows, ["symbol"], "x", 20, chunk_rows=512)
    return tidy(out.select("symbol", "pos", "ema"), 2)


FEATURES_CTE = f"""
flow AS (
  SELECT *, greatest(coalesce(c - lag(c) OVER w, 0), 0) AS up,
         greatest(coalesce(lag(c) OVER w - c, 0), 0) AS dn,
         greatest(h - l, coalesce(abs(h - lag(c) OVER w), 0), coalesce(abs(l - lag(c) OVER w), 0)) AS tr
  FROM candles WINDOW w AS ({W})),
base AS (SELECT *, avg(tr) OVER ({W} ROWS 13 PRECEDING) AS tr14 FROM flow),
rec AS (
  SELECT symbol, pos, c AS e9, c AS e21, c AS e12, c AS e26, 0.0::DOUBLE AS sig, up AS g, dn AS d,
         0.0::DOUBLE AS atr
  FROM base WHERE pos = 0
  UNION ALL
  SELECT b.symbol, b.pos, b.c * 0.2 + p.e9 * 0.8, b.c / 11.0 + p.e21 * 10.0 / 11.0,
    b.c * 2 / 13.0 + p.e12 * 11.0 / 13.0, b.c * 2 / 27.0 + p.e26 * 25.0 / 27.0,
    CASE WHEN b.pos < 25 THEN 0.0
         WHEN b.pos = 25 THEN (b.c * 2 / 13.0 + p.e12 * 11.0 / 13.0) - (b.c * 2 / 27.0 + p.e26 * 25.0 / 27.0)
         ELSE 0.2 * ((b.c * 2 / 13.0 + p.e12 * 11.0 / 13.0) - (b.c * 2 / 27.0 + p.e26 * 25.0 / 27.0))
              + 0.8 * p.sig END,
    b.up / 14.0 + p.g * 13.0 / 14.0, b.dn / 14.0 + p.d * 13.0 / 14.0,
    CASE WHEN b.pos < 13 THEN 0.0 WHEN b.pos = 13 THEN b.tr14 ELSE (p.atr * 13 + b.tr) / 14.0 END
  FROM rec p JOIN base b ON b.symbol = p.symbol AND b.pos = p.pos + 1),
osc AS (SELECT *, CASE WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / d) END AS rsi FROM rec),
osc2 AS (SELECT *, min(CASE WHEN pos >= 13 THEN rsi END) OVER w AS lo,
                max(CASE WHEN pos >= 13 THEN rsi END) OVER w AS hi FROM osc
         WINDOW w AS ({W} ROWS 13 PRECEDING)),
roll AS (
  SELECT *, avg(c) OVER w AS m, stddev_pop(c) OVER w AS s, avg(v) OVER w AS vm,
         lag(v) OVER ({W}) AS v1, {', '.join(f'lag(c, {n}) OVER ({W}) AS c{n}' for n in RETURN_PERIODS)}
  FROM base WINDOW w AS ({W} ROWS 19 PRECEDING)),
features AS (
  SELECT k.*, e9 AS ema_short, e21 AS ema_long, e9 / e21 - 1 AS ema_ratio,
    c / e9 - 1 AS close_to_ema_short, c / e21 - 1 AS close_to_ema_long, e12 - e26 AS macd,
    sig AS macd_signal, e12 - e26 - sig AS macd_diff, rsi, (rsi - lo) / (hi - lo) AS stoch_rsi,
    4 * s / m AS bb_width, (c - (m - 2 * s)) / (4 * s) AS bb_pct, atr, atr / c AS atr_pct,
    (h - l) / c AS candle_range_pct, c / o - 1 AS body_return, v / v1 - 1 AS volume_change,
    v / vm - 1 AS volume_ma_ratio,
    {', '.join(f'c / c{n} - 1 AS return_{n}' for n in RETURN_PERIODS)}
  FROM roll k JOIN osc2 USING (symbol, pos) WHERE k.pos >= 33)"""

COLUMNS = IndicatorSpec().feature_columns


@query("technical_features", f"""
WITH RECURSIVE {sql_candles()}, {FEATURES_CTE}
SELECT symbol, pos, t AS timestamp, {', '.join(f'{r(c)} AS {c}' for c in COLUMNS)} FROM features""")
def technical_features(spark, sf):
    """The 24-column feature set of every series, warm-up removed."""
    out = ft.technical_features(hourly(spark, sf), ["symbol"], chunk_rows=CHUNK)
    return tidy(out.select("symbol", "pos", "timestamp", *COLUMNS))


@query("feature_completeness", f"""
WITH {sql_candles()},
x AS (SELECT symbol, pos, t, CASE WHEN v <> 1 THEN 1 END AS f FROM candles),
f AS (SELECT symbol, min(pos) FILTER (WHERE f IS NOT NULL) AS first FROM x GROUP BY 1)
SELECT symbol, 'incomplete_after_warmup' AS "check", t AS timestamp FROM x JOIN f USING (symbol)
WHERE x.f IS NULL AND pos > first
UNION ALL SELECT symbol, 'insufficient_history', NULL FROM f WHERE first IS NULL""")
def feature_completeness(spark, sf):
    """Rows that lose a feature after the warm-up (here: a ratio undefined on single-tick bars)."""
    rows = numbered(spark, sf).withColumn("f", F.when(F.col("volume") != 1.0, 1.0))
    return tidy(ft.incomplete_after_warmup(rows, ["symbol"], ["f"]))


@query("daily_order_features", None)
def daily_order_features(spark, sf):
    """Feature set of daily order candles per status: longer series, no SQL twin."""
    bars = candles_from_ticks(table(spark, sf, "orders"), ts="o_orderdate", price="o_totalprice",
                              timeframe="1d", symbol="o_orderstatus", order="o_orderkey")
    return tidy(ft.technical_features(bars, ["symbol"], chunk_rows=1024))
