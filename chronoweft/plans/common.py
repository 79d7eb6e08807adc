"""Shared pieces of the registered queries: table readers, tidy output, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.operators.baselines import uniform
from chronoweft.operators.positions import number_rows
from chronoweft.session import tune
from chronoweft.sources.adapters import candles_from_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR
# windows in the registered queries use short chunks, so that the small sample tables already span
# several of them and carries are exercised
CHUNK = 256


def query(name: str, sql: str | None = None):
    """Register a query and, where one exists, the SQL that must give the same rows."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[
        F.col(c).cast("timestamp").alias(c) if t in ("timestamp_ntz", "date") else F.col(c)
        for c, t in df.dtypes
    ])


MONEY = {
    "equity", "peak", "equity_before_entry", "equity_after_exit", "pnl", "total_estimated_costs",
}


# products of cents and a cost rate: few decimals, so a coarser cut would meet exact ties
EXACT = {"entry_fill_price", "exit_fill_price"}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: micros for instants, bigint for integers, rounded doubles, cents."""
    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "timestamp":
            return F.unix_micros(c).alias(name)
        if kind in ("tinyint", "smallint", "int", "boolean"):
            return c.cast("int").cast("bigint").alias(name)
        if kind == "double":
            places = 2 if name in MONEY else 8 if name in EXACT else digits
            return F.round(c, places).alias(name)
        return c

    return df.select(*[one(n, k) for n, k in df.dtypes])


def r(expr: str, digits: int = 6) -> str:
    """SQL rounding without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def hourly(spark: SparkSession, sf_dir: str, timeframe: str = "1h",
           level: float = 0.0) -> DataFrame:
    """Hourly candles of every event type and of all events together.

    Event values jump by whole multiples; ``level`` lifts them to a price scale on which trading
    results stay in a sensible range.
    """
    ev = table(spark, sf_dir, "events").withColumn("value", F.col("value") + level)
    return candles_from_ticks(ev, ts="ts", price="value", timeframe=timeframe,
                              symbol="event_type", order="event_id")


def numbered(spark: SparkSession, sf_dir: str, timeframe: str = "1h",
             level: float = 0.0) -> DataFrame:
    """Hourly candles with positions and series length."""
    return number_rows(hourly(spark, sf_dir, timeframe, level), ["symbol"],
                       block_seconds=7 * 86_400, count="n")


def pseudo_score(seed: int = 7) -> Column:
    """Deterministic score of a decision row, the same in every engine."""
    return uniform(F.lit(seed), F.col("symbol"), F.unix_micros("timestamp"))


def sql_score(seed: int = 7, symbol: str = "symbol", t: str = "t") -> str:
    """The same score in SQL."""
    return (
        f"(('0x' || substr(md5('{seed}|' || {symbol} || '|' || {t}), 1, 13))::BIGINT "
        "/ 4503599627370496.0)"
    )


def sql_candles(step: int = HOUR, price: str = "value") -> str:
    """CTEs ``bars`` and ``candles`` (with ``pos`` and ``n``)."""
    return f"""
bars AS (
  SELECT symbol, epoch_us(ts) // {step} * {step} AS t,
         arg_min({price}, ts) AS o, max({price}) AS h, min({price}) AS l,
         arg_max({price}, ts) AS c,
         count(*)::DOUBLE AS v
  FROM (SELECT ts, value, unnest(['ALL', event_type]) AS symbol FROM events)
  GROUP BY 1, 2),
candles AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS pos,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM bars)"""
