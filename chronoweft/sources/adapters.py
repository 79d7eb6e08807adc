"""Candles and articles out of other tables (event streams, order books, document stores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.timefns import timeframe_ms


def bucket_start(ts: Column, timeframe: str) -> Column:
    """Open time of the bar an instant falls into."""
    step = timeframe_ms(timeframe) * 1000
    return F.timestamp_micros(
        (F.floor(F.unix_micros(ts) / F.lit(step)) * F.lit(step)).cast("long")
    )


def tick_rank(ticks: DataFrame, ts: str, order: str | None) -> Column:
    """Arrival order of ticks as one value.

    With an integer tie-breaker the rank is a single decimal, which keeps first and last price in a
    hash aggregate; a struct would force a sort of all ticks.
    """
    if order is None:
        return F.unix_micros(ts)
    if dict(ticks.dtypes)[order] in ("tinyint", "smallint", "int", "bigint"):
        scale = F.lit("10000000000000000000").cast("decimal(20,0)")
        return F.unix_micros(ts).cast("decimal(18,0)") * scale + F.col(order).cast("decimal(19,0)")
    return F.struct(F.col(ts), F.col(order))


def candles_from_ticks(ticks: DataFrame, *, ts: str, price: str, timeframe: str,
                       symbol: str | None = None, order: str | None = None,
                       total_symbol: str | None = "ALL") -> DataFrame:
    """Roll ticks up into candles; volume counts ticks.

    Ticks collapse to one row per bar before anything is shuffled (partial aggregation), so a
    symbol that holds most of the ticks costs no more than its bars. ``total_symbol`` adds one
    series over all symbols, built from the bars rather than from the ticks.
    """
    rank = tick_rank(ticks, ts, order)
    base = ticks.select(
        (F.col(symbol) if symbol else F.lit(total_symbol)).alias("symbol"),
        bucket_start(F.col(ts), timeframe).alias("timestamp"),
        rank.alias("_rank"), F.col(price).cast("double").alias("_price"),
    )
    bars = base.groupBy("symbol", "timestamp").agg(
        F.min_by("_price", "_rank").alias("open"), F.max("_price").alias("high"),
        F.min("_price").alias("low"), F.max_by("_price", "_rank").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.min("_rank").alias("_first"), F.max("_rank").alias("_last"),
    )
    if symbol and total_symbol:
        bars = (
            bars.withColumn("symbol", F.explode(F.array(F.col("symbol"), F.lit(total_symbol))))
            .groupBy("symbol", "timestamp").agg(
                F.min_by("open", "_first").alias("open"), F.max("high").alias("high"),
                F.min("low").alias("low"), F.max_by("close", "_last").alias("close"),
                F.sum("volume").alias("volume"),
            )
        )
    return bars.select("symbol", "timestamp", "open", "high", "low", "close", "volume")
