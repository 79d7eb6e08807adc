"""Candle tables: typing, consolidation, incremental update, identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.timefns import timeframe_ms
from chronoweft.schemas import CANDLE_COLUMNS


def rows_to_candles(raw: DataFrame, values: str = "row") -> tuple[DataFrame, DataFrame]:
    """Exchange rows ``[epoch ms, o, h, l, c, v, …]`` to typed candles, and the rows refused.

    ``values`` is an array of strings. Short rows and rows with a value that is no number are
    returned in the second table, never dropped silently.
    """
    v = F.col(values)
    stamp = F.get(v, F.lit(0)).try_cast("bigint")
    numbers = [F.get(v, F.lit(i)).try_cast("double") for i in range(1, 6)]
    bad = (F.size(v) < len(CANDLE_COLUMNS)) | stamp.isNull()
    for n in numbers:
        bad = bad | n.isNull()
    bad = F.coalesce(bad, F.lit(True))
    others = [c for c in raw.columns if c != values]
    good = raw.filter(~bad).select(
        *others, F.timestamp_millis(stamp).alias("timestamp"),
        *[n.alias(c) for n, c in zip(numbers, CANDLE_COLUMNS[1:], strict=True)],
    )
    refused = raw.filter(bad).withColumn(
        "reason",
        F.when(F.size(v) < len(CANDLE_COLUMNS), "fewer than 6 values")
        .otherwise("value is not a number"),
    )
    return good, refused


def is_closed(ts: Column, timeframe: str, as_of: Column) -> Column:
    """True once the whole bar has elapsed at ``as_of``."""
    return F.unix_micros(ts) + F.lit(timeframe_ms(timeframe) * 1000) <= F.unix_micros(as_of)


def closed_candles(df: DataFrame, timeframe: str, as_of: Column) -> DataFrame:
    """Keep closed bars only; the clock is an argument."""
    return df.filter(is_closed(F.col("timestamp"), timeframe, as_of))


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``.

    An aggregate, not a ranking window: copies collapse before the shuffle, so a key repeated
    a billion times costs one row per input partition.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*key, *[F.col("_row")[c].alias(c) for c in rest])


def consolidate_pages(pages: DataFrame, keys: Sequence[str], timeframe: str, *, since: Column,
                      until: Column | None, as_of: Column,
                      order: Sequence[str] = ("page_seq", "row_seq")) -> DataFrame:
    """Landed pages to one candle table: range filter, last page wins, closed bars only."""
    ts = F.col("timestamp")
    inside = ts >= since if until is None else (ts >= since) & (ts < until)
    kept = closed_candles(pages.filter(inside), timeframe, as_of)
    return last_wins(kept, [*keys, "timestamp"], order).select(*keys, *CANDLE_COLUMNS)


def next_start(stored: DataFrame, keys: Sequence[str], timeframe: str) -> DataFrame:
    """High-water mark of each series: the first bar a later fetch has to ask for."""
    step = timeframe_ms(timeframe) * 1000
    return stored.groupBy(*keys).agg(
        F.timestamp_micros(F.unix_micros(F.max("timestamp")) + F.lit(step)).alias("next_start")
    )


def lookback_start(as_of: Column, lookback_days: int, timeframe: str) -> Column:
    """First fetch of a new series: ``as_of − lookback`` floored to the grid."""
    step = timeframe_ms(timeframe) * 1000
    start = F.unix_micros(as_of) - F.lit(lookback_days * 86_400_000_000)
    return F.timestamp_micros((F.floor(start / F.lit(step)) * F.lit(step)).cast("long"))


def merge_update(stored: DataFrame, fetched: DataFrame, keys: Sequence[str], timeframe: str,
                 as_of: Column) -> DataFrame:
    """Stored plus fetched candles; on the same bar the fetched row wins; closed bars only."""
    both = stored.select(*keys, *CANDLE_COLUMNS, F.lit(0).alias("_batch")).unionByName(
        fetched.select(*keys, *CANDLE_COLUMNS, F.lit(1).alias("_batch"))
    )
    merged = last_wins(closed_candles(both, timeframe, as_of), [*keys, "timestamp"], ["_batch"])
    return merged.select(*keys, *CANDLE_COLUMNS)


def update_report(stored: DataFrame, fetched: DataFrame, keys: Sequence[str], timeframe: str,
                  as_of: Column) -> DataFrame:
    """Rows before and after an update, and how many duplicates it removed, per series."""
    both = stored.select(*keys, "timestamp", F.lit(0).alias("_new")).unionByName(
        fetched.select(*keys, "timestamp", F.lit(1).alias("_new"))
    )
    per_bar = both.groupBy(*keys, "timestamp").agg(
        F.count(F.lit(1)).alias("_copies"), F.sum("_new").alias("_fresh")
    )
    closed = is_closed(F.col("timestamp"), timeframe, as_of).cast("int")
    return per_bar.groupBy(*keys).agg(
        F.sum(F.col("_copies") - F.col("_fresh")).alias("stored_rows"),
        F.sum("_fresh").cast("long").alias("fetched_rows"),
        F.sum(F.col("_copies") - 1).alias("duplicates_removed"),
        F.sum(closed).cast("long").alias("merged_rows"),
    )


def content_digest(df: DataFrame, keys: Sequence[str], decimals: int = 6) -> DataFrame:
    """Order-free identity of the rows of each series: count plus sum of per-row digests.

    Nothing is sorted or collected; equal tables give equal digests whatever their partitioning.
    """
    text = F.concat_ws(
        "|", F.unix_micros("timestamp").cast("string"),
        *[F.format_string(f"%.{decimals}f", F.col(c)) for c in CANDLE_COLUMNS[1:]],
    )
    word = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(word).cast("string").alias("digest")
    )


def symbol_slug(symbol: Column) -> Column:
    """File-safe lower-case name of a trading symbol."""
    lowered = F.lower(F.trim(symbol))
    joined = F.regexp_replace(lowered, r"[^a-z0-9]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")
