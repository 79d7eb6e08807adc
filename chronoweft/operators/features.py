"""The trailing technical feature set (24 columns, frozen order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators.positions import (
    CHUNK, OWN, chunk_window, number_rows, spread_to_chunks,
)
from chronoweft.operators.recurrence import Cascade, Decay, decay_scan, scan_rows
from chronoweft.schemas import CANDLE_COLUMNS, reject_future_columns, require_columns
from chronoweft.settings import IndicatorSpec

DEFAULT_CHUNK_ROWS = 2048


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def finite(value: Column) -> Column:
    """Null in place of NaN and ±infinity."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lagged_returns(df: DataFrame, keys: Sequence[str], periods: Sequence[int], *,
                   chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``close[t]/close[t−n] − 1`` by row shift, never filled."""
    w = chunk_window(keys)
    spread = spread_to_chunks(df, chunk_rows, before=max(periods))
    return spread.withColumns({
        f"return_{n}": _ratio(F.col("close"), F.lag("close", n).over(w)) - 1.0 for n in periods
    }).filter(OWN).drop(CHUNK, OWN)


def candle_ratios(df: DataFrame) -> DataFrame:
    """Range and body of each candle, both relative."""
    return df.withColumns({
        "candle_range_pct": (F.col("high") - F.col("low")) / F.col("close"),
        "body_return": F.col("close") / F.col("open") - 1.0,
    })


def _full(w, rows: int, value: Column) -> Column:
    """Value only where the trailing frame holds ``rows`` rows."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) == rows, value)


def volume_features(df: DataFrame, keys: Sequence[str], spec: IndicatorSpec = IndicatorSpec(), *,
                    chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Volume change and volume relative to its full trailing mean."""
    spread = spread_to_chunks(df, chunk_rows, before=spec.volume_mean - 1)
    return spread.withColumns(_volume_columns(keys, spec)).filter(OWN).drop(CHUNK, OWN)


def _volume_columns(keys, spec) -> dict[str, Column]:
    w = chunk_window(keys)
    mean = F.avg("volume").over(w.rowsBetween(-(spec.volume_mean - 1), 0))
    return {
        "volume_change": _ratio(F.col("volume"), F.lag("volume", 1).over(w)) - 1.0,
        "volume_ma_ratio": _full(w, spec.volume_mean, _ratio(F.col("volume"), mean) - 1.0),
    }


def bollinger_features(df: DataFrame, keys: Sequence[str], spec: IndicatorSpec = IndicatorSpec(),
                       *, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Band width and position in the band, population deviation."""
    spread = spread_to_chunks(df, chunk_rows, before=spec.bollinger - 1)
    return spread.withColumns(_bollinger_columns(keys, spec)).filter(OWN).drop(CHUNK, OWN)


def _bollinger_columns(keys, spec) -> dict[str, Column]:
    w = chunk_window(keys)
    frame = w.rowsBetween(-(spec.bollinger - 1), 0)
    mid = F.avg("close").over(frame)
    half = F.stddev_pop("close").over(frame) * spec.bollinger_width
    low, high = mid - half, mid + half
    return {
        "bb_width": _full(w, spec.bollinger, _ratio(high - low, mid)),
        "bb_pct": _full(w, spec.bollinger, _ratio(F.col("close") - low, high - low)),
    }


def technical_features(df: DataFrame, keys: Sequence[str] = ("symbol",),
                       spec: IndicatorSpec = IndicatorSpec(), *,
                       chunk_rows: int = DEFAULT_CHUNK_ROWS,
                       positioned: bool = False, keep_warmup: bool = False) -> DataFrame:
    """Candles plus the 24 features, without the leading rows that lack history.

    A row that is incomplete *after* the first complete row stays in the output with nulls; it is a
    contract violation that :func:`incomplete_after_warmup` lists. Leading rows end at the first
    complete position of the whole series, whatever ``chunk_rows`` is: one aggregate row per series is
    joined back. A series without a complete row has no output.
    """
    require_columns(reject_future_columns(df), [*keys, *CANDLE_COLUMNS])
    keys = list(keys)
    rows = df if positioned else number_rows(df, keys)

    look_back = max(max(spec.returns), spec.bollinger - 1, spec.volume_mean - 1,
                    spec.stoch_rsi - 1, spec.atr)
    w = chunk_window(keys)
    close = F.col("close")
    previous = F.lag("close", 1).over(w)
    change = close - previous
    pos = F.col("pos")
    wilder_rsi, wilder_atr = 1.0 / spec.rsi, 1.0 / spec.atr

    fed = scan_rows(rows, chunk_rows, look_back).withColumns({
        "_gain": F.when(change > 0, change).otherwise(0.0),
        "_loss": F.when(change < 0, -change).otherwise(0.0),
        "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous),
                             F.abs(F.col("low") - previous)),
        **{f"return_{n}": _ratio(close, F.lag("close", n).over(w)) - 1.0 for n in spec.returns},
        **_volume_columns(keys, spec),
        **_bollinger_columns(keys, spec),
    })
    seed_range = F.avg("_range").over(w.rowsBetween(-(spec.atr - 1), 0))
    spans = {"_e_short": spec.ema_short, "_e_long": spec.ema_long,
             "_e_fast": spec.macd_fast, "_e_slow": spec.macd_slow}
    alpha = {name: 2.0 / (n + 1.0) for name, n in spans.items()}
    fed = fed.withColumns({
        **{f"_u{name}": F.when(pos == 0, close).otherwise(close * a) for name, a in alpha.items()},
        "_u_gain": F.when(pos == 0, F.col("_gain")).otherwise(F.col("_gain") * wilder_rsi),
        "_u_loss": F.when(pos == 0, F.col("_loss")).otherwise(F.col("_loss") * wilder_rsi),
        "_u_range": F.when(pos == spec.atr - 1, seed_range)
        .when(pos >= spec.atr, F.col("_range") * wilder_atr).otherwise(0.0),
    })
    alpha_signal = 2.0 / (spec.macd_signal + 1.0)
    scanned = decay_scan(
        fed, keys,
        [Decay(name, 1.0 - a, f"_u{name}") for name, a in alpha.items()]
        + [Decay("_g", 1.0 - wilder_rsi, "_u_gain"), Decay("_d", 1.0 - wilder_rsi, "_u_loss"),
           Decay("_atr", 1.0 - wilder_atr, "_u_range")],
        [Cascade("_signal", 1.0 - alpha_signal, alpha_signal, {"_e_fast": 1.0, "_e_slow": -1.0},
                 start_pos=spec.macd_slow - 1)],
        chunk_rows=chunk_rows, before=look_back,
    )

    def from_row(n: int, value: Column) -> Column:
        return F.when(pos >= n - 1, value)

    relative = F.col("_g") / F.col("_d")
    scanned = scanned.withColumns({
        "ema_short": from_row(spec.ema_short, F.col("_e_short")),
        "ema_long": from_row(spec.ema_long, F.col("_e_long")),
        "macd": from_row(spec.macd_slow, F.col("_e_fast") - F.col("_e_slow")),
        "macd_signal": from_row(spec.macd_slow + spec.macd_signal - 1, F.col("_signal")),
        "rsi": from_row(
            spec.rsi,
            F.when(F.col("_d") == 0, 100.0)
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + relative)),
        ),
        "atr": from_row(spec.atr, F.col("_atr")),
    })
    frame = w.rowsBetween(-(spec.stoch_rsi - 1), 0)
    low_rsi, high_rsi = F.min("rsi").over(frame), F.max("rsi").over(frame)
    stochastic = F.when(
        F.count("rsi").over(frame) == spec.stoch_rsi,
        _ratio(F.col("rsi") - low_rsi, high_rsi - low_rsi),
    )
    complete = scanned.withColumns({
        "stoch_rsi": stochastic,
        "ema_ratio": _ratio(F.col("ema_short"), F.col("ema_long")) - 1.0,
        "close_to_ema_short": _ratio(close, F.col("ema_short")) - 1.0,
        "close_to_ema_long": _ratio(close, F.col("ema_long")) - 1.0,
        "macd_diff": F.col("macd") - F.col("macd_signal"),
        "atr_pct": _ratio(F.col("atr"), close),
    }).filter(OWN)
    complete = candle_ratios(complete)
    columns = spec.feature_columns
    out = complete.select(
        *keys, "pos", CHUNK, *CANDLE_COLUMNS, *[finite(F.col(c)).alias(c) for c in columns]
    )
    if keep_warmup:
        return out.drop(CHUNK)
    return trim_warmup(out.drop(CHUNK), keys, columns)


def is_complete(columns: Sequence[str]) -> Column:
    """True where no feature is null."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def first_complete(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Position of the first complete row of each series, and its row count."""
    return df.groupBy(*keys).agg(
        F.min(F.when(is_complete(columns), F.col("pos"))).alias("_first"),
        F.count(F.lit(1)).alias("_rows"),
    )


def trim_warmup(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Drop only the leading incomplete rows of each series."""
    first = first_complete(df, keys, columns).select(*keys, "_first")
    return df.join(first, list(keys)).filter(F.col("pos") >= F.col("_first")).drop("_first")


def incomplete_after_warmup(df: DataFrame, keys: Sequence[str],
                            columns: Sequence[str]) -> DataFrame:
    """Violations: a later row lacks a feature, or a series has no complete row at all."""
    first = first_complete(df, keys, columns).select(*keys, "_first")
    late = (
        df.join(first, list(keys))
        .filter((F.col("pos") > F.col("_first")) & ~is_complete(columns))
        .select(*keys, F.lit("incomplete_after_warmup").alias("check"), F.col("timestamp"))
    )
    never = first.filter("_first is null").select(
        *keys, F.lit("insufficient_history").alias("check"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    )
    return late.unionByName(never)


__all__ = [
    "bollinger_features", "candle_ratios", "finite", "incomplete_after_warmup", "lagged_returns",
    "technical_features", "trim_warmup", "volume_features",
]
