"""Clock and timeframe expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: milliseconds per timeframe unit, contract timestamp pattern
UNIT_MILLISECONDS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
TIMEFRAME_PATTERN = r"^([1-9][0-9]*)([mhd])$"
UTC_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"
YEAR_MILLISECONDS = 365 * 86_400_000
# ----------------------------------------------------------------------------


def timeframe_ms(timeframe: str) -> int:
    """Milliseconds of a fixed timeframe such as ``15m``, ``1h`` or ``1d``."""
    found = re.fullmatch(TIMEFRAME_PATTERN[1:-1], timeframe)
    if found is None:
        raise ValueError(f"unsupported timeframe {timeframe!r}")
    return int(found[1]) * UNIT_MILLISECONDS[found[2]]


def timeframe_ms_col(timeframe: Column) -> Column:
    """Column form for tables that mix timeframes; null where the text is not a timeframe."""
    units = F.create_map(*[F.lit(x) for kv in UNIT_MILLISECONDS.items() for x in kv])
    count = F.regexp_extract(timeframe, TIMEFRAME_PATTERN, 1)
    unit = F.regexp_extract(timeframe, TIMEFRAME_PATTERN, 2)
    return F.when(
        timeframe.rlike(TIMEFRAME_PATTERN),
        count.try_cast("bigint") * units[unit],
    )


def periods_per_year(timeframe_millis: Column) -> Column:
    """Bars in a 365-day year."""
    return F.lit(float(YEAR_MILLISECONDS)) / timeframe_millis


def utc_text_to_timestamp(text: Column) -> Column:
    """Strict RFC 3339 ``…Z`` text to timestamp; null when the text is not in that form."""
    return F.when(text.rlike(UTC_TIMESTAMP_PATTERN), text.try_cast("timestamp"))


def timestamp_to_utc_text(ts: Column) -> Column:
    """Canonical text: microseconds are shown only where they are not zero."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(
        micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def provider_timestamp(text: Column) -> Column:
    """Fourteen-digit or RFC 3339 provider time to timestamp; null when neither."""
    compact = F.when(
        text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    )
    return F.coalesce(compact, utc_text_to_timestamp(text))


def is_minute_aligned(ts: Column) -> Column:
    """True when the instant lies exactly on a UTC minute."""
    return F.pmod(F.unix_micros(ts), F.lit(60_000_000)) == 0
