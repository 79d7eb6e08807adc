"""Causal duplicate groups as a stateful stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweft import settings

OUTPUT = "dedup_fingerprint string, t long, anchor string, at long"
STATE = "at long, anchor string"
_TICK = 1_000_000  # microseconds of time in one millisecond of the stream's clock


def _assign(hours: int):
    horizon = hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame],
             state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        leads: dict[int, str] = {}
        for batch in batches:
            for t, article in batch.groupby("t")["article_id"].min().items():
                leads[t] = min(article, leads.get(t, article))
        at, anchor = state.get if state.exists else (None, None)
        rows = []
        for t in sorted(leads):
            if at is None or t - at > horizon:
                at, anchor = int(t), leads[t]
            rows.append((key[0], t, anchor, at))
        state.update((at, anchor))
        state.setTimeoutTimestamp(max(
            (at + horizon) // _TICK + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["dedup_fingerprint", "t", "anchor", "at"])

    return step


def grouped_stream(articles: DataFrame, *, hours: int = settings.DUPLICATE_HORIZON_HOURS,
                   lateness: str = "0 seconds") -> DataFrame:
    """Anchor of every text at every arrival instant; articles join it on text and instant.

    State per text is its newest anchor, dropped once 72 hours have passed. Articles are consumed
    batch by batch and only the first id of each instant is kept, so a text copied without end
    costs no more than the instants of one trigger.

    Pandas has no instants after 2262, so time travels as microseconds and the watermark runs on a
    clock that counts a second as a millisecond. A row up to two seconds behind is still taken.
    """
    delay = math.ceil(pd.Timedelta(lateness).total_seconds()) + 1
    t = F.unix_micros("first_seen_at")
    narrow = articles.select(
        "dedup_fingerprint", "article_id", t.alias("t"),
        F.timestamp_micros(F.floor(t / F.lit(_TICK // 1000)).cast("long")).alias("clock"),
    ).withWatermark("clock", f"{delay} milliseconds")
    return narrow.groupBy("dedup_fingerprint").applyInPandasWithState(
        _assign(hours), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    ).select(
        "dedup_fingerprint", F.timestamp_micros("t").alias("first_seen_at"),
        F.col("anchor").alias("anchor_article_id"),
        F.timestamp_micros("at").alias("anchor_first_seen_at"))
