"""Executable next-open labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions.costs import default_label_threshold
from chronoweft.operators.positions import CHUNK, OWN, chunk_window, spread_to_chunks


def next_open_labels(df: DataFrame, keys: Sequence[str] = ("symbol",), *,
                     horizon: int = settings.PREDICTION_HORIZON,
                     minimum_return: float | None = None,
                     chunk_rows: int = 2048) -> DataFrame:
    """Decision at row ``t`` enters at the next open and leaves ``horizon`` rows later.

    Rows without both prices leave the result. ``label`` is 1 where the gross return is strictly
    above the threshold. Needs ``pos`` (rows numbered in time order without holes).
    """
    if isinstance(horizon, bool) or not isinstance(horizon, int) or horizon <= 0:
        raise ValueError("horizon must be a positive integer")
    tau = default_label_threshold() if minimum_return is None else minimum_return
    if not math.isfinite(tau) or tau < 0.0:
        raise ValueError("minimum return must be finite and not negative")
    w = chunk_window(keys)
    ahead = horizon + 1
    spread = spread_to_chunks(df, chunk_rows, after=ahead)
    return (
        spread.withColumns({
            "entry_timestamp": F.lead("timestamp", 1).over(w),
            "exit_timestamp": F.lead("timestamp", ahead).over(w),
            "entry_open": F.lead("open", 1).over(w),
            "exit_open": F.lead("open", ahead).over(w),
        })
        .filter(F.col(OWN) & F.col("exit_open").isNotNull() & F.col("entry_open").isNotNull())
        .withColumn("gross_forward_return", F.col("exit_open") / F.col("entry_open") - 1.0)
        .withColumn("label", (F.col("gross_forward_return") > tau).cast("tinyint"))
        .drop(CHUNK, OWN)
    )
