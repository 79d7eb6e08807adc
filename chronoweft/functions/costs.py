"""Multiplicative trading costs, as numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft import settings


def bps_to_rate(bps: float) -> float:
    """Basis points to a decimal rate."""
    if not math.isfinite(bps) or bps < 0.0:
        raise ValueError("basis points must be finite and not negative")
    return bps / 10_000.0


def execution_rate(slippage_bps: float, half_spread_bps: float) -> float:
    """Adverse execution per side: slippage plus half the spread."""
    bps_to_rate(slippage_bps)
    bps_to_rate(half_spread_bps)
    return _rate("execution rate", bps_to_rate(slippage_bps + half_spread_bps))


def _rate(name: str, value: float) -> float:
    if not (math.isfinite(value) and 0.0 <= value < 1.0):
        raise ValueError(f"{name} must lie in [0, 1)")
    return value


def required_gross_return(fee: float, slippage_bps: float, half_spread_bps: float,
                          edge_bps: float) -> float:
    """Gross move that still leaves ``edge_bps`` after both fees and both executions."""
    f = _rate("fee rate", fee)
    e = execution_rate(slippage_bps, half_spread_bps)
    m = _rate("edge", bps_to_rate(edge_bps))
    return (1.0 + m) * (1.0 + e) / ((1.0 - e) * (1.0 - f) ** 2) - 1.0


def default_label_threshold() -> float:
    """The frozen label threshold."""
    return required_gross_return(
        settings.TAKER_FEE_RATE, settings.SLIPPAGE_BPS_PER_SIDE,
        settings.HALF_SPREAD_BPS_PER_SIDE, settings.MIN_EDGE_BPS,
    )


def round_trip_growth(fee: Column, execution: Column) -> Column:
    """Factor a round trip leaves of one unit when the market does not move."""
    keep = F.lit(1.0) - fee
    return (F.lit(1.0) - execution) / (F.lit(1.0) + execution) * keep * keep


def net_return(gross: Column, fee: Column, execution: Column) -> Column:
    """Net return of a round trip; null outside the domain (gross ≤ −1 or not finite)."""
    valid = (gross > -1.0) & ~F.isnan(gross) & (gross < float("inf"))
    return F.when(valid, (F.lit(1.0) + gross) * round_trip_growth(fee, execution) - 1.0)


def scenario_table(spark: SparkSession, scenarios=settings.COST_SCENARIOS) -> DataFrame:
    """Cost scenarios as a table ``(scenario, fee_rate, execution_rate)``; a handful of rows."""
    rows = [(n, _rate("fee rate", f), execution_rate(s, h)) for n, f, s, h in scenarios]
    if not rows:
        raise ValueError("at least one cost scenario is required")
    selects = [
        F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("fee_rate"),
                 F.lit(e).alias("execution_rate"))
        for n, f, e in rows
    ]
    return spark.range(1).select(F.inline(F.array(*selects)))


def sensitivity_scenarios(spark: SparkSession, scenarios=settings.COST_SCENARIOS) -> DataFrame:
    """Scenario table for a sensitivity run, which must hold the fee constant."""
    if len({f for _, f, _, _ in scenarios}) != 1:
        raise ValueError("cost sensitivity keeps the fee unchanged")
    return scenario_table(spark, scenarios)
