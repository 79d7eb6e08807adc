"""Strategy metrics from equity marks and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.functions.costs import round_trip_growth
from chronoweft.functions.timefns import YEAR_MILLISECONDS, timeframe_ms
from chronoweft.operators.positions import CHUNK
from chronoweft.operators.quantiles import exact_quantiles

# --- fixed values: metric warnings
NO_LOSS_WARNING = "Profit factor is undefined because there are no losing trades"
SHARPE_WARNING = (
    "Sharpe ratio is undefined because observations are insufficient or volatility is zero"
)
SORTINO_WARNING = (
    "Sortino ratio is undefined because observations are insufficient or downside deviation is zero"
)
# ----------------------------------------------------------------------------


def interval_returns(marks: DataFrame, ids: Sequence[str], *, equity: str = "equity",
                     pos: str = "pos", capital: float = settings.INITIAL_CAPITAL,
                     chunk_rows: int = 8192) -> DataFrame:
    """Interval returns of any mark table with dense positions from 0.

    The first mark has none; the second is measured from the initial capital.
    """
    from chronoweft.operators.positions import OWN, chunk_window, spread_to_chunks

    w = chunk_window(ids, pos)
    previous = F.when(F.col(pos) == 1, F.lit(capital)).otherwise(F.lag(equity, 1).over(w))
    return (
        spread_to_chunks(marks, chunk_rows, before=1, pos=pos)
        .withColumn("period_return", F.when(F.col(pos) > 0, F.col(equity) / previous - 1.0))
        .filter(OWN).drop(CHUNK, OWN)
    )


def drawdowns(marks: DataFrame, ids: Sequence[str], *, equity: str = "equity", pos: str = "pos",
              capital: float = settings.INITIAL_CAPITAL, chunk_rows: int = 8192) -> DataFrame:
    """Running peak (the initial capital is the first) and drawdown of any mark table."""
    from chronoweft.operators.positions import chunk_of

    ids = list(ids)
    rows = marks.withColumn(CHUNK, chunk_of(pos, chunk_rows))
    w = Window.partitionBy(*ids, CHUNK).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    prior = Window.partitionBy(*ids).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*ids, CHUNK).agg(F.max(equity).alias("_t")).select(
        *ids, CHUNK, F.coalesce(F.max("_t").over(prior), F.lit(capital)).alias("_c")
    )
    out = rows.withColumn("_m", F.max(equity).over(w)).join(tops, [*ids, CHUNK])
    peak = F.greatest(F.lit(capital), F.col("_c"), F.col("_m"))
    return out.withColumns({
        "peak": peak, "drawdown": F.col(equity) / peak - 1.0,
    }).drop("_m", "_c")


def underwater(curve: DataFrame, ids: Sequence[str], start: Column) -> DataFrame:
    """Per chunk: what is needed to join underwater streaks across chunk borders."""
    w = Window.partitionBy(*ids, CHUNK).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    dry = F.when(~(F.col("drawdown") < 0.0), F.col("pos"))
    return curve.withColumn("_dry", F.max(dry).over(w)).withColumn("_start", start)


def _streak_columns() -> list[Column]:
    wet = F.col("drawdown") < 0.0
    return [
        F.max("_dry").alias("_last_dry"),
        F.max(F.when(wet & F.col("_dry").isNotNull(), F.col("pos") - F.col("_dry"))).alias("_run"),
        F.max(F.when(wet & F.col("_dry").isNull(), F.col("pos"))).alias("_lead"),
        F.min("_start").alias("_s"),
    ]


def _longest(chunks: DataFrame, ids: Sequence[str]) -> DataFrame:
    prior = Window.partitionBy(*ids).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    dry = F.coalesce(F.max("_last_dry").over(prior), F.col("_s"))
    return chunks.withColumn("_streak", F.greatest(
        F.coalesce(F.col("_run"), F.lit(0)), F.coalesce(F.col("_lead") - dry, F.lit(0))
    ))


def drawdown_summary(curve: DataFrame, ids: Sequence[str], start: Column) -> DataFrame:
    """Deepest drawdown (never above zero) and longest underwater streak in intervals."""
    chunks = underwater(curve, ids, start).groupBy(*ids, CHUNK).agg(
        F.min("drawdown").alias("_dd"), *_streak_columns()
    )
    return _longest(chunks, ids).groupBy(*ids).agg(
        F.least(F.lit(0.0), F.min("_dd")).alias("maximum_drawdown"),
        F.max("_streak").cast("long").alias("maximum_drawdown_duration"),
    )


def score_context(scores: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Probability and label rates; the positive rate always cuts at one half."""
    label = F.avg("label") if "label" in scores.columns else F.lit(None).cast("double")
    return scores.groupBy(*ids).agg(
        F.avg((F.col("probability_score") >= 0.5).cast("double"))
        .alias("positive_prediction_rate"),
        F.avg("probability_score").alias("average_buy_probability"),
        label.alias("actual_positive_label_rate"),
    )


def metric_columns(total: DataFrame, ids: Sequence[str], timeframe: str, *,
                   capital: float = settings.INITIAL_CAPITAL, risk_free: float = 0.0) -> DataFrame:
    """The metric row of every run from its sums of intervals and trades."""
    ppy = float(YEAR_MILLISECONDS) / timeframe_ms(timeframe)
    rf = (1.0 + risk_free) ** (1.0 / ppy) - 1.0
    c = F.col
    one = F.lit(1.0)
    m = c("n_intervals")
    mean = F.try_divide(c("_s1"), m)
    variance = F.try_divide(F.greatest(c("_s2") - m * mean * mean, F.lit(0.0)), m - 1)
    total = total.withColumns({
        "_mu": mean, "_sigma": F.when(m > 1, F.sqrt(variance)),
        "_dside": F.when(m > 1, F.sqrt(c("_down") / m)).otherwise(0.0),
        "total_return": c("_final") / capital - 1.0,
    }).withColumn(
        "annualized_return",
        F.when((m > 0) & (c("total_return") > -1.0),
               F.pow(one + c("total_return"), F.lit(ppy) / m) - 1.0),
    )
    scale = F.lit(ppy ** 0.5)
    nt = c("num_trades")
    sharpe = F.when(c("_sigma") > 0, (c("_mu") - rf) / c("_sigma") * scale)
    sortino = F.when(c("_dside") > 0, (c("_mu") - rf) / c("_dside") * scale)
    return total.select(
        *ids, "total_return", "annualized_return",
        (c("_sigma") * scale).alias("annualized_volatility"),
        sharpe.alias("sharpe_ratio"), sortino.alias("sortino_ratio"),
        "maximum_drawdown", "maximum_drawdown_duration",
        F.when(c("maximum_drawdown") < 0,
               c("annualized_return") / F.abs(c("maximum_drawdown"))).alias("calmar_ratio"),
        "num_trades", F.try_divide(c("_wins"), nt).alias("win_rate"),
        F.try_divide(c("_rsum"), nt).alias("average_trade_return"),
        F.try_divide(c("_wsum"), c("_wins")).alias("average_winning_return"),
        F.try_divide(c("_lsum"), c("_loss")).alias("average_losing_return"),
        "largest_winning_trade", "largest_losing_trade",
        F.when(c("_dn") < 0, F.coalesce(c("_up"), F.lit(0.0)) / F.abs(c("_dn")))
        .alias("profit_factor"),
        F.coalesce(F.try_divide(c("_expo"), m), F.lit(0.0)).alias("market_exposure"),
        F.coalesce(F.when(c("_avg_equity") > 0, c("_turn") / c("_avg_equity")), F.lit(0.0))
        .alias("turnover"),
        F.try_divide(c("_hold"), nt).alias("average_holding_period"),
        F.coalesce(c("_cost"), F.lit(0.0)).alias("total_estimated_costs"),
        "n_intervals",
        F.array_compact(F.array(
            F.when((nt > 0) & ~F.coalesce(c("_dn") < 0, F.lit(False)), NO_LOSS_WARNING),
            F.when(sharpe.isNull(), SHARPE_WARNING),
            F.when(sortino.isNull(), SORTINO_WARNING),
        )).alias("warnings"),
    )


def strategy_metrics(curve: DataFrame, run_keys: Sequence[str], keys: Sequence[str], horizon: int,
                     timeframe: str, *, scores: DataFrame | None = None,
                     capital: float = settings.INITIAL_CAPITAL, risk_free: float = 0.0,
                     median: bool = True) -> DataFrame:
    """The full metric row of every run and scenario.

    Marks and trades (exit marks) are reduced per chunk in one pass; runs combine a few rows per
    chunk. Undefined ratios are null, never zero.
    """
    ids = [*run_keys, "scenario", *keys]
    ppy = float(YEAR_MILLISECONDS) / timeframe_ms(timeframe)
    rf = (1.0 + risk_free) ** (1.0 / ppy) - 1.0
    c = F.col
    one = F.lit(1.0)
    is_trade = c("held") == horizon + 1
    keep = round_trip_growth(c("fee_rate"), c("execution_rate"))
    grow = c("open") / c("entry_open") * keep
    before = c("equity") / grow
    quantity = before * (one - c("fee_rate")) / (
        c("entry_open") * (one + c("execution_rate")))
    fees = before * c("fee_rate") + quantity * c("open") * (
        one - c("execution_rate")) * c("fee_rate")
    execution = quantity * (c("entry_open") + c("open")) * c("execution_rate")
    ret, pnl = grow - 1.0, c("equity") - before

    def trades(value: Column, when: Column | None = None) -> Column:
        return F.when(is_trade if when is None else is_trade & when, value)

    downside = F.least(c("period_return") - rf, F.lit(0.0))
    rows = underwater(curve, ids, c("start_pos"))
    chunks = rows.groupBy(*ids, CHUNK).agg(
        F.count("period_return").alias("_n"), F.avg("period_return").alias("_mean"),
        F.var_pop("period_return").alias("_var"), F.sum(downside * downside).alias("_down"),
        F.sum("market_exposure").alias("_expo"), F.sum("equity").alias("_esum"),
        F.count("equity").alias("_marks"), F.max_by("equity", "pos").alias("_end"),
        F.min("drawdown").alias("_dd"), *_streak_columns(),
        F.count_if(is_trade).alias("_trades"),
        F.sum(trades(ret)).alias("_rsum"),
        F.count(trades(ret, ret > 0)).alias("_wins"), F.sum(trades(ret, ret > 0)).alias("_wsum"),
        F.count(trades(ret, ret < 0)).alias("_loss"), F.sum(trades(ret, ret < 0)).alias("_lsum"),
        F.max(trades(ret, ret > 0)).alias("_best"), F.min(trades(ret, ret < 0)).alias("_worst"),
        F.sum(trades(pnl, pnl > 0)).alias("_up"), F.sum(trades(pnl, pnl < 0)).alias("_dn"),
        F.sum(trades(quantity * (c("entry_open") + c("open")))).alias("_turn"),
        F.sum(trades(fees + execution)).alias("_cost"),
        F.sum(trades(c("pos") - c("signal_pos") - 1)).alias("_hold"),
    )
    n = c("_n")
    total = _longest(chunks, ids).groupBy(*ids).agg(
        F.sum(n).alias("n_intervals"), F.sum(n * c("_mean")).alias("_s1"),
        F.sum(n * (c("_var") + c("_mean") * c("_mean"))).alias("_s2"),
        F.sum("_down").alias("_down"), F.sum("_expo").alias("_expo"),
        (F.sum("_esum") / F.sum("_marks")).alias("_avg_equity"),
        F.max_by("_end", CHUNK).alias("_final"),
        F.least(F.lit(0.0), F.min("_dd")).alias("maximum_drawdown"),
        F.max("_streak").cast("long").alias("maximum_drawdown_duration"),
        F.sum("_trades").alias("num_trades"),
        *[F.sum(x).alias(x) for x in
          ("_rsum", "_wins", "_wsum", "_loss", "_lsum", "_up", "_dn", "_turn", "_cost", "_hold")],
        F.max("_best").alias("largest_winning_trade"),
        F.min("_worst").alias("largest_losing_trade"),
    )
    out = metric_columns(total, ids, timeframe, capital=capital, risk_free=risk_free)
    if median:
        per_trade = curve.filter(is_trade).select(*ids, ret.alias("_r"))
        out = out.join(
            exact_quantiles(per_trade, ids, "_r", {"median_trade_return": 0.5}), ids, "left"
        )
    if scores is not None:
        out = out.join(score_context(scores, [*run_keys, *keys]), [*run_keys, *keys], "left")
    return out
