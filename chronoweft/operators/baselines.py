"""Baseline strategies and their comparison with a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.risk import strategy_metrics
from chronoweft.operators.trades import (
    evaluate, held_window_curve, performance_windows,
)


def rule_scores(decisions: DataFrame, rules: dict[str, Column],
                run: str = "run_id") -> DataFrame:
    """Boolean rules over decision rows as 0/1 score sets, one run per rule."""
    cases = F.array(*[
        F.struct(F.lit(name).alias(run),
                 F.when(F.coalesce(rule, F.lit(False)), 1.0).otherwise(0.0)
                 .alias("probability_score"))
        for name, rule in rules.items()
    ])
    rest = [c for c in decisions.columns if c not in (run, "probability_score")]
    return decisions.select(*rest, F.inline(cases))


def standard_rules() -> dict[str, Column]:
    """Cash, moving-average crossover and 24-bar momentum."""
    return {
        "cash": F.lit(False),
        "ema_crossover": F.col("ema_short") > F.col("ema_long"),
        "momentum_24": F.col("return_24") > 0.0,
    }


def uniform(seed: Column, *parts: Column) -> Column:
    """A number in [0, 1) that depends on its inputs only, not on partitioning."""
    text = F.concat_ws("|", seed.cast("string"), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def random_exposure_summary(simulated: DataFrame, model_return: DataFrame,
                            keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Median, 5th and 95th percentile of three metrics, and the share that beats the model.

    One row per simulation enters, so the percentile state is bounded by their number.
    """
    keys = list(keys)
    shares = F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))
    columns = ["total_return", "sharpe_ratio", "maximum_drawdown"]
    joined = simulated.join(model_return.select(
        *keys, F.col("total_return").alias("_model")), keys)
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("simulations"),
        F.first("signal_probability").alias("signal_probability"),
        F.avg((F.col("total_return") >= F.col("_model")).cast("double"))
        .alias("fraction_return_at_least_model"),
        *[F.percentile(c, shares).alias(f"_{c}") for c in columns],
    )
    for c in columns:
        for i, name in enumerate(("median", "p05", "p95")):
            out = out.withColumn(f"{c}_{name}", F.get(F.col(f"_{c}"), F.lit(i)))
    return out.drop(*[f"_{c}" for c in columns])


def cost_sensitivity(market: DataFrame, scores: DataFrame, scenarios: DataFrame, timeframe: str,
                     **options) -> DataFrame:
    """Metrics of the same signals under every cost scenario; the selection runs once."""
    run_keys = options.get("run_keys", ("run_id",))
    keys = options.get("keys", ("symbol",))
    horizon = options.get("horizon", settings.PREDICTION_HORIZON)
    curve, _ = evaluate(market, scores, scenarios, **options)
    return strategy_metrics(curve, run_keys, keys, horizon, timeframe, scores=scores)


def buy_and_hold(market: DataFrame, decisions: DataFrame, scenarios: DataFrame, *,
                 keys: Sequence[str] = ("symbol",), horizon: int = settings.PREDICTION_HORIZON,
                 capital: float = settings.INITIAL_CAPITAL) -> tuple[DataFrame, DataFrame]:
    """Curve and ledger of buying at the window start and selling at its end."""
    lengths = market.groupBy(*keys).agg((F.max("pos") + 1).alias("n"))
    windows = performance_windows(decisions, lengths, [], keys, horizon).select(
        F.lit("buy_and_hold").alias("run_id"), "*"
    )
    return held_window_curve(market, windows, scenarios, ["run_id"], keys, horizon,
                             capital=capital)


def strategy_suite(market: DataFrame, model_scores: DataFrame, scenario: DataFrame,
                   timeframe: str, *, keys: Sequence[str] = ("symbol",),
                   horizon: int = settings.PREDICTION_HORIZON,
                   capital: float = settings.INITIAL_CAPITAL,
                   model_scenarios: DataFrame | None = None, median: bool = False) -> DataFrame:
    """Model, cash, crossover, momentum and buy-and-hold on one common window.

    Decision rows carry the features, so all rule runs and the model are one score table and one
    evaluation. The curves are unioned before the metrics, which are computed once. With
    ``model_scenarios`` the same evaluation also gives the model's rows under those costs.
    """
    keys = list(keys)
    columns = ["run_id", *keys, "pos", "timestamp", "probability_score"]
    model = model_scores.withColumn("run_id", F.lit("model")).select(*columns)
    rules = rule_scores(model_scores, standard_rules()).select(*columns)
    scores = model.unionByName(rules)
    costs = scenario if model_scenarios is None else scenario.union(model_scenarios).distinct()
    curve, _ = evaluate(market, scores, costs, keys=keys, horizon=horizon, capital=capital)
    if model_scenarios is not None:
        wanted = F.col("scenario").isin([r["scenario"] for r in scenario.collect()])
        curve = curve.filter(wanted | (F.col("run_id") == "model"))
    held, _ = buy_and_hold(market, model_scores, scenario, keys=keys, horizon=horizon,
                           capital=capital)
    return strategy_metrics(curve.unionByName(held), ["run_id"], keys, horizon, timeframe,
                            capital=capital, median=median)


def excess_returns(metrics: DataFrame, keys: Sequence[str], model: str = "model",
                   run: str = "run_id") -> DataFrame:
    """Model return minus buy-and-hold and minus cash, by pivoting metric rows."""
    def of(name: str) -> Column:
        return F.max(F.when(F.col(run) == name, F.col("total_return")))

    return metrics.groupBy(*keys, "scenario").agg(
        (of(model) - of("buy_and_hold")).alias("excess_return_vs_buy_and_hold"),
        (of(model) - of("cash")).alias("excess_return_vs_cash"),
    )
