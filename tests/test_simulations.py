"""Simulations over trade cards against the row-by-row evaluation of the same draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.functions.costs import scenario_table
from chronoweft.operators import simulations as sm
from chronoweft.operators.baselines import uniform
from chronoweft.operators.risk import strategy_metrics
from chronoweft.operators.trades import evaluate

RUNS, SEED = 6, 42
BASE = [("base", 0.001, 2.0, 1.0)]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for symbol, n in (("A", 170), ("B", 61), ("C", 4), ("D", 12)):
        rows.append(pd.DataFrame({
            "symbol": symbol, "pos": range(n), "timestamp": pd.date_range("2025-01-01", periods=n, freq="h"),
            "open": np.round(100 * np.exp(rng.normal(0, 0.01, n).cumsum()), 1)}))
    market = spark.createDataFrame(pd.concat(rows)).cache()
    scores = market.filter("pos >= 3 and pos % 11 <> 5").withColumn(
        "probability_score", uniform(F.lit(1), F.col("symbol"), F.col("pos")))
    return market, scores.cache()


@pytest.mark.parametrize("chunk", [8, 37, 2048])
def test_cards_equal_row_by_row(spark, inputs, chunk):
    market, scores = inputs
    base = scenario_table(spark, BASE)
    got = sm.simulate(market, scores, base, simulations=RUNS, chunk_rows=chunk)
    rate = scores.groupBy("symbol").agg(F.avg((F.col("probability_score") >= 0.5).cast("double")).alias("q"))
    drawn = scores.join(rate, "symbol").withColumn("run_id", F.explode(F.sequence(
        F.lit(0), F.lit(RUNS - 1)))).withColumn("probability_score", F.when(
            uniform(F.col("run_id") + SEED, F.col("symbol"), F.col("pos")) < F.col("q"), 1.0).otherwise(0.0))
    curve, _ = evaluate(market, drawn, base)
    want = strategy_metrics(curve, ["run_id"], ["symbol"], 4, "1h", median=False)
    columns = [c for c in want.columns if c != "warnings"]
    order = ["symbol", "run_id"]
    a = got.select(*columns).toPandas().sort_values(order, ignore_index=True)
    b = want.select(*columns).toPandas().sort_values(order, ignore_index=True)
    assert len(a) == len(b) and set(a.symbol) == {"A", "B", "D"}
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)


def test_no_decisions_give_no_rows(spark, inputs):
    market, scores = inputs
    base = scenario_table(spark, BASE)
    assert sm.simulate(market, scores.limit(0), base, simulations=2).count() == 0
    with pytest.raises(ValueError, match="one cost scenario"):
        sm.simulate(market, scores, scenario_table(spark), simulations=2)
