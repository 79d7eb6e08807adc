"""Selection, ledgers, equity, risk and classification metrics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.functions.costs import scenario_table
from chronoweft.operators import classification as cl
from chronoweft.operators import risk
from chronoweft.operators import trades as tr
from chronoweft.operators.quantiles import exact_quantiles
from chronoweft.operators.selection import select_non_overlapping


def market(spark, opens):
    return spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "pos": range(len(opens)), "open": np.asarray(opens, float),
        "timestamp": pd.date_range("2026-01-01", periods=len(opens), freq="h")}))


def scores(spark, values, n):
    ts = pd.date_range("2026-01-01", periods=n, freq="h")
    return spark.createDataFrame(pd.DataFrame([
        {"run_id": "r", "symbol": "A", "pos": p, "timestamp": ts[p], "probability_score": s}
        for p, s in values.items()]))


def run(spark, opens, values, horizon=2, cost=("c", 0.0, 0.0, 0.0), capital=10_000.0, **kw):
    curve, ledger = tr.evaluate(
        market(spark, opens), scores(spark, values, len(opens)), scenario_table(spark, [cost]),
        horizon=horizon, capital=capital, **kw)
    return curve.orderBy("pos").toPandas(), ledger.orderBy("trade_id").toPandas(), curve, ledger


OPENS = list(range(100, 112))


def test_one_trade_and_its_costs(spark):
    _, ledger, _, _ = run(spark, OPENS, {0: 0.9, 1: 0.9, 2: 0.0}, cost=("c", 0.001, 2.0, 1.0))
    assert ledger[["entry_position", "exit_position"]].values.tolist() == [[1, 3]]
    e, f = 0.0003, 0.001
    want = (103 / 101) * (1 - e) / (1 + e) * (1 - f) ** 2 - 1
    assert math.isclose(ledger.net_return[0], want, rel_tol=1e-12)


@pytest.mark.parametrize("chunk_rows", [4, 16_384])
def test_signal_at_the_exit_open_is_eligible(spark, chunk_rows):
    _, ledger, curve, raw = run(spark, OPENS, {0: 0.9, 1: 0.9, 3: 0.9}, chunk_rows=chunk_rows)
    assert ledger.entry_position.tolist() == [1, 4]
    assert math.isclose(ledger.equity_before_entry[1], ledger.equity_after_exit[0])
    assert tr.accounting_violations(curve, raw, ["run_id"], ["symbol"]).count() == 0


def test_window_ends_with_the_last_executable_decision(spark):
    curve, ledger, _, _ = run(spark, OPENS, {6: 0.9, 9: 0.9})
    assert ledger.exit_position.tolist() == [9] and curve.pos.tolist() == [7, 8, 9]


def test_flat_market_drawdown_is_the_cost(spark):
    _, ledger, curve, _ = run(spark, [100.0] * 6, {0: 0.9}, cost=("c", 0.001, 2.0, 1.0),
                              capital=100.0)
    m = risk.strategy_metrics(curve, ["run_id"], ["symbol"], 2, "1h", capital=100.0).first()
    assert math.isclose(m.maximum_drawdown, ledger.net_return[0], rel_tol=1e-12)
    assert m.maximum_drawdown_duration == 2 and m.num_trades == 1
    assert math.isclose(m.median_trade_return, ledger.net_return[0], rel_tol=1e-12)
    assert m.profit_factor == 0.0 and m.average_winning_return is None


@pytest.mark.parametrize("equities,drawdown,duration", [
    ([100, 80, 100], -0.2, 1), ([100, 90, 80], -0.2, 2), ([100, 100.01, 100.02], 0.0, 0)])
def test_manual_drawdowns(spark, equities, drawdown, duration):
    df = spark.createDataFrame(pd.DataFrame({
        "k": 1, "pos": range(len(equities)), "equity": np.asarray(equities, float)}))
    rows = risk.drawdowns(df, ["k"], capital=100.0, chunk_rows=2)
    got = risk.drawdown_summary(rows, ["k"], F.lit(0).cast("long")).first()
    assert math.isclose(got.maximum_drawdown, drawdown, abs_tol=1e-12)
    assert got.maximum_drawdown_duration == duration


@pytest.mark.parametrize("share", [0.05, 0.4, 1.0])
@pytest.mark.parametrize("horizon", [1, 4])
def test_selection_equals_the_sequential_rule(spark, share, horizon):
    rng = np.random.default_rng(int(share * 100) + horizon)
    pos = np.flatnonzero(rng.random(3000) < share)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": pos}))
    want, free = [], 0
    for p in pos:
        if p >= free:
            want.append(p)
            free = p + horizon + 1
    for chunk, block in ((16, 4), (64, 2048), (4096, 2048)):
        got = select_non_overlapping(df, ["k"], horizon, chunk_rows=chunk, block_chunks=block)
        assert sorted(r.pos for r in got.collect()) == want


def test_curve_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    opens = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))
    values = {int(p): float(s) for p, s in zip(range(20, 390), rng.random(370), strict=True)}
    frames = []
    for chunk in (32, 16_384):
        curve, ledger, raw, led = run(spark, opens, values, 4, ("c", 0.001, 2, 1),
                                      chunk_rows=chunk)
        frames.append(curve[["pos", "equity", "drawdown", "period_return", "trade_number"]])
        assert tr.accounting_violations(raw, led, ["run_id"], ["symbol"]).count() == 0
    pd.testing.assert_frame_equal(*frames, rtol=1e-12)


def test_ledger_faults_are_reported(spark):
    _, _, curve, ledger = run(spark, OPENS, {0: 0.9, 3: 0.9}, cost=("c", 0.001, 2, 1))
    bent = ledger.withColumn("exit_fee", F.col("exit_fee") + 1)
    found = {r.check for r in tr.accounting_violations(
        curve, bent, ["run_id"], ["symbol"]).collect()}
    assert {"exit_fee", "equity_after_exit"} <= found


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 5000, p=[0.9, 0.1]),
                        "v": np.round(rng.normal(size=5000), 2)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v",
                          {"p5": 0.05, "m": 0.5, "hi": 1.0}, cuts=8).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, ["p5", "m", "hi"]].astype(float),
                                   np.quantile(g.v, [0.05, 0.5, 1.0]), atol=1e-12)


def test_areas_with_ties(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.3).astype(int)
    p = np.round(np.clip(rng.random(500) * 0.8 + y * 0.2, 0, 1), 1)
    df = spark.createDataFrame(pd.DataFrame({"m": "x", "label": y, "probability_score": p}))
    got = cl.classification_metrics(cl.with_prediction(df), ["m"]).first()
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()
    assert math.isclose(got.roc_auc, wins, rel_tol=1e-12)
    points = [(0.0, 1.0)]
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        points.append((y[hit].sum() / y.sum(), y[hit].mean()))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))
    assert math.isclose(got.pr_auc, area, rel_tol=1e-12)
    assert got.tp + got.fp + got.tn + got.fn == 500


def test_single_class_has_no_areas(spark):
    df = spark.createDataFrame(pd.DataFrame({
        "m": "x", "label": [1, 1], "probability_score": [0.0, 1.0]}))
    got = cl.undefined_metrics(cl.classification_metrics(cl.with_prediction(df), ["m"])).first()
    assert got.roc_auc is None and got.undefined == ["ROC-AUC", "PR-AUC"]
    assert math.isclose(got.log_loss, -math.log(2.220446049250313e-16) / 2, rel_tol=1e-9)
    assert got.balanced_accuracy == 0.5
