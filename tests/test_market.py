"""Candles, contracts, features, labels and splits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoweft.functions import costs
from chronoweft.functions.timefns import timeframe_ms
from chronoweft.operators import candles as cd
from chronoweft.operators import quality as ql
from chronoweft.operators import splits as sp
from chronoweft.operators.features import technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.operators.positions import number_rows
from chronoweft.operators.recurrence import exponential_average
from chronoweft.schemas import SchemaMismatch
from chronoweft.settings import IndicatorSpec

COLUMNS = ["symbol", "timestamp", "open", "high", "low", "close", "volume"]


def candles(n=72, seed=42, symbol="A"):
    rng = np.random.default_rng(seed)
    i = np.arange(n)
    close = 100 + 0.01 * i + 2 * np.sin(i / 6) + rng.normal(0, 0.05, n)
    open_ = np.r_[close[0] - 0.1, close[:-1]]
    return pd.DataFrame({
        "symbol": symbol, "timestamp": pd.date_range("2026-01-01", periods=n, freq="h"),
        "open": open_, "high": np.maximum(open_, close) + 0.5,
        "low": np.minimum(open_, close) - 0.5, "close": close,
        "volume": 1000 + 10 * i + 50 * np.cos(i / 5),
    })


def test_timeframes_and_costs():
    assert timeframe_ms("15m") == 900_000 and timeframe_ms("1d") == 86_400_000
    for bad in ("0h", "1w", "h", "1.5h"):
        with pytest.raises(ValueError):
            timeframe_ms(bad)
    assert costs.bps_to_rate(5) == 0.0005
    assert math.isclose(costs.required_gross_return(0, 0, 0, 10), 0.001)
    assert costs.default_label_threshold() == 0.003105688415184993
    for bad in (dict(fee=1.0), dict(fee=-0.1)):
        with pytest.raises(ValueError):
            costs.required_gross_return(bad["fee"], 2, 1, 5)


def test_net_return_keeps_the_edge(spark):
    tau = costs.default_label_threshold()
    row = spark.range(1).select(
        costs.net_return(F.lit(tau), F.lit(0.001), F.lit(0.0003)).alias("edge"),
        costs.net_return(F.lit(-1.0), F.lit(0.001), F.lit(0.0003)).alias("bad")).first()
    assert math.isclose(row.edge, 0.0005, rel_tol=1e-12) and row.bad is None


def check_names(spark, pdf, as_of="2026-02-01"):
    found = ql.candle_violations(spark.createDataFrame(pdf[COLUMNS]), ["symbol"], "1h",
                                 F.lit(as_of).cast("timestamp"), chunk_rows=16)
    return {r.check for r in found.select("check").distinct().collect()}


def test_candle_contract(spark):
    good = candles()
    assert check_names(spark, good) == set()
    assert check_names(spark, good.drop(index=20)) == {"irregular_interval"}
    assert check_names(spark, pd.concat([good, good.iloc[[5]]])) == {"duplicate_timestamp"}
    shifted = good.assign(timestamp=good.timestamp + pd.Timedelta("30min"))
    assert check_names(spark, shifted) == {"off_grid"}
    assert "high_below_low" in check_names(spark, good.assign(high=good.low - 1))
    assert check_names(spark, good.assign(volume=-1.0)) == {"volume_negative"}
    assert check_names(spark, good, "2026-01-03 23:30:00") == {"final_bar_open"}
    assert "not_finite" in check_names(spark, good.assign(volume=np.inf))


def test_update_new_row_wins(spark):
    old, new = candles(30), candles(40).iloc[20:].assign(close=7.0)
    as_of = F.lit("2026-03-01").cast("timestamp")
    a, b = spark.createDataFrame(old), spark.createDataFrame(new)
    merged = cd.merge_update(a, b, ["symbol"], "1h", as_of).toPandas().sort_values("timestamp")
    assert len(merged) == 40 and (merged.close.to_numpy()[20:] == 7.0).all()
    report = cd.update_report(a, b, ["symbol"], "1h", as_of).first()
    assert (report.stored_rows, report.fetched_rows, report.duplicates_removed) == (30, 20, 10)


def test_digest_ignores_order(spark):
    df = spark.createDataFrame(candles())
    again = df.orderBy(F.rand(1)).repartition(5)
    a = cd.content_digest(df, ["symbol"]).first().digest
    assert a == cd.content_digest(again, ["symbol"]).first().digest
    changed = df.withColumn("close", F.col("close") + F.when(F.hour("timestamp") == 3, 1e-3)
                            .otherwise(0))
    assert a != cd.content_digest(changed, ["symbol"]).first().digest


def reference_features(g):
    c, h, lo = (g[x].reset_index(drop=True) for x in ("close", "high", "low"))

    def ema(s, n):
        return s.ewm(span=n, min_periods=n, adjust=False).mean()

    macd = ema(c, 12) - ema(c, 26)
    d = c.diff()
    up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    dn = (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    rsi = pd.Series(np.where(dn == 0, 100, 100 - 100 / (1 + up / dn))).where(up.notna())
    stoch = (rsi - rsi.rolling(14).min()) / (rsi.rolling(14).max() - rsi.rolling(14).min())
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    atr = np.zeros(len(c))
    atr[13] = tr[:14].mean()
    for i in range(14, len(c)):
        atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
    return pd.DataFrame({"ema_short": ema(c, 9), "ema_long": ema(c, 21), "macd": macd,
                         "macd_signal": ema(macd, 9), "rsi": rsi, "stoch_rsi": stoch, "atr": atr})


@pytest.mark.parametrize("chunk_rows", [64, 100, 2048])
def test_features_match_the_sequential_definition(spark, chunk_rows):
    pdf = candles(700)
    out = technical_features(spark.createDataFrame(pdf), chunk_rows=chunk_rows).toPandas()
    out = out.sort_values("pos")
    assert out.pos.min() == IndicatorSpec().minimum_rows - 1 == 33
    want = reference_features(pdf).iloc[33:]
    for c in want:
        np.testing.assert_allclose(out[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_the_future_does_not_change_features(spark):
    pdf = candles(150)
    later = pdf.copy()
    later.loc[101:, ["open", "high", "low", "close"]] *= 3
    later.loc[101:, "volume"] *= 7
    a, b = (technical_features(spark.createDataFrame(x), chunk_rows=64).filter("pos <= 100")
            .orderBy("pos").toPandas() for x in (pdf, later))
    pd.testing.assert_frame_equal(a, b)


def test_warmup_ends_at_one_position_for_any_chunk(spark):
    pdf = candles(400)
    pdf.loc[:170, "volume"] = 0.0
    found = [technical_features(spark.createDataFrame(pdf), chunk_rows=n).toPandas()["pos"]
             for n in (64, 128, 2048)]
    assert all(sorted(f) == sorted(found[0]) for f in found)
    assert 150 < found[0].min() < 250
    pdf["volume"] = 0.0
    assert technical_features(spark.createDataFrame(pdf), chunk_rows=64).count() == 0


def test_label_columns_are_refused(spark):
    df = spark.createDataFrame(candles().assign(label=1))
    with pytest.raises(SchemaMismatch):
        technical_features(df)


def test_exponential_average_over_chunks(spark):
    x = np.random.default_rng(3).normal(size=1500)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "pos": range(1500), "x": x}))
    got = exponential_average(df, ["k"], "x", 9, chunk_rows=128).orderBy("pos").toPandas().ema
    want = pd.Series(x).ewm(span=9, min_periods=9, adjust=False).mean()
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("tau,label", [(0.031, 0), (0.029, 1)])
def test_manual_labels(spark, tau, label):
    pdf = pd.DataFrame({
        "symbol": "A", "pos": range(6), "open": [99.0, 100, 101, 103, 102, 105],
        "timestamp": pd.date_range("2026-02-01", periods=6, freq="h")})
    rows = next_open_labels(spark.createDataFrame(pdf), horizon=2, minimum_return=tau,
                            chunk_rows=4).orderBy("pos").collect()
    assert len(rows) == 3
    assert (rows[0].entry_open, rows[0].exit_open, rows[0].label) == (100, 103, label)
    assert math.isclose(rows[0].gross_forward_return, 0.03)


@pytest.mark.parametrize("n,sizes", [(100, (75, 5, 20)), (101, (75, 5, 21))])
def test_split_sizes_and_folds(spark, n, sizes):
    ts = pd.date_range("2025-01-01", periods=n, freq="h")
    df = spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "timestamp": ts, "exit_timestamp": ts + pd.Timedelta("5h"),
        "label": np.arange(n) % 2}))
    split = sp.assign_partitions(df, ["symbol"])
    count = {r.partition: r["count"] for r in split.groupBy("partition").count().collect()}
    assert (count["development"], count["boundary_purge"], count["holdout"]) == sizes
    folds = sp.assign_folds(split, ["symbol"], n_splits=3, test_ratio=0.1)
    ranges = sp.fold_ranges(folds, ["symbol"]).filter("role = 'validation'").orderBy("fold")
    starts = [(r.start_position, r.end_position) for r in ranges.collect()]
    assert starts == [(54, 60), (61, 67), (68, 74)]
    assert sp.split_violations(split, folds, ["symbol"]).count() == 0
    leaky = sp.assign_folds(split.withColumn(
        "exit_timestamp", F.col("timestamp") + F.expr("INTERVAL 9 HOURS")), ["symbol"], n_splits=3)
    assert sp.split_violations(split, leaky, ["symbol"]).count() == 3


def test_positions_do_not_depend_on_blocks(spark):
    df = spark.createDataFrame(candles(300).drop(index=list(range(40, 90))))
    a = number_rows(df, ["symbol"], block_seconds=3 * 3600).select("timestamp", "pos")
    b = number_rows(df, ["symbol"]).select("timestamp", "pos")
    assert a.exceptAll(b).count() == 0 and a.agg(F.max("pos")).first()[0] == 249
