"""Fold isolation, determinism and one-class folds."""

import numpy as np
import pandas as pd
import pytest

from chronoweft.operators import calendar_splits as cs
from chronoweft.operators import models as md
from chronoweft.operators import splits as sp


def folds(spark, labels):
    n = len(labels)
    ts = pd.date_range("2025-01-01", periods=n, freq="h")
    x = np.arange(n)
    df = spark.createDataFrame(pd.DataFrame({
        "symbol": "A", "timestamp": ts, "exit_timestamp": ts + pd.Timedelta("5h"),
        "label": labels, "f1": np.sin(x / 3), "f2": np.cos(x / 5)}))
    split = sp.assign_partitions(df, ["symbol"], holdout_ratio=0.2)
    return sp.assign_folds(split, ["symbol"], n_splits=2).cache()


def predict(spark, table, factory):
    out = md.walk_forward(table, ["f1", "f2"], factory, keep=["symbol", "timestamp"], n_splits=2)
    return out.toPandas().sort_values("timestamp").reset_index(drop=True)


@pytest.mark.parametrize("factory", [md.logistic_factory, md.boosted_factory(trees=2)])
def test_predictions_ignore_later_rows(spark, factory):
    y = (np.arange(100) % 3 == 0).astype(int)
    table = folds(spark, y)
    a, b = predict(spark, table, factory), predict(spark, table, factory)
    pd.testing.assert_frame_equal(a, b)
    changed = y.copy()
    changed[70:] = 1 - changed[70:]
    c = predict(spark, folds(spark, changed), factory)
    np.testing.assert_allclose(a[a.fold == 1].probability_score,
                               c[c.fold == 1].probability_score, rtol=1e-9)


def test_one_class_training_gives_a_constant(spark):
    out = predict(spark, folds(spark, np.ones(100, int)), md.logistic_factory)
    assert (out.probability_score == 1.0).all() and (out.signal == 1).all()


def test_importance_and_schema_hash(spark):
    table = folds(spark, (np.arange(100) % 3 == 0).astype(int)).filter("fold = 2")
    model = md.fit(table, ["f1", "f2"], md.boosted_factory(trees=2))
    rows = md.feature_importance(model, ["f1", "f2"]).orderBy("position").collect()
    assert [r.feature for r in rows] == ["f1", "f2"] and sum(r.gain for r in rows) > 0.99
    a, b = spark.range(1).select(md.feature_schema_hash(["a", "b"]),
                                 md.feature_schema_hash(["b", "a"])).first()
    assert a != b and len(a) == 64


def test_boosting_depends_on_rows_not_on_their_arrival(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"f1": rng.normal(size=300).round(2), "f2": rng.normal(size=300).round(2),
                         "label": rng.integers(0, 2, 300)})
    rows = pd.concat([rows, rows.head(40)])  # equal rows are interchangeable
    found = []
    for k, parts in enumerate((1, 3, 8)):
        table = spark.createDataFrame(rows.sample(frac=1, random_state=k)).repartition(parts)
        model = md.fit(table, ["f1", "f2"], md.boosted_factory(trees=4))
        found.append(md.score(model, spark.createDataFrame(rows)).toPandas().sort_values(
            ["f1", "f2"]).probability_score.to_numpy())
    np.testing.assert_allclose(found[0], found[1], rtol=1e-9)
    np.testing.assert_allclose(found[0], found[2], rtol=1e-9)


def sparse_series(spark):
    """Three series with holes of their own: a label may end days after its row."""
    rng = np.random.default_rng(9)
    out = []
    for symbol, share in (("A", 1.0), ("B", 0.5), ("C", 0.15)):
        hours = np.flatnonzero(rng.random(400) < share)
        ts = pd.Timestamp("2025-01-01") + pd.to_timedelta(hours, unit="h")
        out.append(pd.DataFrame({"symbol": symbol, "timestamp": ts[:-5], "exit_timestamp": ts[5:],
                                 "label": rng.integers(0, 2, len(ts) - 5)}))
    return pd.concat(out, ignore_index=True)


def test_pooled_folds_have_left_the_market(spark):
    rows = sparse_series(spark)
    table = spark.createDataFrame(rows)
    plan = cs.calendar_plan(table)
    leaks = cs.pooled_leaks(table, plan).toPandas()
    assert list(leaks.fold) == [1, 2, 3, 4, 5] and (leaks.status == "ok").all()
    folds = cs.calendar_folds(table, plan).toPandas()
    calendar = np.sort(rows.timestamp.unique())
    n = len(calendar)
    hold = n - int(np.ceil(n * 0.2))
    dev, size = hold - 5, int((hold - 5) * 0.1)
    for f in plan.folds:
        start = calendar[dev - size * (6 - f.number)]
        stop = calendar[dev - size * (6 - f.number) + size]
        gap = calendar[dev - size * (6 - f.number) - 5]
        kept = rows[(rows.timestamp < calendar[dev]) & (rows.exit_timestamp < calendar[hold])]
        train = kept[(kept.timestamp < gap) & (kept.exit_timestamp < start)]
        valid = kept[(kept.timestamp >= start) & (kept.timestamp < stop)]
        here = folds[folds.fold == f.number]
        assert (here.role == "train").sum() == len(train) and len(train)
        assert (here.role == "validation").sum() == len(valid) and len(valid)
        assert here[here.role == "train"].exit_timestamp.max() < here[
            here.role == "validation"].timestamp.min()


def test_folds_without_room_are_reported(spark):
    short = spark.createDataFrame(sparse_series(spark).query("symbol == 'A'").head(12))
    plan = cs.calendar_plan(short)
    status = cs.pooled_leaks(short, plan).orderBy("fold").toPandas().status.tolist()
    assert status[0] == "insufficient_rows" and len(status) == 5
    with pytest.raises(ValueError, match="does not fit"):
        md.pooled_walk_forward(short, plan, ["f1"], md.logistic_factory, keep=["timestamp"])
    per = cs.fold_status(sp.assign_partitions(short, ["symbol"]), ["symbol"]).count()
    assert per == 5
    empty = cs.calendar_plan(short.limit(0))
    assert empty.instants == 0 and not any(f.possible for f in empty.folds)
    assert cs.pooled_leaks(short.limit(0), empty).count() == 5
