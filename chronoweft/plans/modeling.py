"""Registered queries over classifier scores and fold models."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import calendar_splits as cs
from chronoweft.operators import classification as cl
from chronoweft.operators import models as md
from chronoweft.operators import splits as sp
from chronoweft.operators.features import technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.operators.quantiles import exact_quantiles
from chronoweft.plans.common import (
    CHUNK, hourly, pseudo_score, query, r, sql_candles, sql_score, table, tidy,
)
from chronoweft.plans.market_data import FOLDS_SQL, LABELS_SQL, SPLIT_SQL, labeled
from chronoweft.session import materialise, scratch_path
from chronoweft.settings import IndicatorSpec
from chronoweft.sources.candle_files import write_run_table

ABLATION_TREES = 20
METRICS = [
    "accuracy", "balanced_accuracy", "precision_class_1", "recall_class_1", "f1_class_1",
    "precision_class_0", "recall_class_0", "f1_class_0", "log_loss", "brier_score", "roc_auc",
    "pr_auc", "positive_label_rate", "predicted_positive_rate",
]


def oof_scores(spark, sf):
    """Validation rows of every fold with a coarse (tied) deterministic score."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    rows = sp.assign_folds(split, ["symbol"]).filter(F.col("role") == "validation")
    scored = rows.withColumn("probability_score", F.round(pseudo_score(), 2))
    return cl.with_prediction(scored).withColumn("model", F.col("symbol"))


OOF_SQL = f"""
oof AS (SELECT symbol AS model, fold, label AS y, round({sql_score()}, 2) AS p FROM roles
        WHERE role = 'validation'),
pool AS (SELECT model, unnest([fold, NULL]) AS fold, y, p FROM oof),
conf AS (
  SELECT model, fold, count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp,
    count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn,
    count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn,
    avg(-ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16),
                  1 - 2.220446049250313e-16))) AS log_loss,
    avg((p - y) * (p - y)) AS brier_score FROM pool GROUP BY 1, 2),
thr AS (
  SELECT model, fold, p, sum(y) AS a, sum(1 - y) AS b FROM pool GROUP BY 1, 2, 3),
cum AS (
  SELECT *, sum(a) OVER w AS ta, sum(b) OVER w AS tb FROM thr
  WINDOW w AS (PARTITION BY model, fold ORDER BY p DESC)),
area AS (
  SELECT model, fold,
    CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(b * (2 * ta - a)) / (2.0 * sum(a) * sum(b)) END AS roc_auc,
    CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * (ta / (ta + tb)::DOUBLE +
      CASE WHEN ta + tb = a + b THEN 1 ELSE (ta - a) / (ta + tb - a - b)::DOUBLE END)) / (2.0 * sum(a)) END
      AS pr_auc
  FROM cum GROUP BY 1, 2),
m AS (
  SELECT c.*, roc_auc, pr_auc, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy,
    CASE WHEN tp + fn = 0 THEN tn / (tn + fp)::DOUBLE WHEN tn + fp = 0 THEN tp / (tp + fn)::DOUBLE
         ELSE (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 END AS balanced_accuracy,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision_class_1,
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall_class_1,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1_class_1,
    CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn)::DOUBLE END AS precision_class_0,
    CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp)::DOUBLE END AS recall_class_0,
    CASE WHEN 2 * tn + fp + fn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn)::DOUBLE END AS f1_class_0,
    (tp + fn) / (tp + fp + tn + fn)::DOUBLE AS positive_label_rate,
    (tp + fp) / (tp + fp + tn + fn)::DOUBLE AS predicted_positive_rate
  FROM conf c JOIN area a ON a.model = c.model AND a.fold IS NOT DISTINCT FROM c.fold)"""


@query("fold_classification_metrics", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}, {FOLDS_SQL}, {OOF_SQL}
SELECT model, fold::BIGINT AS fold, tp, fp, tn, fn, {', '.join(f'{r(c)} AS {c}' for c in METRICS)} FROM m""")
def fold_classification_metrics(spark, sf):
    """Metrics of every fold and pooled, tied scores included."""
    out = cl.fold_and_pooled_metrics(oof_scores(spark, sf))
    return tidy(out.select("model", "fold", "tp", "fp", "tn", "fn", *METRICS))


@query("fold_stability", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}, {FOLDS_SQL}, {OOF_SQL}
SELECT model, {r('min(roc_auc)')} AS min_roc_auc, {r('max(roc_auc)')} AS max_roc_auc,
       {r('min(recall_class_1)')} AS min_recall_class_1, {r('max(recall_class_1)')} AS max_recall_class_1
FROM m WHERE fold IS NOT NULL GROUP BY 1""")
def fold_stability(spark, sf):
    """Span of metrics over folds."""
    scores = oof_scores(spark, sf)
    per_fold = cl.classification_metrics(scores, ["model", "fold"])
    return tidy(cl.metric_spans(per_fold, ["model"], ["roc_auc", "recall_class_1"]))


@query("undefined_metrics", """
WITH x AS (SELECT source AS model, lang AS fold, l.toxic AS y FROM labels l JOIN documents USING (doc_id))
SELECT model, fold, CASE WHEN count(DISTINCT y) < 2 THEN 'ROC-AUC,PR-AUC' ELSE '' END AS undefined
FROM x GROUP BY 1, 2""")
def undefined_metrics(spark, sf):
    """Groups whose areas do not exist because only one class was seen."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("source").alias("model"), F.col("lang").alias("fold"),
        F.col("toxic").alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("probability_score"))
    out = cl.undefined_metrics(cl.classification_metrics(
        cl.with_prediction(rows), ["model", "fold"]))
    return out.select("model", "fold", F.array_join("undefined", ",").alias("undefined"))


@query("json_safe_metrics", """
SELECT o_orderpriority AS priority,
       CASE WHEN stddev_samp(o_totalprice) > 0 THEN round(avg(o_totalprice), 2) END AS mean_price,
       NULL::DOUBLE AS undefined_ratio FROM orders GROUP BY 1""")
def json_safe_metrics(spark, sf):
    """NaN and infinity become null before metric rows are written as JSON."""
    out = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("mean_price"),
        F.sum(F.lit(float("nan"))).alias("undefined_ratio"))
    return cl.json_ready(out)


@query("exact_quantiles", """
SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1""")
def exact_quantiles_query(spark, sf):
    """Interpolated quantiles without sorting a whole group in one task."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"),
                                               "l_extendedprice")
    return tidy(exact_quantiles(rows, ["flag"], "l_extendedprice",
                                {"p05": 0.05, "median": 0.5, "p95": 0.95}), 4)


CALENDAR_SQL = """
cal AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS m
        FROM (SELECT DISTINCT t FROM labeled)),
cut AS (
  SELECT hs, hs - 5 AS nd, greatest(1, floor((hs - 5) * 0.1)::BIGINT) AS sz
  FROM (SELECT max(m) - greatest(1, ceil(max(m) * 0.2))::BIGINT AS hs FROM cal)),
fold AS (
  SELECT f AS fold, nd - sz * (6 - f) AS vs, sz, hs, nd FROM cut, (SELECT unnest(range(1, 6)) AS f)),
fold_time AS (
  SELECT fold, (SELECT t FROM cal WHERE p = vs - 5 AND vs - 5 > 0) AS t_train,
         (SELECT t FROM cal WHERE p = vs AND vs - 5 > 0) AS t_start,
         (SELECT t FROM cal WHERE p = vs + sz AND vs - 5 > 0) AS t_end,
         (SELECT t FROM cal WHERE p = nd) AS t_purge, (SELECT t FROM cal WHERE p = hs) AS t_hold
  FROM fold),
pooled AS (
  SELECT fold, symbol, t, t_exit, label,
         CASE WHEN t >= t_purge OR t_exit >= t_hold THEN NULL
              WHEN t < t_train AND t_exit < t_start THEN 'train'
              WHEN t < t_start THEN 'gap' WHEN t < t_end THEN 'validation' END AS role
  FROM fold_time LEFT JOIN labeled ON true)"""


def labeled_features(spark, sf):
    """Features and labels of all series, written once and read by every fit."""
    feats = technical_features(hourly(spark, sf), ["symbol"], chunk_rows=CHUNK)
    return materialise(next_open_labels(feats, ["symbol"], chunk_rows=CHUNK), "labeled")


@query("pooled_fold_leaks", f"""
WITH {sql_candles()}, {LABELS_SQL}, {CALENDAR_SQL}
SELECT fold::BIGINT AS fold, count(*) FILTER (WHERE role = 'train') AS train_rows,
       count(*) FILTER (WHERE role = 'validation') AS validation_rows,
       max(t_exit) FILTER (WHERE role = 'train') AS last_training_exit,
       min(t) FILTER (WHERE role = 'validation') AS first_validation,
       CASE WHEN count(*) FILTER (WHERE role = 'train') = 0
              OR count(*) FILTER (WHERE role = 'validation') = 0 THEN 'insufficient_rows'
            WHEN max(t_exit) FILTER (WHERE role = 'train') >=
                 min(t) FILTER (WHERE role = 'validation') THEN 'label_leak' ELSE 'ok' END AS status
FROM pooled GROUP BY 1""")
def pooled_fold_leaks(spark, sf):
    """Boundaries of every pooled fold over all series; training has ended before validation begins."""
    rows = labeled(spark, sf)
    return tidy(cs.pooled_leaks(rows, cs.calendar_plan(rows)))


@query("pooled_fold_rows", f"""
WITH {sql_candles()}, {LABELS_SQL}, {CALENDAR_SQL}
SELECT symbol, fold::BIGINT AS fold, role, count(*) AS row_count, min(t) AS start_timestamp,
       max(t) AS end_timestamp, max(t_exit) AS max_exit_timestamp, sum(label)::BIGINT AS positives
FROM pooled WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def pooled_fold_rows(spark, sf):
    """What every series gives to each role of the pooled folds."""
    rows = labeled(spark, sf)
    folds = cs.calendar_folds(rows, cs.calendar_plan(rows))
    return tidy(folds.groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("timestamp").alias("start_timestamp"),
        F.max("timestamp").alias("end_timestamp"),
        F.max("exit_timestamp").alias("max_exit_timestamp"),
        F.sum(F.col("label").cast("bigint")).alias("positives")))


@query("fold_status", f"""
WITH {sql_candles()}, {LABELS_SQL}, {SPLIT_SQL}
SELECT symbol, f AS fold, greatest(0, vs - 5)::BIGINT AS train_rows,
       CASE WHEN vs - 5 > 0 THEN 'ok' ELSE 'insufficient_rows' END AS status
FROM (SELECT symbol, f::BIGINT AS f, nd - greatest(1, floor(nd * 0.1)::BIGINT) * (6 - f) AS vs
      FROM (SELECT symbol, greatest(0, max(nd)) AS nd FROM split GROUP BY 1),
           (SELECT unnest(range(1, 6)) AS f))""")
def fold_status(spark, sf):
    """Every planned fold of every series, those without room included."""
    split = sp.assign_partitions(labeled(spark, sf), ["symbol"])
    return tidy(cs.fold_status(split, ["symbol"]))


@query("logistic_walk_forward", None)
def logistic_walk_forward(spark, sf):
    """Out-of-fold logistic probabilities over all series; every fold has its own scaler and model."""
    rows = labeled_features(spark, sf)
    return tidy(md.pooled_walk_forward(rows, cs.calendar_plan(rows), IndicatorSpec().feature_columns,
                                       md.logistic_factory, keep=["symbol", "timestamp"]))


@query("boosted_walk_forward", None)
def boosted_walk_forward(spark, sf):
    """Out-of-fold boosted-tree probabilities over all series, 300 trees per fold."""
    rows = labeled_features(spark, sf)
    return tidy(md.pooled_walk_forward(rows, cs.calendar_plan(rows), IndicatorSpec().feature_columns,
                                       md.boosted_factory(), keep=["symbol", "timestamp"]))


@query("feature_importance", None)
def feature_importance(spark, sf):
    """Ten strongest features of a boosted model fitted on all development rows."""
    columns = IndicatorSpec().feature_columns
    rows = labeled_features(spark, sf)
    plan = cs.calendar_plan(rows)
    model = md.fit(rows.filter(cs.partition_of(plan) == "development"), columns, md.boosted_factory())
    return tidy(md.top_features(md.feature_importance(model, columns)))


@query("holdout_scoring", None)
def holdout_scoring(spark, sf):
    """Model fitted on development, saved, loaded again and applied to the untouched holdout."""
    from pyspark.ml import PipelineModel

    columns = IndicatorSpec().feature_columns
    rows = labeled_features(spark, sf)
    part = cs.partition_of(cs.calendar_plan(rows))
    fitted = md.fit(rows.filter(part == "development"), columns, md.logistic_factory)
    path = scratch_path(spark, "model")
    fitted.save(path)
    scored = md.score(PipelineModel.load(path), rows.filter(part == "holdout")).select(
        "symbol", "timestamp", "label", "probability_score", "signal")
    root = scratch_path(spark, "runs")
    write_run_table(scored, root, "holdout_scores", "run-1")
    return tidy(scored)


@query("ablation_cells", """
SELECT 'ALL'::VARCHAR AS symbol, 0::BIGINT AS timestamp, 0::BIGINT AS fold, 0::BIGINT AS actual_label,
       0::BIGINT AS copies WHERE false""")
def ablation_cells(spark, sf):
    """Technical against technical-plus-news cells on identical rows; empty when matched."""
    from chronoweft.operators.sentiment import NEWS_FEATURES, news_features
    from chronoweft.plans.news import versions_table

    rows = labeled_features(spark, sf)
    decisions = rows.select(F.col("timestamp").alias("decision_at")).distinct()
    news = news_features(decisions, versions_table(spark, sf)).select(
        F.col("decision_at").alias("timestamp"),
        *[F.col(c).cast("double").alias(c) for c in NEWS_FEATURES])
    joined = materialise(rows.join(news, "timestamp", "left"), "cells")
    cells = md.ablation_cells(
        joined, cs.calendar_plan(joined), IndicatorSpec().feature_columns, NEWS_FEATURES,
        {"logistic": md.logistic_factory, "boosted": md.boosted_factory(trees=ABLATION_TREES)},
        keep=["symbol", "timestamp"])
    return tidy(md.cell_differences(materialise(cells, "predictions"), ["symbol", "timestamp"]))
