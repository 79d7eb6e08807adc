"""Exact binary-classification metrics per group (model, fold, …)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.quantiles import ordered_totals

DOUBLE_EPS = 2.220446049250313e-16
UNDEFINED = {"roc_auc": "ROC-AUC", "pr_auc": "PR-AUC"}


def with_prediction(scores: DataFrame, threshold: float = settings.SIGNAL_THRESHOLD) -> DataFrame:
    """Add the 0/1 signal: probability at or above the threshold."""
    return scores.withColumn("signal", (F.col("probability_score") >= threshold).cast("tinyint"))


def rank_areas(scores: DataFrame, by: Sequence[str], *, label: str = "label",
               score: str = "probability_score", cuts: int = 64) -> DataFrame:
    """ROC and precision–recall areas with exact treatment of ties; null for a single class.

    Rows first collapse to one per distinct score. Running counts stay inside quantile buckets, so
    no task orders a whole group.
    """
    by = list(by)
    y = F.col(label)
    distinct = scores.groupBy(*by, F.col(score).alias("_s")).agg(
        F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_q")
    )
    run = ordered_totals(distinct, by, "_s", ["_p", "_q"], cuts=cuts)
    tp, fp, p, q = (F.col(c) for c in ("cum__p", "cum__q", "_p", "_q"))
    now = tp / (tp + fp)
    prior = F.when(tp + fp == p + q, 1.0).otherwise(F.try_divide(tp - p, tp + fp - p - q))
    sums = run.groupBy(*by).agg(
        F.sum(q * (tp * 2 - p)).alias("_roc"), F.sum(p * (now + prior)).alias("_pr"),
        F.sum(p).alias("_P"), F.sum(q).alias("_N"),
    )
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    return sums.select(
        *by,
        F.when(both, F.col("_roc") / (F.lit(2.0) * F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.when(both, F.col("_pr") / (F.lit(2.0) * F.col("_P"))).alias("pr_auc"),
    )


def threshold_metrics(scores: DataFrame, by: Sequence[str], *, label: str = "label",
                      score: str = "probability_score", predicted: str = "signal",
                      rollup: bool = False) -> DataFrame:
    """Confusion counts, accuracies, precision/recall/F1 of both classes, log loss, Brier.

    ``rollup`` also aggregates over every prefix of ``by`` (pooled rows have null group columns).
    """
    y, p, hat = F.col(label).cast("int"), F.col(score), F.col(predicted).cast("int")
    truth = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    clipped = F.least(F.greatest(truth, F.lit(DOUBLE_EPS)), F.lit(1.0 - DOUBLE_EPS))
    group = scores.rollup(*by) if rollup else scores.groupBy(*by)
    n = group.agg(
        F.count_if((y == 1) & (hat == 1)).alias("tp"),
        F.count_if((y == 0) & (hat == 1)).alias("fp"),
        F.count_if((y == 0) & (hat == 0)).alias("tn"),
        F.count_if((y == 1) & (hat == 0)).alias("fn"),
        F.avg(-F.log(clipped)).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hit1, hit0 = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return n.withColumns({
        "accuracy": share(tp + tn, total),
        "balanced_accuracy": F.coalesce((hit1 + hit0) / 2.0, hit1, hit0),
        "precision_class_1": share(tp, tp + fp), "recall_class_1": share(tp, tp + fn),
        "f1_class_1": share(tp * 2, tp * 2 + fp + fn),
        "precision_class_0": share(tn, tn + fn), "recall_class_0": share(tn, tn + fp),
        "f1_class_0": share(tn * 2, tn * 2 + fp + fn),
        "positive_label_rate": share(tp + fn, total),
        "predicted_positive_rate": share(tp + fp, total),
        "confusion_matrix": F.array(F.array(tn, fp), F.array(fn, tp)),
    })


def classification_metrics(scores: DataFrame, by: Sequence[str], **columns) -> DataFrame:
    """The complete metric row per group."""
    areas = {k: v for k, v in columns.items() if k in ("label", "score")}
    return threshold_metrics(scores, by, **columns).join(
        rank_areas(scores, by, **areas), list(by), "left"
    )


def fold_and_pooled_metrics(scores: DataFrame, model: str = "model",
                            fold: str = "fold") -> DataFrame:
    """Metrics of every fold and of all folds pooled (``fold`` null)."""
    pooled = scores.withColumn(
        fold, F.explode(F.array(F.col(fold).cast("int"), F.lit(None).cast("int")))
    ).withColumn("_fold", F.coalesce(F.col(fold), F.lit(-1)))
    out = classification_metrics(pooled, [model, "_fold"])
    return out.withColumn(fold, F.when(F.col("_fold") >= 0, F.col("_fold"))).drop("_fold")


def undefined_metrics(metrics: DataFrame) -> DataFrame:
    """Add the list of metrics a group cannot have (a single class in the sample)."""
    return metrics.withColumn("undefined", F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), name) for c, name in UNDEFINED.items()
    ])))


def metric_spans(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each metric over the folds; nulls are left out."""
    return metrics.groupBy(*by).agg(*[
        a for c in columns for a in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))
    ])


def json_ready(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null in every double column."""
    from chronoweft.operators.features import finite

    return df.select(*[
        finite(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes
    ])
