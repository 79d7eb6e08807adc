"""Chronological, purged splits and their boundary tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.positions import number_rows


def _check(name: str, value: int, least: int = 1) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


def _ratio(name: str, value: float) -> None:
    if not math.isfinite(value) or not 0.0 < value < 1.0:
        raise ValueError(f"{name} must lie strictly between 0 and 1")


def assign_partitions(labeled: DataFrame, keys: Sequence[str], *,
                      holdout_ratio: float = settings.FINAL_HOLDOUT_RATIO,
                      lookahead_rows: int = settings.LABEL_LOOKAHEAD_ROWS) -> DataFrame:
    """Add ``pos``, ``partition`` and ``n_development`` to every labeled row.

    The newest ``max(1, ceil(n·ratio))`` rows are the holdout, the ``lookahead_rows`` before them
    are purged, everything older is development. Only the series lengths (one small row per time
    block) travel; rows are classified in place.
    """
    _ratio("holdout_ratio", holdout_ratio)
    _check("lookahead_rows", lookahead_rows, settings.LABEL_LOOKAHEAD_ROWS)
    n, pos = F.col("_n"), F.col("pos")
    holdout_start = n - F.greatest(F.lit(1), F.ceil(n * F.lit(holdout_ratio)))
    purge_start = holdout_start - lookahead_rows
    return (
        number_rows(labeled.drop("pos"), keys, count="_n")
        .withColumn(
            "partition",
            F.when(pos >= holdout_start, "holdout").when(pos >= purge_start, "boundary_purge")
            .otherwise("development"),
        )
        .withColumn("n_development", F.greatest(F.lit(0), purge_start).cast("long"))
        .drop("_n")
    )


def assign_folds(split: DataFrame, keys: Sequence[str], *,
                 n_splits: int = settings.N_WALK_FORWARD_SPLITS,
                 test_ratio: float = settings.WALK_FORWARD_TEST_RATIO,
                 gap_rows: int = settings.PURGE_GAP_ROWS) -> DataFrame:
    """Development rows once per fold they take part in, with ``fold`` and ``role``.

    Validation blocks are contiguous at the tail of development; training is everything before the
    gap. Pure arithmetic on ``pos``: no join, no shuffle.
    """
    _check("n_splits", n_splits)
    _check("gap_rows", gap_rows, settings.LABEL_LOOKAHEAD_ROWS)
    _ratio("test_ratio", test_ratio)
    n, pos = F.col("n_development"), F.col("pos")
    size = F.greatest(F.lit(1), F.floor(n * F.lit(test_ratio)).cast("long"))
    roles = []
    for fold in range(1, n_splits + 1):
        start = n - size * (n_splits - fold + 1)
        role = (
            F.when((pos >= start) & (pos < start + size), "validation")
            .when((pos >= start - gap_rows) & (pos < start), "gap")
            .when(pos < start - gap_rows, "train")
        )
        roles.append(F.when(role.isNotNull() & (start - gap_rows > 0), F.struct(
            F.lit(fold).alias("fold"), role.alias("role"))))
    return (
        split.filter(F.col("partition") == "development")
        .withColumn("_f", F.explode(F.array_compact(F.array(*roles))))
        .withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")})
        .drop("_f")
    )


def partition_ranges(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boundary record of each partition."""
    return split.groupBy(*keys, "partition").agg(*_range())


def fold_ranges(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boundary record of each fold and role."""
    return folds.groupBy(*keys, "fold", "role").agg(*_range())


def _range():
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.min("pos").alias("start_position"), F.max("pos").alias("end_position"),
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"),
        F.max("exit_timestamp").alias("max_exit_timestamp"),
    ]


def split_violations(split: DataFrame, folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaks and impossible sizes: a label that ends inside the data it must not see."""
    keys = list(keys)
    parts = split.groupBy(*keys).agg(
        F.max(F.when(F.col("partition") == "development", F.col("exit_timestamp"))).alias("_exit"),
        F.min(F.when(F.col("partition") == "holdout", F.col("timestamp"))).alias("_next"),
        F.max("n_development").alias("_n"),
    ).select(*keys, F.lit(0).alias("fold"), "_exit", "_next", F.col("_n").alias("_train"))
    per_fold = folds.groupBy(*keys, "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("exit_timestamp"))).alias("_exit"),
        F.min(F.when(F.col("role") == "validation", F.col("timestamp"))).alias("_next"),
        F.count_if(F.col("role") == "train").alias("_train"),
    )
    return parts.unionByName(per_fold).select(
        *keys, "fold",
        F.when(F.col("_train") <= 0, "insufficient_rows")
        .when(F.col("_exit") >= F.col("_next"), "label_leak").alias("check"),
    ).filter("check is not null")


def training_classes(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Labels present in each training fold; one class means a constant forecast."""
    return (
        folds.filter(F.col("role") == "train").groupBy(*keys, "fold")
        .agg(F.array_sort(F.collect_set(F.col("label").cast("int"))).alias("classes"),
             F.count(F.lit(1)).alias("train_rows"))
        .withColumn("one_class", F.size("classes") == 1)
    )
