"""Chronological splits shared by all series: one calendar, purged by the exit time of every row.

Splits by position within a series do not line up in time: pooled over series, one series would train on
hours that another is validated on. Here every boundary is an instant of the common calendar.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft import settings
from chronoweft.operators.positions import number_rows
from chronoweft.operators.splits import _check, _ratio

UTC = dt.timezone.utc


@dataclass(frozen=True)
class Fold:
    """Validation instants ``[start, end)``; training ends ``gap`` instants earlier at ``train_end``."""

    number: int
    train_end: dt.datetime | None
    start: dt.datetime | None
    end: dt.datetime | None

    @property
    def possible(self) -> bool:
        return self.train_end is not None


@dataclass(frozen=True)
class CalendarPlan:
    """Boundaries of a pooled split. A boundary that the calendar is too short for is ``None``."""

    instants: int
    purge_start: dt.datetime | None
    holdout_start: dt.datetime | None
    folds: tuple[Fold, ...]


def calendar_plan(labeled: DataFrame, *, holdout_ratio: float = settings.FINAL_HOLDOUT_RATIO,
                  n_splits: int = settings.N_WALK_FORWARD_SPLITS,
                  test_ratio: float = settings.WALK_FORWARD_TEST_RATIO,
                  gap_rows: int = settings.PURGE_GAP_ROWS,
                  lookahead_rows: int = settings.LABEL_LOOKAHEAD_ROWS) -> CalendarPlan:
    """The rules of the per-series split, counted in distinct instants over all series.

    Instants are numbered per time block; what comes back is one row of boundaries, whatever the input.
    """
    _ratio("holdout_ratio", holdout_ratio)
    _ratio("test_ratio", test_ratio)
    _check("n_splits", n_splits)
    _check("gap_rows", gap_rows, settings.LABEL_LOOKAHEAD_ROWS)
    _check("lookahead_rows", lookahead_rows, settings.LABEL_LOOKAHEAD_ROWS)
    instants = number_rows(
        labeled.select("timestamp").distinct().withColumn("_all", F.lit(0)), ["_all"], count="_n")
    n, pos = F.col("_n"), F.col("pos")
    holdout = n - F.greatest(F.lit(1), F.ceil(n * F.lit(holdout_ratio)))
    purge = holdout - lookahead_rows
    size = F.greatest(F.lit(1), F.floor(purge * F.lit(test_ratio)))

    def at(position: Column) -> Column:
        return F.unix_micros(F.min(F.when(pos == position, F.col("timestamp"))))

    wanted = {"instants": F.max("_n"), "purge": at(purge), "holdout": at(holdout)}
    for k in range(1, n_splits + 1):
        start = purge - size * (n_splits - k + 1)
        fits = start - gap_rows > 0
        wanted |= {f"train_end{k}": at(F.when(fits, start - gap_rows)),
                   f"start{k}": at(F.when(fits, start)), f"end{k}": at(F.when(fits, start + size))}
    row = instants.agg(*[c.alias(name) for name, c in wanted.items()]).first()

    def instant(name: str) -> dt.datetime | None:
        micros = row[name]
        return None if micros is None else (
            dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=micros))

    return CalendarPlan(row["instants"] or 0, instant("purge"), instant("holdout"), tuple(
        Fold(k, instant(f"train_end{k}"), instant(f"start{k}"), instant(f"end{k}"))
        for k in range(1, n_splits + 1)))


def partition_of(plan: CalendarPlan) -> Column:
    """``development``, ``boundary_purge`` or ``holdout`` of a row.

    A row before the holdout whose label ends in it is purged, however long its series was silent.
    """
    if plan.purge_start is None:  # too short a calendar leaves nothing to develop on
        start = plan.holdout_start
        return F.when(F.lit(start is not None) & (F.col("timestamp") >= F.lit(start)), "holdout"
                      ).otherwise("boundary_purge")
    return (
        F.when(F.col("timestamp") >= F.lit(plan.holdout_start), "holdout")
        .when((F.col("timestamp") >= F.lit(plan.purge_start))
              | (F.col("exit_timestamp") >= F.lit(plan.holdout_start)), "boundary_purge")
        .otherwise("development")
    )


def role_in(plan: CalendarPlan, fold: Fold) -> Column:
    """``train``, ``gap`` or ``validation`` of a row in a fold, null where it takes no part.

    Training rows of every series have left the market before the first validation instant of any.
    """
    if not fold.possible:
        return F.lit(None).cast("string")
    ts = F.col("timestamp")
    return F.when(partition_of(plan) == "development", (
        F.when((ts < F.lit(fold.train_end)) & (F.col("exit_timestamp") < F.lit(fold.start)), "train")
        .when(ts < F.lit(fold.start), "gap")
        .when(ts < F.lit(fold.end), "validation")))


def calendar_folds(labeled: DataFrame, plan: CalendarPlan) -> DataFrame:
    """Rows of all folds with ``fold`` and ``role``; a row is copied once per fold it is in."""
    roles = [F.struct(F.lit(f.number).alias("fold"), role_in(plan, f).alias("role"))
             for f in plan.folds]
    return (
        labeled.withColumn("_f", F.explode(F.array(*roles)))
        .filter("_f.role is not null")
        .withColumns({"fold": F.col("_f.fold"), "role": F.col("_f.role")}).drop("_f")
    )


def pooled_leaks(labeled: DataFrame, plan: CalendarPlan) -> DataFrame:
    """One row per planned fold: sizes, boundary times over all series, and what is wrong with it.

    ``status`` is ``ok``, ``label_leak`` or, for a fold that the calendar has no room for,
    ``insufficient_rows``. All folds are read in one pass without copies.
    """
    parts = []
    for f in plan.folds:
        role = role_in(plan, f)
        train, valid = role == "train", role == "validation"
        parts.append(F.struct(
            F.lit(f.number).alias("fold"), F.count_if(train).alias("train_rows"),
            F.count_if(valid).alias("validation_rows"),
            F.max(F.when(train, F.col("exit_timestamp"))).alias("last_training_exit"),
            F.min(F.when(valid, F.col("timestamp"))).alias("first_validation")))
    rows = labeled.agg(F.array(*parts).alias("folds")).select(F.explode("folds").alias("f"))
    return rows.select("f.*").withColumn(
        "status", F.when((F.col("train_rows") == 0) | (F.col("validation_rows") == 0),
                         "insufficient_rows")
        .when(F.col("last_training_exit") >= F.col("first_validation"), "label_leak").otherwise("ok"))


def fold_status(split: DataFrame, keys: list[str], *,
                n_splits: int = settings.N_WALK_FORWARD_SPLITS,
                test_ratio: float = settings.WALK_FORWARD_TEST_RATIO,
                gap_rows: int = settings.PURGE_GAP_ROWS) -> DataFrame:
    """Every fold of the per-series plan, those that do not fit included.

    ``split`` comes from :func:`chronoweft.operators.splits.assign_partitions`.
    """
    per = split.groupBy(*keys).agg(F.max("n_development").alias("n_development"))
    n = F.col("n_development")
    size = F.greatest(F.lit(1), F.floor(n * F.lit(test_ratio)).cast("long"))
    start = n - size * (F.lit(n_splits + 1) - F.col("fold"))
    return per.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits)))).select(
        *keys, "fold", F.greatest(start - gap_rows, F.lit(0)).alias("train_rows"),
        F.when(start - gap_rows > 0, "ok").otherwise("insufficient_rows").alias("status"))
