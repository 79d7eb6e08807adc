"""Contracts as queries: every broken rule becomes a row of a violation table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.functions.timefns import timeframe_ms, timestamp_to_utc_text
from chronoweft.operators.positions import (
    CHUNK, OWN, chunk_window, number_rows, spread_to_chunks,
)
from chronoweft.schemas import CANDLE_COLUMNS, PRICE_COLUMNS, require_columns


class ContractViolation(ValueError):
    """A strict check found at least one violation."""


def _bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def violations(df: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column, Column]],
               ts: str = "timestamp") -> DataFrame:
    """One pass over the rows; emits ``(keys, check, timestamp, detail)`` per broken rule."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)),
               F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
        for name, bad, detail in checks
    ]))
    return (
        df.withColumn("_v", F.explode(found))
        .select(*keys, F.col("_v.check").alias("check"), F.col(ts).alias("timestamp"),
                F.col("_v.detail").alias("detail"))
    )


def _value_checks() -> list[tuple[str, Column, Column]]:
    none = F.lit(None).cast("string")
    out = []
    for c in CANDLE_COLUMNS[1:]:
        out.append(("not_finite", _bad_number(F.col(c)), F.lit(c)))
    for c in PRICE_COLUMNS:
        out.append(("price_not_positive", F.col(c) <= 0.0, F.lit(c)))
    out += [
        ("volume_negative", F.col("volume") < 0.0, none),
        ("high_below_low", F.col("high") < F.col("low"), none),
        ("open_outside_range",
         (F.col("open") < F.col("low")) | (F.col("open") > F.col("high")), none),
        ("close_outside_range",
         (F.col("close") < F.col("low")) | (F.col("close") > F.col("high")), none),
    ]
    return out


def candle_violations(df: DataFrame, keys: Sequence[str], timeframe: str, as_of: Column, *,
                      chunk_rows: int = 8192) -> DataFrame:
    """The whole candle contract: values, grid, duplicates, spacing, final bar closed.

    Missing bars are reported (expected against received), never filled.
    """
    require_columns(df, [*keys, *CANDLE_COLUMNS])
    step = timeframe_ms(timeframe) * 1000
    numbered = number_rows(df, keys, count="_n")
    w = chunk_window(keys)
    rows = (
        spread_to_chunks(numbered, chunk_rows, before=1)
        .withColumn("_t", F.unix_micros("timestamp"))
        .withColumn("_gap", F.col("_t") - F.lag("_t", 1).over(w))
        .filter(OWN)
    )
    expected = F.timestamp_micros(F.col("_t") - F.col("_gap") + F.lit(step))
    spacing = F.concat(
        F.lit("expected "), timestamp_to_utc_text(expected),
        F.lit(" received "), timestamp_to_utc_text(F.col("timestamp")),
    )
    none = F.lit(None).cast("string")
    checks = [
        *_value_checks(),
        ("timestamp_missing", F.col("timestamp").isNull(), none),
        ("duplicate_timestamp", F.col("_gap") == 0, none),
        ("off_grid", F.pmod(F.col("_t"), F.lit(step)) != 0, F.lit(timeframe)),
        ("irregular_interval", (F.col("_gap") != step) & (F.col("_gap") != 0), spacing),
        ("final_bar_open",
         (F.col("pos") == F.col("_n") - 1) & (F.col("_t") + F.lit(step) > F.unix_micros(as_of)),
         none),
    ]
    return violations(rows, keys, checks)


def series_gaps(df: DataFrame, keys: Sequence[str], timeframe: str, *,
                chunk_rows: int = 8192) -> DataFrame:
    """Every hole of a candle series: last bar before, first bar after, bars missing."""
    step = timeframe_ms(timeframe) * 1000
    w = chunk_window(keys)
    return (
        spread_to_chunks(number_rows(df.select(*keys, "timestamp"), keys), chunk_rows, before=1)
        .withColumn("previous", F.lag("timestamp", 1).over(w))
        .filter(F.col(OWN) & F.col("previous").isNotNull())
        .withColumn("missing", F.expr(
            f"(unix_micros(timestamp) - unix_micros(previous)) div {step} - 1"))
        .filter(F.unix_micros("timestamp") - F.unix_micros("previous") != step)
        .select(*keys, "previous", F.col("timestamp").alias("following"), "missing")
    )


def feature_input_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values and uniqueness required before features are computed."""
    require_columns(df, [*keys, *CANDLE_COLUMNS])
    return violations(df, keys, _value_checks()).unionByName(duplicate_rows(df, keys))


def label_input_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Opens finite and positive, timestamps unique."""
    none = F.lit(None).cast("string")
    checks = [
        ("not_finite", _bad_number(F.col("open")), F.lit("open")),
        ("price_not_positive", F.col("open") <= 0.0, F.lit("open")),
        ("timestamp_missing", F.col("timestamp").isNull(), none),
    ]
    return violations(df, keys, checks).unionByName(duplicate_rows(df, keys))


def duplicate_rows(df: DataFrame, keys: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Keys that occur more than once, counted with map-side partial sums."""
    return (
        df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        .select(*keys, F.lit("duplicate_timestamp").alias("check"), F.col(ts).alias("timestamp"),
                F.col("_n").cast("string").alias("detail"))
    )


def split_input_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Decision and exit times present, decisions unique, exit after decision."""
    none = F.lit(None).cast("string")
    checks = [
        ("timestamp_missing", F.col("timestamp").isNull(), none),
        ("exit_missing", F.col("exit_timestamp").isNull(), none),
        ("exit_not_after_decision", F.col("exit_timestamp") <= F.col("timestamp"), none),
    ]
    return violations(df, keys, checks).unionByName(duplicate_rows(df, keys))


def training_matrix_report(df: DataFrame, features: Sequence[str], label: str = "label",
                           by: Sequence[str] = ()) -> DataFrame:
    """Bad values per feature, labels outside {0, 1}, and row counts, in one aggregate."""
    require_columns(df, [*by, *features, label])
    if len(set(features)) != len(features):
        raise ValueError("feature columns must be unique")
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad_labels"),
        *[F.count_if(_bad_number(F.col(c).cast("double"))).alias(f"bad_{c}") for c in features],
    ]
    return df.groupBy(*by).agg(*aggs)


def score_violations(market: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores must be finite, within [0, 1], unique, and belong to a market row."""
    none = F.lit(None).cast("string")
    p = F.col("probability_score")
    own = violations(scores, keys, [
        ("score_not_finite", _bad_number(p), none),
        ("score_outside_unit", (p < 0.0) | (p > 1.0), none),
    ])
    orphan = scores.join(market.select(*keys, "timestamp"), [*keys, "timestamp"], "left_anti")
    return own.unionByName(duplicate_rows(scores, keys)).unionByName(
        orphan.select(*keys, F.lit("score_without_market_row").alias("check"), "timestamp",
                      none.alias("detail"))
    )


def close_to(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Symmetric-free tolerance test; two nulls agree."""
    return (a.isNull() & b.isNull()) | F.coalesce(
        F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False)
    )


def reconcile_tables(left: DataFrame, right: DataFrame, on: Sequence[str],
                     columns: Sequence[str], *, rtol: float = 1e-13,
                     atol: float = 1e-13) -> DataFrame:
    """Rows missing on either side or differing in a column, as violations."""
    a = left.select(*on, F.struct(*columns).alias("_a"))
    b = right.select(*on, F.struct(*columns).alias("_b"))
    types = dict(left.select(*columns).dtypes)
    differing = []
    for c in columns:
        x, y = F.col("_a")[c], F.col("_b")[c]
        same = close_to(x, y, rtol, atol) if types[c] in ("double", "float") else x.eqNullSafe(y)
        differing.append(F.when(~same, F.lit(c)))
    return (
        a.join(b, list(on), "full")
        .withColumn(
            "check",
            F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right")
            .otherwise("value_differs"),
        )
        .withColumn("columns", F.when(
            F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.array_compact(F.array(*differing))
        ))
        .filter((F.col("check") != "value_differs") | (F.size("columns") > 0))
        .select(*on, "check", "columns")
    )


def bundle_violations(raw: DataFrame, features: DataFrame, labeled: DataFrame,
                      keys: Sequence[str], *, horizon: int, minimum_return: float,
                      minimum_rows: int) -> DataFrame:
    """Raw, feature and labeled tables must agree in counts, prices and recomputed labels."""
    from chronoweft.operators.labels import next_open_labels

    keys = list(keys)
    tail = reconcile_tables(
        raw.join(features.select(*keys, "timestamp"), [*keys, "timestamp"], "left_semi"),
        features, [*keys, "timestamp"], CANDLE_COLUMNS[1:],
    ).select(*keys, F.concat(F.lit("raw_vs_features_"), F.col("check")).alias("check"),
             F.lit(1).alias("_n"))
    again = next_open_labels(
        number_rows(features.drop("pos"), keys), keys, horizon=horizon,
        minimum_return=minimum_return,
    )
    relabel = reconcile_tables(
        labeled, again, [*keys, "timestamp"],
        ["entry_timestamp", "exit_timestamp", "entry_open", "exit_open",
         "gross_forward_return", "label"],
    ).select(*keys, F.concat(F.lit("labels_"), F.col("check")).alias("check"),
             F.lit(1).alias("_n"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    sizes = (
        counts(raw, "_raw").join(counts(features, "_feat"), keys, "full")
        .join(counts(labeled, "_lab"), keys, "full")
    )
    arithmetic = sizes.select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.col("_raw") - F.col("_feat") < minimum_rows - 1, "warmup_rows"),
        F.when(F.col("_feat") - F.col("_lab") != horizon + 1, "tail_rows"),
    ))).alias("check"), F.lit(1).alias("_n"))
    return tail.unionByName(relabel).unionByName(arithmetic).groupBy(*keys, "check").agg(
        F.sum("_n").alias("rows")
    )


def require_empty(found: DataFrame, what: str) -> None:
    """Strict mode: stop on the first violations instead of reporting them."""
    sample = found.limit(5).collect()
    if sample:
        raise ContractViolation(f"{what}: {[r.asDict() for r in sample]}")
