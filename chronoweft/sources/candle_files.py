"""Candle, feature and label tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft import settings
from chronoweft.functions.costs import default_label_threshold
from chronoweft.operators.features import finite, technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.operators.models import feature_schema_hash
from chronoweft.operators.positions import number_rows
from chronoweft.operators.quality import (
    ContractViolation, duplicate_rows, require_empty, violations,
)
from chronoweft.schemas import CANDLE_COLUMNS, CANDLES, LABEL_COLUMNS, assert_schema
from chronoweft.settings import IndicatorSpec

CSV_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _text_keys(keys: Sequence[str]) -> list[T.StructField]:
    return [T.StructField(k, T.StringType()) for k in keys]


def write_candle_csv(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Canonical CSV: fixed column order, microsecond UTC times, shortest exact doubles."""
    (df.select(*keys, *CANDLE_COLUMNS).write.mode("errorifexists")
       .option("header", True).option("timestampFormat", CSV_TIMESTAMP).csv(path))


def read_candle_csv(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical CSV under a pinned schema; a bad value or header stops the read."""
    schema = T.StructType([*_text_keys(keys), *CANDLES.fields])
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "FAILFAST").option("timestampFormat", CSV_TIMESTAMP).csv(path)
    )


def write_snapshot(df: DataFrame, root: str, snapshot_id: str, keys: Sequence[str]) -> str:
    """Immutable snapshot partition; a second write of the same id is refused."""
    path = f"{root.rstrip('/')}/snapshot_id={snapshot_id}"
    df.write.mode("errorifexists").partitionBy(*keys).parquet(path)
    return path


def write_run_table(df: DataFrame, root: str, name: str, run_id: str) -> str:
    """One output table of a run (predictions, ledger, equity, splits); never overwritten."""
    path = f"{root.rstrip('/')}/{name}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def feature_schema(keys: Sequence[str], spec: IndicatorSpec = IndicatorSpec()) -> T.StructType:
    """Exact ordered schema of a feature table."""
    return T.StructType(
        [*_text_keys(keys), T.StructField("pos", T.LongType()), *CANDLES.fields]
        + [T.StructField(c, T.DoubleType()) for c in spec.feature_columns]
    )


def labeled_schema(keys: Sequence[str], spec: IndicatorSpec = IndicatorSpec()) -> T.StructType:
    """Exact ordered schema of a labeled table."""
    kinds = [T.TimestampType(), T.TimestampType(), T.DoubleType(), T.DoubleType(),
             T.DoubleType(), T.ByteType()]
    return T.StructType(
        feature_schema(keys, spec).fields
        + [T.StructField(c, k) for c, k in zip(LABEL_COLUMNS, kinds, strict=True)]
    )


def _read_exact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return assert_schema(spark.read.parquet(path), T.StructType(
        [T.StructField(f.name, f.dataType) for f in schema.fields]))


def load_feature_table(spark: SparkSession, root: str, keys: Sequence[str],
                       spec: IndicatorSpec = IndicatorSpec()) -> DataFrame:
    """Feature table with exact schema, finite values and unique times, or an error."""
    df = _read_exact(spark, f"{root}/features", feature_schema(keys, spec))
    bad = violations(df, keys, [
        ("not_finite", finite(F.col(c)).isNull(), F.lit(c))
        for c in [*CANDLE_COLUMNS[1:], *spec.feature_columns]
    ])
    require_empty(bad.unionByName(duplicate_rows(df, keys)), "feature table")
    return df


def load_labeled_table(spark: SparkSession, root: str, keys: Sequence[str],
                       spec: IndicatorSpec = IndicatorSpec()) -> DataFrame:
    """Labeled table: as features, plus labels in {0, 1} and decision < entry < exit."""
    df = _read_exact(spark, f"{root}/labeled", labeled_schema(keys, spec))
    none = F.lit(None).cast("string")
    bad = violations(df, keys, [
        ("label_outside_01", ~F.col("label").isin(0, 1), none),
        ("time_order", ~((F.col("timestamp") < F.col("entry_timestamp"))
                         & (F.col("entry_timestamp") < F.col("exit_timestamp"))), none),
        *[("not_finite", finite(F.col(c)).isNull(), F.lit(c)) for c in spec.feature_columns],
    ])
    require_empty(bad.unionByName(duplicate_rows(df, keys)), "labeled table")
    return df


def prepare_tables(candles: DataFrame, root: str, keys: Sequence[str], *,
                   horizon: int = settings.PREDICTION_HORIZON,
                   minimum_return: float | None = None, spec: IndicatorSpec = IndicatorSpec(),
                   chunk_rows: int = 2048) -> DataFrame:
    """Write the feature and labeled tables, then return the manifest computed from them.

    Features are computed once: labels are built on the written table, and the manifest reads
    only the two narrow columns it counts.
    """
    spark = candles.sparkSession
    keys = list(keys)
    tau = default_label_threshold() if minimum_return is None else minimum_return
    raw = candles if "pos" in candles.columns else number_rows(candles, keys)
    features = technical_features(raw, keys, spec, positioned=True, chunk_rows=chunk_rows)
    features.write.mode("errorifexists").parquet(f"{root}/features")
    written = spark.read.parquet(f"{root}/features")
    next_open_labels(written, keys, horizon=horizon, minimum_return=tau,
                     chunk_rows=chunk_rows).write.mode("errorifexists").parquet(
        f"{root}/labeled")
    n_raw = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_rows"))
    n_feature = written.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("feature_rows"), F.min("timestamp").alias("first_feature"),
        F.max("timestamp").alias("last_feature"))
    n_label = spark.read.parquet(f"{root}/labeled").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labeled_rows"))
    out = n_raw.join(n_feature, keys, "left").join(n_label, keys, "left").select(
        *keys, "raw_rows", F.coalesce("feature_rows", F.lit(0)).alias("feature_rows"),
        F.coalesce("labeled_rows", F.lit(0)).alias("labeled_rows"),
        "first_feature", "last_feature")
    return out.withColumns({
        "warmup_rows": F.col("raw_rows") - F.col("feature_rows"),
        "tail_rows": F.col("feature_rows") - F.col("labeled_rows"),
        "minimum_return": F.lit(tau),
        "schema_sha256": feature_schema_hash(spec.feature_columns),
    })


__all__ = [
    "ContractViolation", "load_feature_table", "load_labeled_table", "prepare_tables",
    "read_candle_csv", "write_candle_csv", "write_run_table", "write_snapshot",
]
