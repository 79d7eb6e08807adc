"""Explicit schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PRICE_COLUMNS = ["open", "high", "low", "close"]
CANDLE_COLUMNS = ["timestamp", *PRICE_COLUMNS, "volume"]
LABEL_COLUMNS = [
    "entry_timestamp", "exit_timestamp", "entry_open", "exit_open",
    "gross_forward_return", "label",
]

CANDLES = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in CANDLE_COLUMNS[1:]]
)

ARTICLE = T.StructType(
    [
        T.StructField(name, T.BooleanType() if name == "point_in_time_eligible" else T.StringType())
        for name in (
            "article_id", "article_version_id", "provider", "provider_article_id",
            "provider_observation_id", "source", "canonical_url", "title", "content",
            "language", "published_at", "provider_first_seen_at", "first_seen_at",
            "ingested_at", "provider_updated_at", "asset", "content_hash",
            "raw_snapshot_sha256", "point_in_time_eligible", "exclusion_reason",
            "duplicate_group_id",
        )
    ]
)

SCORE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "score_id", "article_version_id", "content_hash", "asset", "sentiment_model_id",
            "sentiment_model_version", "prompt_version", "scoring_config_hash", "input_sha256",
            "raw_response_sha256", "score_payload_sha256", "scored_at", "state",
        )
    ]
    + [
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("sentiment_score", T.DoubleType()),
                    T.StructField("relevance_score", T.DoubleType()),
                ]
            ),
        )
    ]
)


class SchemaMismatch(ValueError):
    """A table does not carry exactly the contracted columns."""


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Require the exact ordered names and types of ``expected``."""
    got = [(f.name, f.dataType) for f in df.schema.fields]
    want = [(f.name, f.dataType) for f in expected.fields]
    if got != want:
        raise SchemaMismatch(f"expected {want}, got {got}")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Require every named column, reporting all that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
    return df


def reject_future_columns(df: DataFrame) -> DataFrame:
    """Feature input may not already hold values derived from the future."""
    present = [c for c in LABEL_COLUMNS if c in df.columns]
    if present:
        raise SchemaMismatch(f"future-derived columns in feature input: {present}")
    return df
