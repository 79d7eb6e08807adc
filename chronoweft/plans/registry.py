"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.operators.features import technical_features
from chronoweft.operators.labels import next_open_labels
from chronoweft.plans import (  # noqa: F401
    indicators, market_data, modeling, news, streams, trading,
)
from chronoweft.plans.common import ORACLES, QUERIES, hourly, tidy
from chronoweft.session import tune

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events → 6-hour candles → 24 features → executable labels → one row per series."""
    features = technical_features(hourly(tune(spark), sf_dir, "6h"), ["symbol"])
    rows = next_open_labels(features, ["symbol"])
    return tidy(rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("labeled_rows"),
        F.avg(F.col("label").cast("double")).alias("positive_rate"),
        F.avg("gross_forward_return").alias("mean_gross_return"),
        F.avg("rsi").alias("mean_rsi"), F.avg("bb_width").alias("mean_bb_width"),
        F.avg("atr_pct").alias("mean_atr_pct"),
    ))
