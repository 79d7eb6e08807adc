"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # what a Python worker holds at once is a number of bytes, not of rows of any length
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Arrow functions are pickled by reference, so every executor must be able to import them wherever
    the driver was started.
    """
    context = spark.sparkContext
    if getattr(context, "_chronoweft_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="spark-"), "chronoweft"), "zip",
        root_dir=os.path.dirname(here), base_dir=os.path.basename(here))
    context.addPyFile(archive)
    context._chronoweft_shipped = True


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (UTC clock, AQE, package on workers)."""
    ship_package(spark)
    for key, value in _RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` when the cluster names one.

    Only where the session has none (a laptop, a test) is a local folder made and used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    local = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(local)
    return "file:" + local if not local.startswith("file:") else local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, executors may die."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
