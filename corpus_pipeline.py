"""Cleaning a corpus in five stages; each is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.llm import decontamination, minhash, packing, pii, toxicity
from chronoweft.session import scratch_path, tune

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold, learnt from all labelled rows."""
    tune(spark)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = toxicity.train(source, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, weights)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every near-duplicate group.

    Rows that repeat an id and its text count once. Different texts under one id all stay while any of them
    is kept; rows without an id stay.
    """
    tune(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    drop = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(
        docs.filter("doc_id is null"))
    return one.join(drop, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised; ``n_chars`` follows the text."""
    tune(spark)
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in out.columns \
        else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the bin of each."""
    tune(spark)
    return packing.best_fit(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", deduplicate), ("decontamination", decontaminate),
          ("personal_data", sanitise), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(tune(spark), f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
