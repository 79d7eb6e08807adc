"""Near-duplicate texts: fast similarity sketching, banding, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import (
    WordHash, components, hot_join, mix, query, table, windows, words_of,
)
from chronoweft.session import materialise

BINS, ROWS = 128, 4


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit items.

    Round i < bins throws every item into a hashed bin, round i >= bins puts all items into bin
    i - bins; a bin keeps the smallest value of the first round that reaches it. So after 2 * bins
    rounds at most every coordinate is filled.
    """
    out = np.zeros(bins, np.uint64)
    open_ = np.ones(bins, bool)
    for i in range(bins):
        h = mix(items + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        best = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(best, (h % np.uint64(bins)).astype(np.int64), h >> np.uint64(8))
        fresh = open_ & (best != np.iinfo(np.uint64).max)
        out[fresh] = best[fresh] + np.uint64(i << 56)
        open_ &= ~fresh
        if not open_.any():
            return out
    for b in np.flatnonzero(open_).tolist():
        h = mix(items + np.uint64((bins + b + 1) * 0x9E3779B97F4A7C15 % 2**64))
        out[b] = (h.min() >> np.uint64(8)) + np.uint64((bins + b) % 256 << 56)
    return out


def shingles(text: str | None, width: int, hashes: WordHash) -> np.ndarray:
    return np.unique(windows(hashes(words_of(text)), width))


def _sketches(width: int, bins: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for batch in batches:
            size, key, bands = [], [], []
            for text in batch["text"]:
                s = shingles(text, width, hashes)
                size.append(len(s))
                if len(s) == 0:
                    key.append(None)
                    bands.append(None)
                    continue
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = sketch(s, bins).reshape(-1, rows)
                bands.append([xxhash.xxh3_64_intdigest(m[i].tobytes(), seed=i) - 2**63
                              for i in range(len(m))])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": size, "set_key": key,
                                "bands": bands})
    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        last_id, last = None, None
        for batch in batches:
            keep = []
            for a, left, right in zip(batch["a"], batch["left"], batch["right"]):
                if a != last_id:
                    last_id, last = a, shingles(left, width, hashes)
                other = shingles(right, width, hashes)
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]
    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bins: int = BINS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Equal sets are one class with its smallest id; classes that share a band are linked first to the
    smallest class of that band, and after that every pair of a band whose ends are still in different
    components is confirmed too, so a link is lost only where a joint set leaves no band equal
    (0.8 ** 4 over 32 bands: 5e-8). Null, empty and blank texts have no shingles and stay alone;
    rows with a null id stay alone with a null component; repeated ids count as one document.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    base = materialise(texts.mapInPandas(
        _sketches(width, bins, rows),
        "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"), "sketch")
    known = base.filter("set_key is not null and doc_id is not null")
    classes = materialise(known.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    heads = known.join(classes.select("set_key", F.col("rep").alias("doc_id")),
                       ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    band = materialise(heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band")),
                       "bands")
    bucket = materialise(band.groupBy("band").agg(
        F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    shared = materialise(hot_join(band, bucket.select("band", "a"), "band",
                                  bucket.select("band", "n"), "inner"), "shared")
    source = texts.dropDuplicates(["doc_id"]) if _repeated(known) else texts

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = source.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
        right = source.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
        return materialise(pairs.join(right, "b").join(left, "a").mapInPandas(
            _confirm(width, percent), "a bigint, b bigint"), "links")

    stars = materialise(shared.filter("id <> a").select("a", F.col("id").alias("b")).distinct(),
                        "stars")
    links = confirmed(stars)
    comp = components(links)
    placed = shared.select("id", "band").join(comp, "id", "left").select(
        "id", "band", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter(
        "c1 <> c2").select("band")
    open_ = materialise(placed.join(mixed, "band", "left_semi"), "open")
    x, y = open_.toDF("a", "band", "ca"), open_.toDF("b", "band", "cb")
    bridges = x.join(y, "band").filter("a < b and ca <> cb").select("a", "b").distinct()
    bridges = materialise(bridges.join(stars, ["a", "b"], "left_anti"), "bridges")
    more = confirmed(bridges)
    comp = components(links.union(more))
    named = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    out = hot_join(base.drop("bands"), named, "set_key", classes.select("set_key", "n"))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id") == component).alias("kept"))


def _repeated(known: DataFrame) -> bool:
    row = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    return (row[0] or 0) > 1


@query("op1_minhash")
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
