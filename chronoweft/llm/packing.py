"""Best-fit packing of documents into training sequences under source and duplicate conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import ascii_lower, query, table

CAPACITY, BLOCK = 2048, 4096


def pack_block(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of every item, in order of falling size.

    Open bins are ordered by residual. The search starts at the first residual that fits and walks
    to its successors until neither the source nor the cluster bitmap of the bin meets the item's.
    Bitmaps have one bit per source and per cluster that occurs more than once in the block.
    """
    bit: dict = {}
    count: dict = {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    bins: list[tuple[int, int]] = []
    maps: list[int] = []
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        mask = 0
        if sources[i] is not None:
            mask |= 1 << bit.setdefault(("s", sources[i]), len(bit))
        if clusters[i] is not None and count[clusters[i]] > 1:
            mask |= 1 << bit.setdefault(("c", clusters[i]), len(bit))
        at = bisect_left(bins, (sizes[i], -1))
        while at < len(bins) and maps[bins[at][1]] & mask:
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
        else:
            left, b = capacity, len(maps)
            maps.append(0)
        maps[b] |= mask
        out[i] = b
        if left > sizes[i]:
            insort(bins, (left - sizes[i], b))
    return out


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "n_words"], na_position="first",
                                ignore_index=True)
        source = [None if pd.isna(s) else s for s in rows["source"]]
        rows["bin"] = pack_block(rows["n_words"].tolist(), source, rows["cluster"].tolist(),
                                 capacity)
        return rows[["doc_id", "piece", "start", "n_words", "block", "bin"]]
    return run


def best_fit(docs: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, n_words, block, bin: where each piece of each document goes.

    A document longer than ``capacity`` words is cut into pieces; no bin holds two pieces of one source
    or of one cluster of equal texts. Documents are dealt to blocks of about ``block_rows`` by a hash of
    id and text, whatever their source, so no block grows with the data; a bin belongs to one block.
    Null and empty texts have no words and are one piece of no length, packed like others; a null source
    conflicts with nothing; repeated rows are packed apart, as copies. Other columns are ignored.
    """
    text = ascii_lower(F.col("text"))
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(text).alias("cluster"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    n = docs.count()
    blocks = max(1, -(-n // block_rows))
    pieces = sized.select(
        "doc_id", "source", "cluster", "words", F.explode(F.sequence(
            F.lit(0).cast("bigint"),
            F.greatest(F.lit(0), F.ceil(F.col("words") / capacity) - 1).cast("bigint")
        )).alias("piece"))
    pieces = pieces.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece") * capacity).cast("bigint")
        .alias("n_words"),
        F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(blocks)).alias("block"))
    return pieces.groupBy("block").applyInPandas(
        _pack(capacity), "doc_id bigint, piece bigint, start bigint, n_words bigint, block bigint, "
        "bin bigint")


@query("op10_packing")
def op10(spark, sf_dir):
    return best_fit(table(spark, sf_dir, "documents"))
