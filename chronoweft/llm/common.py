"""Shared pieces: table reader, words, joins that survive hot keys, connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweft.session import materialise, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans((UPPER + "\t\n\v\f\r").encode(), (LOWER + "     ").encode())
HOT_SHARE = 500


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z folded, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: str | None) -> list[str]:
    """Words between the six ASCII blanks, A-Z folded."""
    if not text:
        return []
    return [w for w in fold_bytes(text, _FOLD).split(" ") if w]


def fold_bytes(text: str, table_: bytes) -> str:
    """``text`` with single ASCII characters replaced; others are bytes over 127 and stay."""
    return text.encode("utf-8", "surrogatepass").translate(table_).decode("utf-8", "surrogatepass")


def _blank(data: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text that belong to white space, Unicode's included."""
    table_ = np.zeros(256, bool)
    table_[[*range(9, 14), *range(28, 33)]] = True
    out = table_[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        far = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
        code = (far[lead] << 16) | (far[lead + 1] << 8) | far[lead + 2]
        two = lead[np.isin(code >> 8, _TWO)]
        three = lead[np.isin(code, _THREE)]
        for k, at in ((2, two), (3, three)):
            for i in range(k):
                out[at + i] = True
    return out


def _spaces(size: int) -> np.ndarray:
    found = [chr(c).encode() for c in range(128, 0x10000) if chr(c).isspace()]
    return np.array([int.from_bytes(b, "big") for b in found if len(b) == size])


_TWO, _THREE = _spaces(2), _spaces(3)


def stretches(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts cut before every blank or line feed between two visible characters.

    The distinct stretches, the place of every stretch in that list, and the edges of the texts in it.
    """
    texts = texts.cast(pa.large_binary())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[edges[0]:edges[-1]] if raw else np.empty(0, np.uint8)
    edges = edges - edges[0]
    blank = _blank(data)
    some = np.diff(edges) > 0
    begin, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    last[edges[1:][some] - 1] = True
    at = np.flatnonzero(((data == 32) | (data == 10)) & ~last)
    at = at[at > 0]
    begin[at[~blank[at - 1] & ~blank[at + 1]]] = True
    begin[edges[:-1][some]] = True
    at = np.flatnonzero(begin)
    cut = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)),
                                     pa.py_buffer(np.ascontiguousarray(data))])
    coded = cut.dictionary_encode()
    return (coded.dictionary.to_numpy(zero_copy_only=False).tolist(),
            coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(at, edges))


def joined(parts: list[bytes], codes: np.ndarray, edges: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """``parts`` by ``codes`` in a row, and the byte edges of the texts that ``stretches`` cut."""
    rows = pa.array(parts, pa.large_binary()).take(pa.array(codes))
    if not len(rows):
        return memoryview(b""), np.zeros(len(edges), np.int64)
    to = np.frombuffer(rows.buffers()[1], np.int64)[:len(rows) + 1]
    return memoryview(rows.buffers()[2] or b""), to[edges]


class WordHash:
    """64-bit hashes of words with a bounded memo."""

    def __init__(self, limit: int = 400_000):
        self.memo: dict[str, int] = {}
        self.limit = limit

    def __call__(self, words: list[str]) -> np.ndarray:
        memo, put = self.memo, xxhash.xxh3_64_intdigest
        if len(memo) > self.limit:
            memo.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = memo.get(w)
            if h is None:
                h = memo[w] = put(w.encode("utf-8", "surrogatepass"))
            out[i] = h
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; a shorter sequence is one run; none for no words."""
    if len(h) == 0:
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return out


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame,
             how: str = "left") -> DataFrame:
    """Join on ``key``, where ``right`` has one row per key and ``counts`` (key, n) counts ``left``.

    Keys with more than 1/500 of the rows - at most 500 of them - meet a broadcast of their own rows;
    the rest is shuffled.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.filter((F.col("n") * HOT_SHARE > total) & (F.col("n") > 64))
           .select(key).collect() if r[0] is not None]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.filter(~is_hot).join(right.filter(~is_hot), key, how)
    return cold.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id per node of ``edges`` (a, b): rows (id, component), roots left out.

    Alternates stars to larger and to smaller neighbours until nothing changes; every round is a
    written table, so a lost executor costs one round at most.
    """
    now = materialise(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(
            F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = materialise(
            small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct(), name)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(
            F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        mark = state
