"""Token-id shards with a minimal perfect hash index from document keys to offsets."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.llm.common import joined, mix, query, stretches, table
from chronoweft.session import scratch_path

END_ID = 0
SHARD_IDS, SHARD_DOCS = 1 << 19, 1 << 12
NO_KEY = -(1 << 63)
MEMO, MEMO_BYTES, TOGETHER = 400_000, 64, 4096
SHARD = ("part int, seq int, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, before bigint, "
         "levels array<binary>, prints binary, entries binary, offsets binary, keys binary, payload binary")


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(keys.view(np.uint64) + salt) % np.uint64(size)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def build_index(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Levels of bit arrays, and the slot (0..n-1, each once) of every distinct key.

    A key stays at the first level where no other remaining key falls on its bit; its slot is the
    number of bits set before it.
    """
    slot = np.empty(len(keys), np.int64)
    rest = np.arange(len(keys))
    levels, base = [], 0
    while len(rest):
        size = 8 * (len(rest) // 4 + 1)
        at = _level(keys[rest], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        rank = np.cumsum(alone) - 1
        slot[rest[settled]] = base + rank[at[settled]]
        levels.append(np.packbits(alone).tobytes())
        base += int(alone.sum())
        rest = rest[~settled]
    return levels, slot


class Index:
    """Constant-time lookup in one shard row."""

    def __init__(self, row):
        self.levels, base = [], 0
        for raw in row["levels"]:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
            self.levels.append((bits, np.cumsum(bits) - 1 + base))
            base += int(bits.sum())
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.entries = np.frombuffer(row["entries"], "<u4").reshape(-1, 2)
        self.offsets = np.frombuffer(row["offsets"], "<u8")
        self.payload = row["payload"]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where the key is absent."""
        slot = np.full(len(keys), -1)
        rest = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            at = _level(keys[rest], level, len(bits))
            hit = bits[at]
            slot[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
            if not len(rest):
                break
        known = np.flatnonzero(slot >= 0)
        wrong = self.prints[slot[known]] != fingerprint(keys[known])
        slot[known[wrong]] = -1
        return slot

    def find(self, key: int) -> list[tuple[int, bytes]]:
        """(first id within the shard, raw ids) of every document with the key; [] if absent."""
        slot = int(self.slots(np.array([key], np.int64))[0])
        return [] if slot < 0 else self.at(slot)

    def at(self, slot: int) -> list[tuple[int, bytes]]:
        first, n = self.entries[slot].tolist()
        edges = self.offsets[first:first + n + 1].tolist()
        return [(a, self.payload[4 * a:4 * b]) for a, b in zip(edges, edges[1:])]


class Encoder:
    """Ids of whole texts as raw bytes, with a memo of two generations for repeated stretches.

    Texts are cut where a pre-token starts in any case, so the ids of the stretches in a row are the ids
    of the text. Stretches over ``MEMO_BYTES`` are encoded each time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use every core
        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # a character stands for a byte
            self.sizes[k] = len(token)
        for k, token in self.model.get_added_tokens_decoder().items():
            self.sizes[k] = len(token.content.encode())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> list[bytes]:
        """Ids of every part. Parts that keep apart beside each other are encoded as one text, and the
        sizes of the tokens in bytes say where a part ends."""
        out = [b""] * len(parts)
        apart, alone = [], []
        for i, p in enumerate(parts):
            text = p.decode()
            whole = (len(text) > 1 and text[0] in " \n" and not text[1].isspace()
                     and not text[-1].isspace())
            (apart if whole else alone).append((i, text))
        for at in range(0, len(apart), TOGETHER):
            some = apart[at:at + TOGETHER]
            ids = np.array(self.model.encode_batch_fast(
                ["".join([t for _, t in some])], add_special_tokens=False)[0].ids, "<u4")
            run = np.cumsum(self.sizes[ids])
            stops = np.cumsum([len(parts[i]) for i, _ in some])
            to = np.searchsorted(run, stops) + 1
            if len(run) == 0 or run[-1] != stops[-1] or (run[to - 1] != stops).any():
                alone += some
                continue
            raw, to = ids.tobytes(), (4 * to).tolist()
            for (i, _), a, b in zip(some, [0, *to], to):
                out[i] = raw[a:b]
        if alone:
            for (i, _), coded in zip(alone, self.model.encode_batch_fast(
                    [t for _, t in alone], add_special_tokens=False)):
                out[i] = np.array(coded.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Raw ids of all texts in a row, and the edges of the texts in bytes."""
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        parts, codes, edges = stretches(texts)
        found = list(map(young.get, parts))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                p = parts[i]
                ids = found[i] = old.get(p)
                if ids is None:
                    missing.append(i)
                else:
                    young[p] = ids
        for i, ids in zip(missing, self._encode([parts[i] for i in missing])):
            found[i] = ids
            if len(parts[i]) <= MEMO_BYTES:
                young[parts[i]] = ids
        return joined(found, codes, edges)

    def documents(self, texts: list[str]) -> list[bytes]:
        raw, edges = self.encode(pa.array(texts, pa.string()))
        edges = edges.tolist()
        return [bytes(raw[a:b]) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shards(path: str, end_id: int, shard_ids: int, shard_docs: int):
    end = np.array([end_id], "<u4").tobytes()
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(),
             "array<binary>": pa.list_(pa.binary())}
    kinds = pa.schema([(name, arrow[kind]) for name, kind in (f.split(" ") for f in SHARD.split(", "))])

    def pack(seq: int, before: int, keys: list[int], parts: list[bytes]) -> pa.RecordBatch:
        key = np.array(keys, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype("<u8")
        distinct, first, n = np.unique(key, return_index=True, return_counts=True)
        levels, slot = build_index(distinct)
        prints, entries = np.empty(len(slot), "<u4"), np.empty((len(slot), 2), "<u4")
        prints[slot] = fingerprint(distinct)
        entries[slot] = np.stack([first, n], axis=1)
        return pa.RecordBatch.from_pylist([{
            "part": TaskContext.get().partitionId(), "seq": seq, "first_id": keys[0],
            "last_id": keys[-1], "n_docs": len(keys), "n_ids": int(offsets[-1]), "before": before,
            "levels": levels, "prints": prints.tobytes(), "entries": entries.tobytes(),
            "offsets": offsets.tobytes(), "keys": key.astype("<i8").tobytes(),
            "payload": b"".join(parts)}], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        seq, before, held, keys, parts = 0, 0, 0, [], []
        for batch in batches:
            raw, edges = encode(pc.fill_null(batch["text"], ""))
            edges = edges.tolist()
            for k, a, b in zip(batch["doc_id"].to_numpy().tolist(), edges, edges[1:]):
                if held >= shard_ids or len(keys) >= shard_docs:
                    yield pack(seq, before, keys, parts)
                    seq, before, held, keys, parts = seq + 1, before + held, 0, [], []
                keys.append(k)
                parts.append(bytes(raw[a:b]) + end)
                held += (b - a) // 4 + 1
        if keys:
            yield pack(seq, before, keys, parts)
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
              shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> None:
    """Write shards in ascending doc_id order.

    A shard is one row: raw little-endian unsigned 32-bit ids, offsets, a minimal perfect hash with a
    32-bit fingerprint per key, its smallest and largest key, and the ids before it in its partition.
    Null and empty texts are their end id alone; a null doc_id sorts first under the key -2**63; rows
    with one id follow each other in the order of a hash of the text, over several shards and
    partitions if they are many. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_KEY)).alias("doc_id"),
                       "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    rows.select("doc_id", "text").mapInArrow(
        _shards(tokenizer, end_id, shard_ids, shard_docs), SHARD).write.parquet(path)


def _bases(shards: DataFrame) -> DataFrame:
    """Ids before every written partition: at most one row per partition of the writing job."""
    return shards.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", (
        F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("base"))


def read_ids(spark, path: str, raw: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if ``raw``, the ids, looked up by key in every shard.

    A shard's payload is never shuffled: only one number per written partition is broadcast.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if raw else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                index, out, first = Index(row), [], row["base"] + row["before"]
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                for key, slot in zip(keys.tolist(), index.slots(keys).tolist()):
                    for at, ids in index.at(slot):
                        out.append((None if key == NO_KEY else key, first + at, len(ids) // 4,
                                    zlib.crc32(ids), *([ids] if raw else [])))
                made = pd.DataFrame(out, columns=columns)
                # through Python integers: a null beside them must not turn keys into floats
                made["doc_id"] = pd.array([o[0] for o in out], dtype="Int64")
                yield made

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.drop("seq", "first_id", "last_id", "n_docs", "n_ids").join(
        F.broadcast(_bases(shards)), "part").mapInPandas(run, schema + ", ids binary" * raw)


def lookup(spark, path: str, key: int) -> list[bytes]:
    """Raw ids of every document with ``key``, in order of writing.

    The key ranges of the shards are the directory: only shards that may hold the key are read.
    """
    shards = spark.read.schema(SHARD).parquet(path).filter(
        (F.col("first_id") <= key) & (F.col("last_id") >= key)).orderBy("part", "seq")
    return [ids for row in shards.toLocalIterator() for _, ids in Index(row).find(key)]


@query("op4_tokens")
def op4(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "token-shards")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    write_ids(table(spark, sf_dir, "documents"), path,
              public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path, raw=False)
