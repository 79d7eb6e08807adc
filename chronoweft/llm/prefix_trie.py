"""Prefix trie of conversations: balanced parentheses per shard, spines merged over shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import query, table
from chronoweft.session import materialise

SHARD_NODES, SHARD_ROWS, FAN = 1 << 16, 1 << 14, 32
EMPTY = hashlib.sha256(b"").hexdigest()
SPINE = "array<struct<node:int,hash:binary,n:bigint,least:bigint,leaf:boolean,ends:bigint>>"
SHARD = f"shard bigint, bits binary, words binary, ends binary, ids binary, spine {SPINE}"
NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
PART = f"{NODE}, hash binary, shard bigint, ends binary"


class Parens:
    """Parentheses of a tree in preorder, with a range min-max tree over the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.open = np.flatnonzero(bits)
        excess = np.cumsum(np.where(bits, 1, -1))
        self.depth = excess[self.open] - 1
        self.low, self.high = [excess], [excess]
        while len(self.low[-1]) > FAN:
            starts = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
        self.leaf = ~bits[self.open + 1]

    @classmethod
    def of_depths(cls, depth: np.ndarray) -> Parens:
        """``depth`` of every node in preorder, the root at 0."""
        bits = np.zeros(2 * len(depth), bool)
        bits[2 * np.arange(len(depth)) - depth] = True
        return cls(bits)

    def _scan(self, level: int, at: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in [at, stop) whose range holds the target, or stop."""
        low, high, at = self.low[level], self.high[level], at.copy()
        live = np.flatnonzero(at < stop)
        while len(live):
            x, t = at[live], target[live]
            live = live[(low[x] > t) | (high[x] < t)]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return at

    def findclose(self) -> np.ndarray:
        """Place of the closing parenthesis of every node."""
        target = self.low[0][self.open] - 1
        at, out = self.open + 1, np.empty(len(self.open), np.int64)
        todo = np.arange(len(out))
        for level in range(len(self.low)):
            top = level == len(self.low) - 1
            size = len(self.low[level])
            stop = np.full(len(todo), size) if top else np.minimum(-(-at // FAN) * FAN, size)
            at = self._scan(level, at, stop, target[todo])
            found = at < stop
            down, goal = at[found], target[todo[found]]
            for below in range(level - 1, -1, -1):
                down = self._scan(below, down * FAN, np.minimum(down * FAN + FAN,
                                                               len(self.low[below])), goal)
            out[todo[found]] = down
            todo, at = todo[~found], -(-at[~found] // FAN)
        return out

    def parents(self) -> np.ndarray:
        """Parent of every node, -1 for the root."""
        out = np.full(len(self.depth), -1)
        for above, here in zip(self.levels(), self.levels()[1:]):
            out[here] = above[np.searchsorted(above, here) - 1]
        return out

    def levels(self) -> list[np.ndarray]:
        """Nodes of every depth, in preorder."""
        order = np.argsort(self.depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)


def _within(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over every subtree, by one cumulative array."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.arange(len(size))
    return total[at + size] - total[at]


def _least(parens: Parens, parent: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that ends in every subtree."""
    out = np.full(len(ends), np.iinfo(np.int64).max)
    here = ends > 0
    out[here] = ids[(np.cumsum(ends) - ends)[here]]
    for nodes in parens.levels()[:0:-1]:
        np.minimum.at(out, parent[nodes], out[nodes])
    return out


def _hashes(path: bytes) -> list[bytes]:
    """One hash per prefix of a path, the empty one first."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(path), 16):
        h.update(path[at:at + 16])
        out.append(h.copy().digest())
    return out


def _encode(seq: int, ids: list[int], paths: list[bytes], words: list) -> pa.RecordBatch:
    """One shard of sorted conversations: its parentheses, arrays per node and both spines."""
    turns = np.array([len(p) // 16 for p in paths])
    keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    first = np.cumsum(turns) - turns
    row = np.repeat(np.arange(len(turns)), turns)
    at = np.arange(len(row)) - first[row]
    before = np.maximum(row - 1, 0)
    same = (row > 0) & (at < turns[before])
    same[same] = (keys[same] == keys[(first[before] + at)[same]]).all(axis=1)
    # a turn is a new node from the first difference with the conversation before on
    differs = np.concatenate([[0], np.cumsum(~same)])
    new = differs[1:] > differs[first[row]]
    depth = np.concatenate([[0], at[new] + 1])
    cost = np.concatenate([[0], np.concatenate([np.asarray(w, np.int64) for w in words])[new]])
    made = np.bincount(row[new], minlength=len(turns))
    end = np.maximum.accumulate(np.where(made > 0, np.cumsum(made), 0))
    ends = np.bincount(end, minlength=len(depth))
    parens = Parens.of_depths(depth)
    size = (parens.findclose() - parens.open + 1) // 2
    least = _least(parens, parens.parents(), ends, np.array(ids))
    count = _within(ends, size)
    right = np.flatnonzero(np.arange(len(size)) + size == len(size)).tolist()
    spine = dict(zip(range(turns[0] + 1), _hashes(paths[0]))) | dict(zip(right, _hashes(paths[-1])))
    rows = [{"node": k, "hash": h, "n": int(count[k]), "least": int(least[k]),
             "leaf": bool(parens.leaf[k]), "ends": int(ends[k])} for k, h in spine.items()]
    cells = [TaskContext.get().partitionId() << 32 | seq, np.packbits(parens.bits).tobytes(),
             cost.astype("<i8").tobytes(), ends.astype("<i8").tobytes(),
             np.array(ids, "<i8").tobytes(), rows]
    b, long = pa.binary(), pa.int64()
    spine_type = pa.list_(pa.struct([("node", pa.int32()), ("hash", b), ("n", long), ("least", long),
                                     ("leaf", pa.bool_()), ("ends", long)]))
    return pa.RecordBatch.from_arrays(
        [pa.array([c], t) for c, t in zip(cells, [long, b, b, b, b, spine_type])],
        names=["shard", "bits", "words", "ends", "ids", "spine"])


def _shards(shard_nodes: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, ids, paths, words = 0, 0, [], [], []
        for batch in batches:
            for k, path, count in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(k)
                paths.append(path)
                words.append(count)
                held += len(path) // 16
                if held >= shard_nodes or len(ids) >= shard_rows:
                    yield _encode(seq, ids, paths, words)
                    seq, held, ids, paths, words = seq + 1, 0, [], [], []
        if ids:
            yield _encode(seq, ids, paths, words)
    return run


def _listed(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _decode(row: dict) -> pa.RecordBatch:
    """Rows of a shard's nodes. Rows of spine nodes (``hash`` set) are this shard's share."""
    words, ends, ids = (np.frombuffer(row[c], "<i8") for c in ("words", "ends", "ids"))
    n = len(words)
    parens = Parens(np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=2 * n).astype(bool))
    close, parent = parens.findclose(), parens.parents()
    size = (close - parens.open + 1) // 2
    count, least = _within(ends, size), _least(parens, parent, ends, ids)
    own, leaf, held = np.ones(n, bool), parens.leaf.copy(), np.full(n, 1)
    hashes: list[bytes | None] = [None] * n
    for s in row["merged"]:
        k = s["node"]
        count[k], least[k], hashes[k] = s["n"], s["least"], s["hash"]
        own[k], leaf[k], held[k] = s["owner"] == row["shard"], s["leaf"], s["held"]
    pairs = np.concatenate([[0], np.cumsum(_at(parens, leaf & own))])
    leaves = pairs[close + 1] - pairs[parens.open]
    saved = _within(np.where(own, (count - 1) * words, 0), size)
    children = np.bincount(parent[1:][own[1:]], minlength=n)
    stop = np.cumsum(ends)
    digest, lists = [EMPTY] * n, [None] * n
    for k in np.flatnonzero(ends).tolist():
        raw = _listed(ids[stop[k] - ends[k]:stop[k]])
        if held[k] > 1:
            digest[k], lists[k] = None, raw
        else:
            digest[k] = hashlib.sha256(raw).hexdigest()
    for k in np.flatnonzero((ends == 0) & (np.array([h is not None for h in hashes]))).tolist():
        if held[k] > 0:
            digest[k] = None
    above = [None if p < 0 else x for p, x in zip(parent.tolist(), least[parent].tolist())]
    cells = [least, parens.depth, above, count, children, leaves, saved, digest, hashes,
             np.full(n, row["shard"]), lists]
    types = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)],
                                      names=[f.split(" ")[0] for f in PART.split(", ")])


def _at(parens: Parens, nodes: np.ndarray) -> np.ndarray:
    """1 at the opening parenthesis of the given nodes."""
    out = np.zeros(len(parens.bits), np.int64)
    out[parens.open[nodes]] = 1
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield _decode(batch.slice(at, 1).to_pylist()[0])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of every list, which come in order."""
    now, h = None, None

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())],
            names=["hash", "joined"])

    for batch in batches:
        found = []
        for key, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key != now:
                if now is not None:
                    found.append((now, h.hexdigest()))
                now, h = key, hashlib.sha256()
            else:
                h.update(b",")
            h.update(part.as_py())
        yield out(found)
    if now is not None:
        yield out([(now, h.hexdigest())])


def _turn_lists(rows: DataFrame, *tie: str) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", "role", *tie, "key", "words"))).alias("turns"))


def _slim(turns: Column | str) -> Column:
    return F.transform(turns, lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words")))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns (key, words) in order, one row per conversation.

    Turns are ordered by ``turn`` (null first), then role, then text; null role and text are empty. Texts
    are fetched again only for conversations where two turns of one number and role differ.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        text.alias("text"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
                                  .cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).filter("conv_id is not null")
    t = F.col("turns")
    tie = F.exists(F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), lambda x, y: (
        x["turn"].eqNullSafe(y["turn"]) & (x["role"] == y["role"]) & (x["key"] != y["key"]))),
        lambda x: F.coalesce(x, F.lit(False)))
    lists = materialise(_turn_lists(rows).select("conv_id", _slim("turns").alias("turns"),
                                                 tie.alias("tie")), "turn-lists")
    tied = lists.filter("tie").select("conv_id")
    if tied.isEmpty():
        return lists.drop("tie")
    again = _turn_lists(rows.join(tied, "conv_id", "left_semi"), "text")
    return lists.filter("not tie").drop("tie").unionByName(
        again.select("conv_id", _slim("turns").alias("turns")))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, where the first turns come from the first conversation of its twenty."""
    lists = turn_lists(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    first = lists.filter(F.col("conv_id") % 20 == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, 3).alias("head"))
    joined = lists.withColumn("first", F.col("conv_id") - F.col("conv_id") % 20).join(
        first, "first", "left")
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0)),
                     F.slice("turns", h + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns"))


def trie(lists: DataFrame, shard_nodes: int = SHARD_NODES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix of ``lists`` (conv_id, turns of key and words), the empty one too.

    Conversations are sorted by their path of 16-byte turn keys and cut into shards anywhere, so a group
    of copies or a common first turn spreads over many tasks. A shard is a tree in balanced parentheses.
    Only nodes on the paths of its first and last conversation can go on in another shard: they are merged
    by hash of their prefix, sent back, and each is counted by the first shard that holds it. An empty
    table has no nodes. Rows of one conv_id are one conversation; its turns are one array (some 50 bytes a
    turn). A list of ends that spreads over shards is hashed as one stream of parts.
    """
    hexed = F.array_join(F.transform("turns", lambda x: x["key"]), "")
    flat = materialise(lists.select("conv_id", F.unhex(hexed).alias("path"), F.transform(
        "turns", lambda x: x["words"]).alias("words")), "paths")
    shards = materialise(
        flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        .mapInArrow(_shards(shard_nodes, shard_rows), SHARD), "trie-shards")
    spine = shards.select("shard", F.explode("spine").alias("s")).select("shard", "s.*")
    merged = spine.groupBy("hash").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min("shard").alias("owner"),
        F.min("leaf").alias("leaf"), F.count_if(F.col("ends") > 0).alias("held"))
    sent = spine.select("shard", "node", "hash").join(merged, "hash").groupBy("shard").agg(
        F.collect_list(F.struct("node", "hash", "n", "least", "owner", "leaf", "held")).alias("merged"))
    parts = materialise(shards.drop("spine").join(sent, "shard").mapInArrow(_rows, PART), "trie-parts")
    names = [f.split(" ")[0] for f in NODE.split(", ")]
    sums = ("n_children", "n_leaves", "saved_tokens")
    shared = parts.filter("hash is not null").groupBy("hash").agg(
        *[(F.sum if c in sums else F.max)(c).alias(c) for c in names])
    lists_ = parts.filter("ends is not null").select("hash", "shard", "ends")
    joined = lists_.repartition("hash").sortWithinPartitions("hash", "shard").select(
        "hash", "ends").mapInArrow(_digests, "hash binary, joined string")
    shared = shared.join(joined, "hash", "left").withColumn(
        "ends_sha256", F.coalesce("joined", "ends_sha256"))
    return parts.filter("hash is null").select(*names).unionByName(shared.select(*names))


_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
                            coalesce(text, '')) as k
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as first, (xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''),
                                                           lambda x: ascii(x)::bigint)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
             lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)) % 4 as h
  from (select distinct conv_id from t)),
turns as (
  select c.conv_id, t.k, t.role, t.text from c join t on t.conv_id = c.first and t.k <= c.h
  union all
  select c.conv_id, t.k + 1000000, t.role, t.text from c join t on t.conv_id = c.conv_id and t.k > c.h),
placed as (
  select conv_id, row_number() over (partition by conv_id order by k) as depth,
         md5(length(role) || ':' || role || text) as turn,
         length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'x', 'g'),
                               '[\\x20\\x09-\\x0D]', '', 'g')) as words
  from turns),
listed as (
  select c.conv_id, coalesce(list(turn order by depth) filter (turn is not null), []) as path,
         list(words order by depth) filter (turn is not null) as words
  from c left join placed using (conv_id) group by c.conv_id),
prefixes as (
  select conv_id, d as depth, array_to_string(path[1:d], ',') as prefix,
         array_to_string(path[1:d - 1], ',') as up, coalesce(words[d], 0) as words, len(path) = d as ends
  from listed, unnest(range(0, len(path) + 1)) as u(d)),
nodes as (
  select depth, prefix, min(conv_id) as conv_id, min(up) as up, count(*) as n_convs,
         (count(*) - 1) * min(words) as saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by depth, prefix),
children as (select depth - 1 as depth, up as prefix, count(*) as n from nodes where depth > 0 group by 1, 2),
own as (
  select nodes.*, coalesce(n, 0) as n_children from nodes left join children using (depth, prefix)),
sums as (
  select depth, prefix, sum(saved) as saved_tokens, sum(leaf) as n_leaves from (
    select unnest(range(0, depth + 1)) as depth, saved, (n_children = 0)::bigint as leaf,
           case when prefix = '' then [] else string_split(prefix, ',') end as path,
           array_to_string(path[1:unnest(range(0, depth + 1))], ',') as prefix
    from own) group by depth, prefix)
select own.conv_id, own.depth::bigint as depth, p.conv_id as parent_conv_id, own.n_convs,
       own.n_children, sums.n_leaves::bigint as n_leaves, sums.saved_tokens::bigint as saved_tokens,
       own.ends_sha256
from own join sums using (depth, prefix)
left join own p on own.depth > 0 and p.depth = own.depth - 1 and p.prefix = own.up
"""


@query("op11_prefix_trie", _SQL)
def op11(spark, sf_dir):
    return trie(rebuilt(table(spark, sf_dir, "conversations")))
