"""Exact top-k by inner product: sorted lists read in step, score bounds, no random access."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import query, table
from chronoweft.session import materialise

SHARD_ROWS, GROUP_SHARDS, QUERY_ROWS = 4096, 32, 16384  # a shard holds at most 65536 rows
READS = (0.5, 0.75, 0.875)
FEW, BLOCK = 64, 256
INDEX = "dim int, grp bigint, shard bigint, tags binary, ids binary, order binary, lists binary"
FOUND = "tag bigint, query_id bigint, other bigint, vec_id bigint, score bigint"
LONG = 2**63 - 1


class Lists:
    """One list per dimension of a shard, values descending, read from both ends.

    A query reads a list from the end where its component makes products large: the top where it is
    positive, the bottom where it is negative.
    """

    def __init__(self, order: np.ndarray, values: np.ndarray):
        self.order, self.values = order, values  # (rows, dims): place in the shard, value
        self.n, self.dims = values.shape
        self.read: dict[int, tuple] = {}
        self.scale = float(2.0 ** -np.ceil(np.log2(max(np.abs(values).max(initial=0.0), 1.0))))

    def at_read(self, k: int) -> tuple[np.ndarray, ...]:
        """After ``k`` reads from either end: what was seen per row, and how far the lists have come."""
        if k in self.read:
            return self.read[k]
        seen, rows = np.zeros((2, self.n, self.dims), bool), np.zeros((2, self.n, self.dims), np.float32)
        scaled = (self.values * self.scale).astype(np.float32)
        for end, part in enumerate((slice(0, k), slice(self.n - k, self.n))):
            np.put_along_axis(seen[end], self.order[part], True, 0)
            np.put_along_axis(rows[end], self.order[part], scaled[part], 0)
        self.read[k] = seen.astype(np.float32), rows, scaled[[k - 1, self.n - k]], scaled[[0, -1]]
        return self.read[k]

    def rows(self) -> np.ndarray:
        """All vectors, by reading every list to its end."""
        out = np.empty_like(self.values)
        np.put_along_axis(out, self.order, self.values, 0)
        return out


def bounds(lists: Lists, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scaled scores (queries, rows) after ``k`` reads of every list."""
    seen, rows, front, ends = lists.at_read(k)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    known = up @ rows[0].T + down @ rows[1].T
    # what is unseen lies between the front of its list and its far end
    best = (up * front[0] + down * front[1]), (up * ends[1] + down * ends[0])
    out = []
    for per in best:
        split = np.where(q > 0, per, 0), np.where(q < 0, per, 0)
        out.append(known + (per.sum(axis=1)[:, None] - split[0] @ seen[0].T
                            - split[1] @ seen[1].T))
    slack = 4e-7 * (lists.dims + 8) * (np.abs(q) @ np.abs(ends).max(axis=0))[:, None]
    return out[1] - slack, out[0] + slack


def _exact(q: np.ndarray, x: np.ndarray) -> list[int]:
    """Integer inner products of pairs of rows, clamped to 64 bits."""
    if len(q) == 0:
        return []
    size = float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * q.shape[1]
    if size < 2**62:
        return (q.astype(np.int64) * x.astype(np.int64)).sum(axis=1).tolist()
    return [max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(m, n))))
            for m, n in zip(q.tolist(), x.tolist())]


def search(lists: Lists, q: np.ndarray, floor: np.ndarray, top: int
           ) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among the ``top`` of a query or reach its ``floor``.

    Reading stops when few rows of the shard can still qualify; the rest of the lists is read only for
    queries where many can.
    """
    n, step = lists.n, lists.scale
    size = np.maximum(np.abs(q).max(axis=1, keepdims=True, initial=0.0), 1.0)
    unit = (q / size).astype(np.float32)
    least = floor / size[:, 0] * step
    least = least - np.abs(least) * 1e-6
    found: list[np.ndarray] = []
    todo = np.arange(len(q))
    for share in (*READS, 1.0):
        k = max(1, int(np.ceil(n * share)))
        low, high = bounds(lists, unit[todo], k)
        if n > top:
            nth = np.partition(low, n - top, axis=1)[:, n - top]
            least[todo] = np.maximum(least[todo], nth)
        alive = high >= least[todo][:, None]
        done = alive.sum(axis=1) <= FEW
        if share == 1.0:
            done[:] = True
        who, row = np.nonzero(alive[done])
        found.append(np.stack([todo[done][who], row]))
        todo = todo[~done]
        if len(todo) == 0:
            break
    pairs = np.concatenate(found, axis=1)
    return pairs[0], pairs[1]


def _vectors(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), dims)


def _index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("tag", ignore_index=True)
    dim, grp, shard = key
    x = _vectors(rows["v"], int(dim))
    order = np.argsort(-x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, 0)
    if np.abs(x).max(initial=0.0) < 2**31:
        values = values.astype(np.int32)
    return pd.DataFrame({
        "dim": [dim], "grp": [grp], "shard": [shard],
        "tags": [rows["tag"].to_numpy(np.int64).tobytes()],
        "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "order": [order.astype(np.uint16).tobytes()],
        "lists": [values.tobytes()]})


def _ask(top: int):
    def merge(rows: list[list[tuple]], who, scores, ids, tags) -> None:
        touched = set(who)
        for w, s, i, t in zip(who, scores, ids, tags):
            rows[w].append((-s, i, t))
        for w in touched:
            rows[w] = sorted(rows[w])[:top]

    def run(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split(" ")[0] for f in FOUND.split(", ")]
        if len(asked) == 0 or len(index) == 0:
            return pd.DataFrame(columns=columns)
        dims = int(index["dim"].iloc[0])
        q = _vectors(asked["v"], dims)
        own = asked["tag"].to_numpy(np.int64)
        best: list[list[tuple]] = [[] for _ in range(len(q))]
        for shard in index.sort_values("shard").itertuples():
            tags, ids = np.frombuffer(shard.tags, np.int64), np.frombuffer(shard.ids, np.int64)
            shape = (len(tags), dims)
            kind = np.int32 if len(shard.lists) == 4 * len(tags) * dims else np.float64
            lists = Lists(np.frombuffer(shard.order, np.uint16).reshape(shape).astype(np.int64),
                          np.frombuffer(shard.lists, kind).reshape(shape).astype(np.float64))
            rows = lists.rows()
            for at in range(0, len(q), BLOCK):
                part = slice(at, at + BLOCK)
                floor = np.array([-float(b[-1][0]) if len(b) == top else -np.inf for b in best[part]])
                who, row = search(lists, q[part], floor, top + 1)
                who = who + at
                other = tags[row] != own[who]
                who, row = who[other], row[other]
                merge(best, who.tolist(), _exact(q[who], rows[row]), ids[row].tolist(),
                      tags[row].tolist())
        flat = [(t, k, x[2], x[1], -x[0]) for t, k, b in zip(own.tolist(), asked["vec_id"].tolist(), best)
                for x in b]
        return pd.DataFrame(flat, columns=columns)
    return run


def top_inner(vectors: DataFrame, is_query, top: int = 5, shard_rows: int = SHARD_ROWS,
              group_shards: int = GROUP_SHARDS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` other rows by inner product of floor(256 x).

    ``is_query`` is a condition on rows of ``vectors`` (vec_id, embedding). Every row is dealt to a shard
    by hash; a shard holds one sorted list per dimension. Blocks of queries meet groups of shards, each
    pair in one task of bounded size; only its best rows leave it. Ties go to the smaller vec_id. Rows
    without id, null vectors and vectors with null or non-finite components (256 times them included)
    take no part; vectors of different length are not compared, empty ones score 0 with each other. Rows
    that repeat an id are rows of their own: each is a candidate for the other and asks for itself. Scores
    beyond 64 bits are clamped. Other columns are ignored.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(256.0))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), is_query.alias("asks"),
        odd.alias("odd")).filter("not odd").drop("odd")
    # floor of a double that is already whole stays as it is, however large
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    rows = materialise(rows.select("vec_id", "asks", whole.alias("v"), F.size("v").alias("dim"))
                       .withColumn("tag", F.monotonically_increasing_id()), "scaled")
    per = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking"))
    per = materialise(per.select(
        "dim", F.ceil(F.col("n") / shard_rows).alias("shards"),
        F.ceil(F.col("n") / (shard_rows * group_shards)).alias("groups"),
        F.greatest(F.ceil(F.col("asking") / query_rows), F.lit(1)).alias("blocks")), "per-length")
    # one row per vector length: broadcast while that is a few megabytes at most
    if per.count() <= 1 << 16:
        per = F.broadcast(per)
    dealt = rows.join(per, "dim").withColumn("deal", F.xxhash64("tag"))
    shard = F.pmod("deal", "shards")
    index = materialise(dealt.select("dim", F.pmod(shard, F.col("groups")).alias("grp"),
                                     shard.alias("shard"), "tag", "vec_id", "v")
                        .groupBy("dim", "grp", "shard").applyInPandas(_index, INDEX), "sorted-lists")
    asked = dealt.filter("asks").select(
        "dim", "tag", "vec_id", "v", F.pmod(F.shiftrightunsigned("deal", 20), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("grp"))
    shown = index.join(per.drop("shards", "groups"), "dim").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).toDF(
        *["dim", "of", "shard", "tags", "ids", "order", "lists", "blocks", "to"])
    found = asked.groupBy("dim", "grp", "block").cogroup(
        shown.withColumnRenamed("dim", "size").groupBy("size", "of", "to")).applyInPandas(
        _renamed(_ask(top)), FOUND)
    best = found.groupBy("tag", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("s"), "vec_id", "other", "score"))), 1, top).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def _renamed(run):
    return lambda asked, index: run(asked, index.rename(columns={"size": "dim"}))


_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op13_top_inner", _SQL)
def op13(spark, sf_dir):
    return top_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
