"""Near-duplicate vectors: a hierarchical navigable small-world graph per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import components, hot_join, query, table
from chronoweft.session import materialise

SHARD_ROWS, BLOCK_ROWS = 16_384, 16_384
DEGREE, BUILD_BEAM, BEAM, WIDEST, TOP = 16, 48, 32, 256, 64
SLACK = 1e-4
PART_ROWS, PART_NODES, CONFIRM, TASKS = 512, 4096, 65_536, 2000


class Graph:
    """Layers over unit vectors; the highest holds at most ``TOP`` nodes and is compared whole."""

    def __init__(self, vectors: np.ndarray, sizes: list[int], links: list[np.ndarray]):
        # nodes are ordered so that layer l holds the first sizes[l] of them
        self.vectors, self.sizes, self.links = vectors, sizes, links
        self.back: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        sizes = [len(vectors)]
        while sizes[-1] > TOP:
            sizes.append(max(sizes[-1] // 16, 1))
        graph = cls(vectors, sizes, [np.empty((0, 0), np.int32)] * len(sizes))
        for layer in range(len(sizes) - 2, -1, -1):
            graph._layer(layer)
        return graph

    def _layer(self, layer: int) -> None:
        n, degree = self.sizes[layer], DEGREE * (2 if layer == 0 else 1)
        links = np.full((n, degree), -1, np.int32)
        self.links[layer] = links
        at = 0
        while at < n:
            stop = min(n, max(at + 64, self.sizes[layer + 1]) if at == 0 else at + min(at, 512))
            new = np.arange(at, stop)
            v = self.vectors[new]
            sims = v @ v.T
            np.fill_diagonal(sims, -2)
            near = min(DEGREE, len(new) - 1)
            found = np.argpartition(-sims, near - 1, axis=1)[:, :near] + at if near > 0 else (
                np.empty((len(new), 0), np.int64))
            if at:
                ids, _ = self._descend(v, layer + 1)
                ids, _ = self._beam(v, ids, layer, BUILD_BEAM)
                found = np.concatenate([ids, found], axis=1)
            links[new] = self._diverse(new, found, degree)[:, :degree]
            self._back(links, new, degree)
            at = stop

    def _back(self, links: np.ndarray, new: np.ndarray, degree: int) -> None:
        source = np.repeat(new, degree)
        target = links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, n = np.unique(target, return_index=True, return_counts=True)
        if len(nodes) == 0:
            return
        width = int(n.max())
        for lo in range(0, len(nodes), 256):
            part, f, c = nodes[lo:lo + 256], first[lo:lo + 256], n[lo:lo + 256]
            extra = np.full((len(part), width), -1, np.int64)
            col = np.arange(width)[None, :]
            mask = col < c[:, None]
            extra[mask] = source[(f[:, None] + col)[mask]]
            links[part] = self._diverse(part, np.concatenate([links[part], extra], axis=1), degree)

    def _diverse(self, nodes: np.ndarray, found: np.ndarray, degree: int) -> np.ndarray:
        """Nearest first; one that is nearer to a chosen one than to the node waits."""
        found = np.where(found == nodes[:, None], -1, found)
        found = -np.sort(-found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        sims = np.einsum("bcd,bd->bc", self.vectors[np.maximum(found, 0)], self.vectors[nodes])
        sims = np.where(found < 0, -2.0, sims)
        keep = min(found.shape[1], degree * 2)
        order = np.argsort(-sims, axis=1)[:, :keep]
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        v = self.vectors[np.maximum(found, 0)]
        cross = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(found.shape, bool)
        for c in range(found.shape[1]):
            blocked = np.where(taken, cross[:, c, :], -2.0).max(axis=1) > sims[:, c]
            taken[:, c] = (found[:, c] >= 0) & ~blocked & (taken.sum(axis=1) < degree)
        rank = np.argsort(np.where(taken, 0, 1) + np.where(found < 0, 2, 0), axis=1, kind="stable")
        out = np.take_along_axis(found, rank, 1)[:, :degree]
        if out.shape[1] < degree:
            out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
        return out

    def _descend(self, q: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry points for the layer below ``layer``."""
        top = len(self.sizes) - 1
        sims = q @ self.vectors[:self.sizes[top]].T
        k = min(4, sims.shape[1])
        ids = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(sims, ids, 1)
        for at in range(top - 1, layer - 1, -1):
            ids, best = self._beam(q, ids, at, 8)
        return ids, best

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int):
        links, n = self.links[layer], self.sizes[layer]
        width = min(max(width, entry.shape[1]), n)
        rows = np.arange(len(q))[:, None]
        ids = np.full((len(q), width), -1, np.int64)
        sims = np.full((len(q), width), -2.0, np.float32)
        done = np.zeros((len(q), width), bool)
        seen = np.zeros((len(q), n + 1), bool)
        k = min(entry.shape[1], width)
        ids[:, :k] = entry[:, :k]
        e = np.einsum("qcd,qd->qc", self.vectors[np.maximum(ids[:, :k], 0)], q)
        sims[:, :k] = np.where(ids[:, :k] >= 0, e, -2.0)
        seen[rows, ids[:, :k]] = True
        while True:
            open_ = np.where(done | (ids < 0), -2.0, sims)
            pick = open_.argmax(axis=1)
            live = np.flatnonzero(np.take_along_axis(open_, pick[:, None], 1)[:, 0] > -2.0)
            if len(live) == 0:
                return ids, sims
            at = pick[live]
            done[live, at] = True
            near = links[ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            s = np.einsum("qcd,qd->qc", self.vectors[np.maximum(near, 0)], q[live])
            s = np.where(fresh, s, -2.0).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_sims = np.concatenate([sims[live], s], axis=1)
            all_done = np.concatenate([done[live], np.zeros_like(fresh)], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)

    def around(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes that a link of the lowest layer joins to one of ``nodes``, whichever way it points."""
        links, n = self.links[0], len(self.vectors)
        if self.back is None:
            flat = links.ravel()
            order = np.argsort(flat, kind="stable")
            self.back = order // links.shape[1], np.searchsorted(flat[order], np.arange(n + 1))
        source, edge = self.back
        first, count = edge[nodes], edge[nodes + 1] - edge[nodes]
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        near = np.unique(np.concatenate([links[nodes].ravel(), source[at]]))
        return near[near >= 0]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.sizes) == 1:
            sims = q @ self.vectors.T
            return np.broadcast_to(np.arange(len(self.vectors)), sims.shape), sims
        ids, _ = self._descend(q, 1)
        return self._beam(q, ids, 0, width)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def within(graph: Graph, q: np.ndarray, least: float, audit: int = 128,
           recall: float = 0.995) -> Iterator[Pairs]:
    """Pairs (query, node, similarity) of at least ``least``, each once, in bounded parts.

    Beams are doubled until an audit of evenly spaced queries against every node of the shard finds
    ``recall`` of the true hits. Where beams of ``WIDEST`` (or as wide as the shard) still fail, every query
    is compared with every node: wider beams cost more than that.
    """
    n = len(graph.vectors)
    check = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(np.int64))
    truth = q[check] @ graph.vectors.T >= least
    width, total = BEAM, truth.sum()
    while sum(int(truth[i, node].sum()) for i, node, _ in _walk(
            graph, q[check], least, width)) < recall * total:
        if width >= min(n, WIDEST):
            for at in range(0, len(q), PART_ROWS):
                yield from _compare(graph, q, np.arange(at, min(at + PART_ROWS, len(q))),
                                    np.arange(n), least)
            return
        width *= 2
    yield from _walk(graph, q, least, width)


def _walk(graph: Graph, q: np.ndarray, least: float, width: int) -> Iterator[Pairs]:
    """Beam search; queries whose every entry is a hit stand in a dense place and walk on together."""
    n, dense, seeds = len(graph.vectors), [], []
    for at in range(0, len(q), 256):
        ids, sims = graph.search(q[at:at + 256], width)
        hit = (sims >= least) & (ids >= 0)
        full = hit.all(axis=1) & (hit.shape[1] < n)
        i, j = np.nonzero(hit & ~full[:, None])
        yield i + at, ids[i, j], sims[i, j]
        dense.append(np.flatnonzero(full) + at)
        seeds.append(ids[full].astype(np.int32))
    if sum(map(len, dense)):
        yield from _flood(graph, q, np.concatenate(dense), np.concatenate(
            [s for s in seeds if len(s)]), least)


def _flood(graph: Graph, q: np.ndarray, dense: np.ndarray, seeds: np.ndarray,
           least: float) -> Iterator[Pairs]:
    """Hits reached along links from the ``seeds`` of each query, found for near queries at once.

    Links are walked both ways: in a dense place some nodes are among the nearest of no other.
    """
    while len(dense):
        near = q[dense] @ q[dense[0]] >= least
        near[0] = True
        near &= np.cumsum(near) <= PART_ROWS
        group, nodes = dense[near], np.unique(seeds[near])
        dense, seeds = dense[~near], seeds[~near]
        seen = np.zeros(len(graph.vectors), bool)
        while len(nodes):
            seen[nodes] = True
            reached = []
            for pairs in _compare(graph, q, group, nodes, least):
                reached.append(np.unique(pairs[1]))
                yield pairs
            nodes = graph.around(np.concatenate(reached))
            nodes = nodes[~seen[nodes]]


def _compare(graph: Graph, q: np.ndarray, rows: np.ndarray, nodes: np.ndarray,
             least: float) -> Iterator[Pairs]:
    for at in range(0, len(nodes), PART_NODES):
        part = nodes[at:at + PART_NODES]
        sims = q[rows] @ graph.vectors[part].T
        i, j = np.nonzero(sims >= least)
        yield rows[i], part[j], sims[i, j]


def _unit(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    v = np.array(rows.tolist(), np.float64)
    u = v / np.abs(v).max(axis=1, keepdims=True)
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    return u, u.astype(np.float32)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["deal", "vec_id"], ignore_index=True)
    exact, unit = _unit(rows["embedding"])
    graph = Graph.build(unit)
    raw = io.BytesIO()
    np.savez(raw, exact=exact, ids=rows["vec_id"].to_numpy(np.int64), n=rows["n"].to_numpy(np.int64),
             sizes=np.array(graph.sizes), **{f"l{i}": x for i, x in enumerate(graph.links)})
    return pd.DataFrame({"label": rows["label"].iloc[:1], "dim": rows["dim"].iloc[:1],
                         "shard": rows["shard"].iloc[:1], "graph": [raw.getvalue()]})


def _joined(row: np.ndarray, first: np.ndarray, me: np.ndarray) -> np.ndarray:
    """Distinct pairs of queries that share a node: place, id, other's id."""
    pair = np.unique(row[row != first] * len(me) + first[row != first])
    i, j = pair // len(me), pair % len(me)
    return np.stack([i, me[i], me[j]]).T


def _ask(least: float):
    def run(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(index) == 0:
            return pd.DataFrame({"vec_id": [], "links": [], "to": []})
        z = np.load(io.BytesIO(index["graph"].iloc[0]))
        sizes = z["sizes"].tolist()
        exact, ids, n = z["exact"], z["ids"], z["n"]
        graph = Graph(exact.astype(np.float32), sizes, [z[f"l{i}"] for i in range(len(sizes))])
        q, unit = _unit(rows["embedding"])
        links, to = np.zeros(len(q), np.int64), [[] for _ in q]
        own, mine, back = bool(rows["own"].iloc[0]), rows["n"].to_numpy(np.int64), np.zeros(len(n), np.int64)
        me, first = rows["vec_id"].to_numpy(np.int64), np.full(len(ids), -1, np.int64)
        slack = max(SLACK, exact.shape[1] * 2e-7)  # beyond it single precision is sure
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for row, node, sim in within(graph, unit, least - slack):
            good = me[row] != ids[node]
            close = np.flatnonzero(good & (sim < least + slack))
            for at in range(0, len(close), CONFIRM):
                c = close[at:at + CONFIRM]
                good[c] = np.einsum("kd,kd->k", exact[node[c]], q[row[c]]) >= least
            row, node = row[good], node[good]
            np.add.at(links, row, n[node])
            if not own:  # members of that shard do not ask this one
                np.add.at(back, node, mine[row])
            # only edges that join something in this block are sent: a node joins the first query that
            # finds it, and later ones join that query
            fresh = np.flatnonzero(first[node] < 0)
            new, at = np.unique(node[fresh], return_index=True)
            first[new] = row[fresh[at]]
            edges = np.concatenate([
                np.stack([first[new], me[first[new]], ids[new]]).T,
                _joined(row, first[node], me)])
            for i, x, y in edges.tolist():
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    to[i].append(y)
        met = np.flatnonzero(back)
        return pd.DataFrame({"vec_id": np.concatenate([me, ids[met]]),
                             "links": np.concatenate([links, back[met]]), "to": to + [[]] * len(met)})
    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, shard_rows: int = SHARD_ROWS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one class. Classes of a label are dealt to shards by hash; every shard
    has a graph, which the classes of its own and of later shards ask, in blocks; a link counts at both
    ends. Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without label or id, link with nothing; vectors of
    different length are never compared; a vec_id that repeats counts once per row.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce((F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0), F.lit(False)) & F.col(
        "label").isNotNull() & F.col("vec_id").isNotNull()
    key = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(
        e.cast("array<string>"), ",")).cast("binary"))
    rows = materialise(rows.withColumn("key", F.when(good, key)), "vectors")
    classes = materialise(rows.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "classes")
    per = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    parts = -(-shard_rows // block_rows)  # blocks of a shard
    graphs, pairs = per.agg(F.sum("shards"), F.sum(
        F.col("shards") * (F.col("shards") + 1) / 2 * parts)).first()
    # more partitions than groups, so that few groups fall together
    spread = [min(16 * int(n or 1), TASKS) for n in (graphs, pairs)]
    dealt = classes.join(per, ["label", "dim"]).withColumn("deal", F.xxhash64("key")).withColumn(
        "shard", F.pmod("deal", "shards"))
    index = materialise(dealt.repartition(spread[0], "label", "dim", "shard").groupBy(
        "label", "dim", "shard").applyInPandas(
        _index, f"label {dict(rows.dtypes)['label']}, dim int, shard bigint, graph binary"), "graphs")
    first, last = F.col("shard") * parts, F.col("shards") * parts - 1
    part = F.pmod(F.shiftrightunsigned("deal", 20), F.lit(parts))
    ask = dealt.withColumn("block", first + part).withColumn("home", F.col("shard")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), "home"))).withColumn(
        "own", F.col("shard") == F.col("home"))
    asked = index.join(per, ["label", "dim"]).withColumn("block", F.explode(F.sequence(first, last)))
    keys = ["label", "dim", "shard", "block"]
    found = materialise(
        ask.select(*keys, "vec_id", "n", "own", "embedding").repartition(spread[1], *keys).groupBy(
            *keys).cogroup(asked.select(*keys, "graph").repartition(spread[1], *keys).groupBy(
                *keys)).applyInPandas(
            _ask(least), "vec_id bigint, links bigint, to array<bigint>"), "found")
    comp = components(found.select(F.col("vec_id").alias("a"), F.explode("to").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    named = classes.select("key", "vec_id", "n").join(links, "vec_id", "left").join(
        comp.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "key", (F.col("links") + F.col("n") - 1).alias("links"),
        F.coalesce("component", "vec_id").alias("component"))
    out = hot_join(rows.select("vec_id", "key"), named, "key", classes.select("key", "n"))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


@query("op7_embeddings")
def op7(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
