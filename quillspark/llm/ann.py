"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Rows are dealt to shards of about ``shard_rows`` by a hash of their row number, never by their
vector, so copies spread. A shard's distinct vectors become the nodes of its graph. Nodes are
ordered by falling level, so the nodes of a level are a prefix, and each level's graph is one flat
array of neighbours, row by row. Layers are built from the top: nodes enter in batches, find
their neighbours by a beam search in the layer so far and by comparison within the batch, and keep those that
the usual heuristic picks (nearer to the node than to any kept neighbour).

Queries are searched in each shard, in slices of at most ``slice_rows``; each shard returns its
nearest rows, with distances in double precision on the original vectors, and the nearest of all shards are kept.

Equal vectors: a node carries the smallest ids of its rows, as many as can be returned, so ties by
id are exact however many copies there are.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part.
Vectors of another dimension than the query's are no candidates. Rows that share an id are
rows of their own. Fewer candidates than k: all are returned. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.cluster import ship, written


class Graph:
    """x: vectors, nodes by falling level. layers: from the bottom, neighbours of each of the layer's nodes, -1 where there is none."""

    def __init__(self, x: np.ndarray, layers: Sequence[np.ndarray]):
        self.x, self.layers = np.ascontiguousarray(x, np.float32), list(layers)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)

    def far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own list of nodes; infinite for -1."""
        d = self.norm[ids] - 2 * np.matmul(self.x[ids], q[:, :, None])[:, :, 0] + np.einsum("ij,ij->i", q, q)[:, None]
        return np.where(ids < 0, np.inf, d)

    def beam(self, q: np.ndarray, start: np.ndarray, layer: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ef nodes found for each query, nearest first, from its start nodes. The ``step`` nearest open nodes are expanded at once."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(layer) + 1), bool)  # the last place is for -1
        seen[:, -1] = True
        ids = np.full((len(q), ef), -1)
        ids[:, : start.shape[1]] = start[:, :ef]
        dist = self.far(q, ids)
        seen[rows, ids] = True
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[rows, order], dist[rows, order]
        open_ = ids >= 0
        live = np.arange(len(q))
        while len(live):
            some = np.arange(len(live))[:, None]
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :step]
            ok = open_[live[:, None], pick]
            at = np.where(ok, ids[live[:, None], pick], -1)
            open_[live[:, None], pick] = False
            near = np.where(at[:, :, None] >= 0, layer[at], -1).reshape(len(live), -1)
            near = np.where(seen[live[:, None], near], -1, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            seen[live[:, None], near] = True
            all_ids = np.concatenate([ids[live], near], 1)
            all_dist = np.concatenate([dist[live], self.far(q[live], near)], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            best = np.argpartition(all_dist, ef - 1, axis=1)[:, :ef]
            best = best[some, np.argsort(all_dist[some, best], axis=1, kind="stable")]
            ids[live], dist[live], open_[live] = all_ids[some, best], all_dist[some, best], all_open[some, best] & (all_ids[some, best] >= 0)
            live = live[open_[live].any(1)]
        return ids, dist

    def search(self, q: np.ndarray, ef: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """From the top layer to layer ``down_to``."""
        q = np.ascontiguousarray(q, np.float32)
        ids = np.zeros((len(q), 1), np.int64)
        dist = self.far(q, ids)
        for level in range(len(self.layers) - 1, down_to - 1, -1):
            ids, dist = self.beam(q, ids, self.layers[level], ef if level == down_to else 4)
        return ids, dist


def _pick(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` neighbours of each row's candidates (sorted by distance): each nearer to the node than to those kept before; then the nearest of the rest."""
    v = x[ids]
    n = np.einsum("bij,bij->bi", v, v)
    between = n[:, :, None] + n[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        near = np.where(kept, between[:, c, :], np.inf).min(1) if c else np.full(len(ids), np.inf)
        kept[:, c] = (ids[:, c] >= 0) & (dist[:, c] < near) & (kept.sum(1) < most)
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link(g: Graph, layer: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Links of the new nodes, and the links back; a full node picks again among old and new neighbours."""
    layer[new] = np.pad(to, ((0, 0), (0, layer.shape[1] - to.shape[1])), constant_values=-1)
    a, b = np.repeat(new, to.shape[1]), to.ravel()
    a, b = a[b >= 0], b[b >= 0]
    while len(a):
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        first = np.searchsorted(b, b, "left")
        turn = np.arange(len(b)) - first < 16  # a node takes 16 links at a time
        nodes, row = np.unique(b[turn], return_inverse=True)
        add = np.full((len(nodes), 16), -1)
        add[row, (np.arange(len(b)) - first)[turn]] = a[turn]
        add[(add[:, :, None] == layer[nodes][:, None, :]).any(2)] = -1
        for lo in range(0, len(nodes), 512):
            own = nodes[lo : lo + 512]
            ids = np.concatenate([layer[own], add[lo : lo + 512]], 1)
            dist = g.far(g.x[own], ids)
            order = np.argsort(dist, axis=1, kind="stable")
            layer[own] = _pick(g.x, np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), layer.shape[1])
        a, b = a[~turn], b[~turn]


def build(x: np.ndarray, links: int = 16, ef: int = 64, seed: int = 11, batch: int = 256) -> tuple[np.ndarray, Graph]:
    """The graph of some vectors, and the order of its nodes."""
    level = np.floor(np.random.default_rng(seed).exponential(1 / math.log(links), len(x))).astype(int)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    g = Graph(x[order], [])
    layers: list[np.ndarray] = []
    for at in range(level[0] if len(level) else 0, -1, -1):
        n = int((level >= at).sum())
        layer = np.full((n, links * (2 if at == 0 else 1)), -1, np.int64)
        done = 0
        while done < n:
            new = np.arange(done, min(n, done + max(1, min(batch, done))))
            q = g.x[new]
            inner = g.norm[new][:, None] + g.norm[new][None, :] - 2 * q @ q.T
            inner[np.arange(len(new)), np.arange(len(new))] = np.inf
            own = np.argsort(inner, axis=1)[:, :links]
            dist = np.take_along_axis(inner, own, 1)
            ids = np.where(np.isfinite(dist), new[own], -1)
            if done:
                start = np.zeros((len(new), 1), np.int64)
                for upper in layers:  # from the top
                    start = g.beam(q, start, upper, 4)[0]
                start = np.where(start < done, start, -1)
                start[(start < 0).all(1), 0] = 0
                found, far = g.beam(q, start, layer[:done], ef)
                ids, dist = np.concatenate([found, ids], 1), np.concatenate([far, dist], 1)
            by = np.argsort(dist, axis=1, kind="stable")[:, :ef]
            _link(g, layer, new, _pick(g.x, np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1), links))
            done = int(new[-1]) + 1
        layers.append(layer)
    g.layers = layers[::-1]
    return order, g


def _nodes(rid: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, and the rows of each with the smallest ids, at most ``most``."""
    by = np.lexsort((rid, ids))
    _, first, of = np.unique(x[by].view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
    group = np.argsort(of, kind="stable")
    rank = np.arange(len(group)) - np.searchsorted(of[group], of[group], "left")
    group = group[rank < most]
    return x[by][first], np.searchsorted(of[group], np.arange(len(first) + 1)), rid[by][group], ids[by][group]


def _vectors(table: pa.Table) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _build(most: int, links: int, ef: int) -> object:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, first, rid, ids = _nodes(table["rid"].to_numpy(), table["id"].to_numpy(), _vectors(table), most)
        order, g = build(x, links, ef)
        size = np.diff(first)[order]
        rows = np.concatenate([np.arange(first[k], first[k + 1]) for k in order])
        cell = lambda a, kind: pa.array([a.ravel().astype(kind).tobytes()], pa.binary())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "x": cell(x[order], "<f8"), "size": cell(size, "<i8"), "rid": cell(rid[rows], "<i8"), "ids": cell(ids[rows], "<i8"), "layers": pa.array([[y.astype("<i4").tobytes() for y in g.layers]], pa.list_(pa.binary()))})

    return run


def _search(k: int, links: int, ef: int) -> object:
    def run(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
        if shard.num_rows and queries.num_rows:
            row = shard.to_pylist()[0]
            x = np.frombuffer(row["x"], "<f8").reshape(-1, key[0].as_py())
            first = np.append(0, np.cumsum(np.frombuffer(row["size"], "<i8")))
            rid, ids = np.frombuffer(row["rid"], "<i8"), np.frombuffer(row["ids"], "<i8")
            g = Graph(x, [np.frombuffer(y, "<i4").reshape(-1, links * (1 if n else 2)).astype(np.int64) for n, y in enumerate(row["layers"])])
            q, q_rid, q_id = _vectors(queries), queries["rid"].to_numpy(), queries["id"].to_numpy()
            for lo in range(0, len(q), 128):
                found = g.search(q[lo : lo + 128], ef)[0]
                for n, nodes in enumerate(found, lo):
                    nodes = nodes[nodes >= 0]
                    dist = np.sqrt(((x[nodes] - q[n]) ** 2).sum(1))
                    near = np.argsort(dist, kind="stable")[: k + 1]  # one node may hold the query alone
                    cut = dist[near[-1]]
                    near = np.flatnonzero(dist <= cut)
                    rows = np.concatenate([np.arange(first[m], first[m + 1]) for m in nodes[near]])
                    far = np.repeat(dist[near], first[nodes[near] + 1] - first[nodes[near]])
                    rows, far = rows[rid[rows] != q_rid[n]], far[rid[rows] != q_rid[n]]
                    best = np.lexsort((ids[rows], far))[:k]
                    out.append((np.full(len(best), q_rid[n]), np.full(len(best), q_id[n]), ids[rows[best]], far[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "query_id": pa.array(cols[1], pa.int64()), "id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    return run


def nearest(rows: DataFrame, queries: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 10, shard_rows: int = 8192, slice_rows: int = 65_536, links: int = 16, ef_build: int = 64, ef: int = 192) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest other rows of each row for which ``queries`` (an expression on column ``id``) holds.

    shard_rows bounds a task's memory: the vectors, ids and neighbour arrays of so many rows.
    """
    ship(rows.sparkSession)
    good = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # array<double> holds a float's value unchanged
    table = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    table = written(table.withColumn("dim", F.size("v")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    asked = table.where(queries)
    n, n_queries = table.count(), asked.count()
    shards, parts = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / slice_rows))
    index = table.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards))).groupBy("dim", "shard").applyInArrow(_build(k + 1, links, ef_build), "dim int, shard bigint, x binary, size binary, rid binary, ids binary, layers array<binary>")
    index = written(index, "graphs")
    each = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    sent = asked.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(3)), F.lit(parts))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = each.groupBy("dim", "shard", "part").cogroup(sent.groupBy("dim", "shard", "part")).applyInArrow(_search(k, links, ef), "q bigint, query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
