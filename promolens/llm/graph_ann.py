"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt into shards of a bounded size by hash. In each shard vectors are
inserted in batches: a greedy beam search over the graph so far proposes neighbours, and relaxed
distance pruning keeps the diverse ones (a candidate goes if a kept neighbour is ``ALPHA`` times
closer to it than the vector is). Kept edges are also entered backwards, and a full list is pruned
again. A query runs a beam search in every shard; the best of all shards are its answer, with
scores taken in double precision on the original vectors. Every row is indexed.

Equal vectors (by a 64-bit hash of their components) are one node, which stands for its smallest
vec_ids; equal queries search once.

Vectors that are null, zero or hold null or non-finite components take no part; neither do rows
with a null vec_id. Only vectors of a query's length are its candidates. Repeated rows count once. A
vec_id with several vectors queries with each and is found by its nearest. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .pivot_join import cosine
from .vectors import matrix, unit, usable

DEGREE = 48
BUILD_BEAM = 64
SEARCH_BEAM = 48
ALPHA = 1.2
SHARD = 8192
#: Queries that one task asks; a shard's graph is sent once for each block of them.
QUERY_BLOCK = 16384
EXPAND = 4
_BATCH = 256


def beam_search(u: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes found, nearest first (-1: none), and their squared distances."""
    n, width = len(q), graph.shape[1]
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    todo = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(u)), bool)
    ids[:, 0], dist[:, 0], todo[:, 0], seen[:, start] = start, 2 - 2 * (q @ u[start]), True, True
    active = np.arange(n)
    while len(active):
        t = todo[active]
        pick = t & (np.cumsum(t, axis=1) <= EXPAND)
        r, c = np.nonzero(pick)
        todo[active[r], c] = False
        new = graph[ids[active[r], c]]
        row = np.repeat(active[r], width)
        new = new.ravel()
        ok = new >= 0
        row, new = row[ok], new[ok]
        ok = ~seen[row, new]
        row, new = row[ok], new[ok]
        key = np.unique(row * len(u) + new)
        row, new = key // len(u), key % len(u)
        seen[row, new] = True
        d = 2 - 2 * np.einsum("ij,ij->i", u[new], q[row])
        better = d < dist[row, -1]
        row, new, d = row[better], new[better], d[better]
        if len(row):
            rows, first, size = np.unique(row, return_index=True, return_counts=True)
            most = int(size.max())
            add_i = np.full((len(rows), most), -1, np.int64)
            add_d = np.full((len(rows), most), np.inf, np.float32)
            at = np.repeat(np.arange(len(rows)), size), np.arange(len(row)) - np.repeat(first, size)
            add_i[at], add_d[at] = new, d
            all_i, all_d = np.concatenate([ids[rows], add_i], 1), np.concatenate([dist[rows], add_d], 1)
            all_t = np.concatenate([todo[rows], add_i >= 0], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            ids[rows], dist[rows], todo[rows] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_t))
        active = active[todo[active].any(axis=1)]
    return ids, dist


def robust_prune(u: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of ``p`` up to ``degree`` diverse ones of its candidates (-1: none)."""
    out = np.full((len(p), degree), -1, np.int64)
    width = cand.shape[1]
    chunk = max(1, (1 << 22) // (width * width))
    for s in range(0, len(p), chunk):
        c, me = cand[s:s + chunk], p[s:s + chunk]
        alive = (c >= 0) & (c != me[:, None])
        x = u[np.maximum(c, 0)]
        d = 2 - 2 * np.einsum("ij,ikj->ik", u[me], x)
        d[~alive] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        c, d, alive = (np.take_along_axis(a, order, 1) for a in (c, d, alive))
        x = np.take_along_axis(x, order[:, :, None], 1)
        between = 2 - 2 * (x @ x.transpose(0, 2, 1))
        have = np.zeros(len(c), np.int64)
        rows = np.flatnonzero(alive.any(axis=1))
        while len(rows):
            j = alive[rows].argmax(axis=1)
            out[s + rows, have[rows]] = c[rows, j]
            have[rows] += 1
            alive[rows] &= alpha * alpha * between[rows, j] > d[rows]
            alive[rows, j] = False
            rows = rows[(have[rows] < degree) & alive[rows].any(axis=1)]
    return out


def build_graph(u: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each node, -1 padded; the node to start at)."""
    n = len(u)
    start = int((u @ u.mean(axis=0)).argmax())
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    graph = np.full((n, degree), -1, np.int64)
    done = 1
    while done < n:
        batch = order[done:done + min(_BATCH, done)]
        found, _ = beam_search(u, graph, start, u[batch], beam)
        graph[batch] = robust_prune(u, batch, found, degree, alpha)
        src, slot = np.nonzero(graph[batch] >= 0)
        to, back = graph[batch][src, slot], batch[src]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        node, first, size = np.unique(to, return_index=True, return_counts=True)
        most = int(size.max()) if len(size) else 0
        add = np.full((len(node), most), -1, np.int64)
        add[np.repeat(np.arange(len(node)), size), np.arange(len(to)) - np.repeat(first, size)] = back
        both = np.concatenate([graph[node], add], 1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        fits = (both >= 0).sum(1) <= degree
        graph[node[fits]] = both[fits, :degree]
        if not fits.all():
            graph[node[~fits]] = robust_prune(u, node[~fits], both[~fits], degree, alpha)
        done += len(batch)
    return graph, start


def build_index(nodes: DataFrame, shard: int = SHARD, n: int | None = None) -> DataFrame:
    """dim, shard, pos, node, v, near (positions in the shard), start: the graphs, from (node, v)."""
    shards = (n if n is not None else nodes.count()) // shard + 1

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        graph, start = build_graph(unit(matrix(t["v"])).astype(np.float32))
        size = (graph >= 0).sum(axis=1)
        near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(graph[graph >= 0], pa.int32()))
        return pa.table({"dim": t["dim"], "shard": t["shard"], "pos": pa.array(np.arange(len(t)), pa.int32()), "node": t["node"],
                         "v": t["v"], "near": near, "start": pa.array(np.full(len(t), start), pa.int32())})

    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v")
    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, pos int, node long, v array<double>, near array<int>, start int")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM, n_queries: int | None = None) -> DataFrame:
    """query, node, score: the k nearest nodes that each shard finds for each of (query, v)."""
    blocks = (n_queries if n_queries is not None else queries.count()) // QUERY_BLOCK + 1
    shards = index.select(F.col("dim").alias("_dim"), "shard").distinct()
    asked = (queries.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
             .join(shards, F.col("dim") == F.col("_dim")).select("dim", "shard", "block", "query", "v"))
    copies = index.select(*[F.col(c).alias(c) for c in index.columns], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(graph: pa.Table, ask: pa.Table) -> pa.Table:
        out = {"query": [], "node": [], "score": []}
        if graph.num_rows and ask.num_rows:
            graph = graph.sort_by("pos")
            m, node = matrix(graph["v"]), graph["node"].to_numpy()
            near = graph["near"].combine_chunks() if isinstance(graph["near"], pa.ChunkedArray) else graph["near"]
            if isinstance(near, pa.ChunkedArray):
                near = pa.concat_arrays(near.chunks)
            size = pa.compute.list_value_length(near).to_numpy()
            edges = np.full((len(m), max(1, int(size.max()))), -1, np.int64)
            edges[np.repeat(np.arange(len(m)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = near.flatten().to_numpy()
            u, qm, query = unit(m).astype(np.float32), matrix(ask["v"]), ask["query"].to_numpy()
            for s in range(0, len(qm), _BATCH):
                ids, _ = beam_search(u, edges, graph["start"][0].as_py(), unit(qm[s:s + _BATCH]).astype(np.float32), beam)
                r, c = np.nonzero(ids >= 0)
                score = cosine(qm[s + r], m[ids[r, c]])
                order = np.lexsort((node[ids[r, c]], -score, r))
                r, c, score = r[order], c[order], score[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
                top = rank < k
                out["query"].append(query[s + r[top]])
                out["node"].append(node[ids[r[top], c[top]]])
                out["score"].append(score[top])
        return pa.table({name: pa.array(np.concatenate(x) if x else [], t) for (name, x), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    keys = ("dim", "shard", "block")
    return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(lambda a, g: run(g, a), "query long, node long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 5, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for the rows with ``is_query``."""
    rows = store(usable(vectors).where("vec_id IS NOT NULL"), "rows")
    named = store(rows.distinct().withColumn("node", F.xxhash64("v")), "named")
    by_id = Window.partitionBy("node").orderBy("vec_id")
    members = store(named.withColumn("i", F.row_number().over(by_id)).where(F.col("i") <= k + 1), "members")
    nodes = members.where("i = 1").select("node", "v")
    asking = store(named.where(is_query), "asking")
    index = store(build_index(nodes, shard, nodes.count()), "graph")
    ask = asking.groupBy("node").agg(F.first("v").alias("v")).withColumnRenamed("node", "query")
    ask = store(ask, "queries")
    found = store(search_index(index, ask, k + 1, beam, ask.count()), "found")
    best = found.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).where(F.col("i") <= k + 1)
    answers = (asking.select(F.col("node").alias("query"), F.col("vec_id").alias("query_id")).join(best, "query")
               .join(members.select("node", "vec_id"), "node").where("vec_id <> query_id")
               .groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
