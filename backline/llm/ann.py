"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Equal vectors are one node. Nodes are dealt by hash to shards of about ``SHARD_ROWS``; a shard's graph is
built by inserting nodes in growing batches: a greedy beam search proposes neighbours, robust
pruning drops a candidate if a chosen neighbour is closer to it by the factor ``ALPHA`` than the
node is, which keeps edges in diverse directions, and each edge is offered back. Queries
go to every shard in blocks of ``QUERY_BLOCK`` by beam search, and the shards' answers are merged.

In clustered vectors pruning leaves no edges between clusters, so a search has many entries: it starts from the nearest of a
random ``ENTRIES`` nodes. Of the finished graph every node is searched for, and one that its own search misses becomes an
entry too, so no piece of the graph is out of reach.

How wide a search must be depends on the vectors, so each shard measures it: ``PROBES`` of its own vectors are searched for
with beams of ``SEARCH_BEAM`` nodes and more, until these searches find ``RECALL`` of what a scan of the shard finds; a beam as wide
as the shard is a scan.

Largest inner product becomes nearest neighbour by one more coordinate that gives all vectors
the largest norm. Reported scores are inner products of the original vectors in double precision.
Vectors that are null, zero, or hold null or non-finite components and rows without an id take no part. Vectors of
one length are searched among themselves, as there is no inner product between lengths. Every row is a candidate of every other:
of repeated rows each asks for itself and finds the others, under their common id. Ties go to the smaller id. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARD_ROWS, QUERY_BLOCK, TOP, EVERY = 12_000, 8192, 20, 20
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH, EXPAND, ENTRIES = 32, 64, 128, 1.2, 512, 4, 1024
PROBES, RECALL = 64, 0.95


def beam_search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the ``beam`` nearest found, for all queries in lockstep; -1 and inf beyond."""
    m, n = len(queries), len(vectors)
    norms = (vectors**2).sum(1)
    nodes = np.full((m, beam), -1, np.int64)
    far = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    row = np.arange(m)[:, None]
    k = min(beam, len(entries))
    away = norms[entries] - 2 * queries @ vectors[entries].T
    nearest = np.argpartition(away, k - 1, axis=1)[:, :k]
    nodes[:, :k], far[:, :k], done[:, :k] = entries[nearest], away[row, nearest], False
    seen[:, entries] = True
    seen[:, n] = True
    while True:
        waiting = np.where(done, np.inf, far)
        live = np.flatnonzero(np.isfinite(waiting).any(1))
        if not len(live):
            return nodes, far
        best = np.argpartition(waiting[live], EXPAND - 1, axis=1)[:, :EXPAND]
        r = row[live]
        ok = np.isfinite(waiting[r, best])
        at = np.where(ok, nodes[r, best], n)
        done[r, best] = True
        near = edges[at].reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[r, near]
        seen[r, near] = True
        which, place = np.nonzero(fresh)
        found = near[which, place]
        d = np.full(near.shape, np.inf, np.float32)
        d[which, place] = norms[found] - 2 * np.einsum("ij,ij->i", vectors[found], queries[live[which]])
        all_far = np.concatenate([far[live], d], 1)
        all_nodes = np.concatenate([nodes[live], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[live], ~fresh], 1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(live))[:, None]
        far[live], nodes[live], done[live] = all_far[take, keep], all_nodes[take, keep], all_done[take, keep]


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours of each point among its candidates (-1: none)."""
    m, c = candidates.shape
    held = np.where(candidates < 0, 0, candidates)
    x = vectors[held]
    norms = (x**2).sum(2)
    own = vectors[points]
    to_point = norms - 2 * np.einsum("mcd,md->mc", x, own) + (own**2).sum(1)[:, None]
    order = np.sort(candidates, 1)
    repeated = np.zeros((m, c), bool)
    by = np.argsort(candidates, 1, kind="stable")
    repeated[np.arange(m)[:, None], by[:, 1:]] = order[:, 1:] == order[:, :-1]
    alive = (candidates >= 0) & (candidates != points[:, None]) & ~repeated
    between = norms[:, :, None] + norms[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
    out = np.full((m, DEGREE), -1, np.int64)
    row = np.arange(m)
    for k in range(DEGREE):
        waiting = np.where(alive, to_point, np.inf)
        pick = waiting.argmin(1)
        ok = np.isfinite(waiting[row, pick])
        if not ok.any():
            break
        out[ok, k] = candidates[row, pick][ok]
        alive &= ALPHA**2 * between[row, pick] > to_point
        alive[row, pick] = False
    return out


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, ``DEGREE``) with -1 for none, and the entry nodes."""
    n = len(vectors)
    edges = np.full((n + 1, DEGREE), -1, np.int64)
    order = np.random.default_rng(11).permutation(n)
    # All of the first batch are candidates of each other.
    first = min(n, BUILD_BEAM)
    placed = 0
    while placed < n:
        size = first if not placed else min(BATCH, placed, n - placed)
        batch = order[placed : placed + size]
        v = vectors[batch]
        inner = (v**2).sum(1)[None, :] - 2 * v @ v.T
        np.fill_diagonal(inner, np.inf)
        k = min(BUILD_BEAM // 2 if placed else BUILD_BEAM, max(size - 1, 1))
        mates = batch[np.argpartition(inner, k - 1, axis=1)[:, :k]] if size > 1 else np.full((size, 1), -1)
        proposed = mates if not placed else np.concatenate([beam_search(vectors, edges, order[: min(placed, ENTRIES)], v, BUILD_BEAM)[0], mates], 1)
        edges[batch] = robust_prune(vectors, batch, proposed)
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, begin, count = np.unique(target, return_index=True, return_counts=True)
        # Offered edges fill free places; where they don't fit, all are pruned anew.
        wide = np.full((len(ends), int(count.max()) if len(ends) else 0), -1, np.int64)
        wide[np.repeat(np.arange(len(ends)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        for lo in range(0, len(ends), BATCH):
            part = ends[lo : lo + BATCH]
            offered = np.concatenate([edges[part], wide[lo : lo + BATCH]], 1)
            offered = -np.sort(-offered, 1)
            width = int((offered >= 0).sum(1).max())
            full = (offered >= 0).sum(1) > DEGREE
            edges[part[~full]] = offered[~full][:, :DEGREE]
            if full.any():
                edges[part[full]] = robust_prune(vectors, part[full], offered[full][:, :width])
        placed += size
    entries = order[: min(n, ENTRIES)]
    missed = []
    for lo in range(0, n, BATCH):
        batch = np.arange(lo, min(lo + BATCH, n))
        found = beam_search(vectors, edges, entries, vectors[batch], BUILD_BEAM)[0]
        missed.append(batch[(found != batch[:, None]).all(1)])
    return edges[:n], np.concatenate([entries, *missed])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


_GRAPH = "length int, shard int, node bigint, least bigint, top_norm double, vector array<double>, edges array<bigint>, entry boolean, beam int"


def _wide(vectors: np.ndarray, table: pa.Table) -> np.ndarray:
    """Vectors with the coordinate that gives all the largest norm."""
    more = np.sqrt(np.maximum(table["top_norm"][0].as_py() ** 2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, more[:, None]], 1).astype(np.float32)


def _as_queries(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, np.zeros((len(vectors), 1))], 1).astype(np.float32)


def _ended(edges: np.ndarray) -> np.ndarray:
    """Edges with a row of none for the node that stands for none."""
    return np.concatenate([edges, np.full((1, DEGREE), -1, np.int64)])


def beam_needed(vectors: np.ndarray, wide: np.ndarray, edges: np.ndarray, entries: np.ndarray, beam: int, top: int = TOP) -> int:
    """The least beam, by doubling, whose searches for some of the vectors find ``RECALL`` of the ``top`` largest inner products."""
    n = len(vectors)
    asked = vectors[np.unique(np.linspace(0, n - 1, PROBES).astype(int))]
    score = asked @ vectors.T
    k = min(top, n)
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]  # ties at the end count as found
    while beam < n:
        found, _ = beam_search(wide, edges, entries, _as_queries(asked), beam)
        hits = np.where(found >= 0, np.take_along_axis(score, np.maximum(found, 0), 1), -np.inf) >= least
        if np.minimum(hits.sum(1), k).sum() >= RECALL * k * len(asked):
            break
        beam *= 2
    return min(beam, max(n, 1))


def _build(beam: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        v = _matrix(table["vector"])
        wide = _wide(v, table)
        edges, entries = build_graph(wide)
        start = np.zeros(len(v), bool)
        start[entries] = True
        beams = np.full(len(v), beam_needed(v, wide, _ended(edges), entries, beam), np.int32)
        return table.append_column("edges", pa.array(list(edges), pa.list_(pa.int64()))).append_column("entry", pa.array(start)).append_column("beam", pa.array(beams))

    return build


def _search(top: int):
    def search(graph: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if graph.num_rows and queries.num_rows:
            graph = graph.sort_by("node")
            v, q = _matrix(graph["vector"]), _matrix(queries["vector"])
            node, least, name = graph["node"].to_numpy(), graph["least"].to_numpy(), queries["query"].to_numpy()
            wide = _wide(v, graph)
            edges = _ended(np.asarray(graph["edges"].combine_chunks().flatten()).reshape(len(v), DEGREE))
            entries, beam = np.flatnonzero(graph["entry"].to_numpy()), max(graph["beam"][0].as_py(), top)
            for at in range(0, len(q), BATCH):
                part = _as_queries(q[at : at + BATCH])
                found, _ = beam_search(wide, edges, entries, part, beam)
                for i, row in enumerate(found):
                    row = row[row >= 0]
                    score = (v[row] * q[at + i]).sum(1)
                    best = np.lexsort((least[row], -score))[:top]
                    out[0].append(np.full(len(best), name[at + i]))
                    out[1].append(node[row[best]])
                    out[2].append(score[best])
        query, found, score = (np.concatenate(x) if x else [] for x in out)
        return pa.table({"query": pa.array(query, pa.int64()), "node": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    return search


def nearest(embeddings: DataFrame, is_query, top: int = TOP, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` rows of largest inner product found for each query row, itself left out."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", is_query.alias("asks")).where(usable)
    # Negative zero equals zero.
    rows = rows.withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0))).drop("embedding")
    classes = rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.max(F.col("asks").cast("int")).alias("asks"))
    # Numbered and written in one step, so that a number stays with its vector.
    nodes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "vector", "least", "asks", F.size("vector").alias("length")))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # A row a length; written, so that the planner knows its size.
    groups = materialise(nodes.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.max(norm).alias("top_norm")))
    dealt = nodes.join(groups, "length").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards").cast("bigint")).cast("int"))
    graph = materialise(dealt.select("length", "shard", "node", "least", "top_norm", "vector").groupBy("length", "shard").applyInArrow(_build(beam), _GRAPH))
    asking = nodes.where("asks = 1").select(F.col("node").alias("query"), "vector", "length")
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).join(groups.select("length", "shards"), "length")
    sent = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    held = graph if blocks == 1 else graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["length", "shard"] if blocks == 1 else ["length", "shard", "block"]
    answers = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(top + 1), "query bigint, node bigint, score double")
    # A node stands for the rows of its smallest ids, as many as an answer can need; the limit works before the shuffle.
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    copy = F.row_number().over(Window.partitionBy("vector", "vec_id").orderBy("vec_id")).alias("copy")
    ids = rows.select("vector", "vec_id").withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= top + 1).select("vector", "vec_id", copy)
    ids = ids.join(nodes.select("vector", "node"), "vector").select("node", "vec_id", "copy")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "copy")
    ranked = answers.join(ids, "node").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top + 1)
    ranked = ranked.groupBy("query").agg(F.collect_list(F.struct("score", "vec_id", (F.col("node") == F.col("query")).alias("own"), "copy")).alias("answers"))
    asked = rows.where("asks").select("vector", F.col("vec_id").alias("query_id"))
    asked = asked.withColumn("row", F.row_number().over(Window.partitionBy("vector", "query_id").orderBy("query_id")))
    asked = asked.join(nodes.select("vector", F.col("node").alias("query")), "vector").select("query_id", "row", "query")
    itself = F.col("a.own") & (F.col("a.vec_id") == F.col("query_id")) & (F.col("a.copy") == 1)
    both = asked.join(ranked, "query").withColumn("a", F.explode("answers")).where(~itself)
    last = Window.partitionBy("query_id", "query", "row").orderBy(F.desc("a.score"), "a.vec_id", "a.copy")
    return both.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("query_id", "rank", "a.vec_id", "a.score")


def nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """op9: queries are the rows whose id is divisible by 20."""
    return nearest(embeddings, F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)
