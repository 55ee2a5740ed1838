"""Operator 10: approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size. In each shard, greedy searches from a medoid propose neighbours
for every vector and relaxed distance pruning keeps a few diverse ones; a beam search answers each block of queries on
each shard. Largest inner product becomes smallest distance by one more coordinate that makes all norms equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table


def distances(points: np.ndarray, norms: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own norm, of each query to its row of points."""
    return norms[rows] - 2 * np.einsum("qd,qcd->qc", queries, points[rows], optimize=False)


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest points that a greedy walk from ``start`` meets, nearest first, and their distances.

    Each round expands the ``step`` nearest unexpanded points of every query; a query stops when its beam is expanded.
    """
    q, n = len(queries), len(points)
    beam = min(beam, n)
    ids = np.full((q, beam), -1, dtype=np.int64)
    far = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.zeros((q, beam), dtype=bool)
    seen = np.zeros((q, n), dtype=bool)
    width = min(len(start), beam)
    ids[:, :width] = start[:width]
    far[:, :width] = distances(points, norms, queries, ids[:, :width])
    seen[:, start[:width]] = True
    live = np.arange(q)
    while len(live):
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
        pick = np.argpartition(open_, min(step, beam) - 1, axis=1)[:, :step]
        good = np.isfinite(np.take_along_axis(open_, pick, axis=1))
        keep = good.any(axis=1)
        live, pick, good = live[keep], pick[keep], good[keep]
        if not len(live):
            break
        done[live[:, None], pick] |= good
        near = graph[np.where(good, ids[live[:, None], pick], 0)]
        near = np.where(good[:, :, None], near, -1).reshape(len(live), -1)
        new = (near >= 0) & ~seen[live[:, None], near]
        order = np.argsort(near, axis=1, kind="stable")  # a point proposed twice in a round counts once
        ranked = np.take_along_axis(near, order, axis=1)
        again = np.zeros_like(new)
        np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
        new &= ~again
        r, c = np.nonzero(new)
        seen[live[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[r, c] = norms[near[r, c]] - 2 * np.einsum("nd,nd->n", queries[live[r]], points[near[r, c]])
        all_far = np.concatenate([far[live], d], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_done = np.concatenate([done[live], np.zeros_like(new)], axis=1)
        top = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[live] = np.take_along_axis(all_far, top, axis=1)
        ids[live] = np.where(np.isfinite(far[live]), np.take_along_axis(all_ids, top, axis=1), -1)
        done[live] = np.take_along_axis(all_done, top, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``own`` up to ``degree`` of its candidates (-1: none), nearest first; a candidate falls once a kept
    one is nearer to it, by the factor ``alpha``, than the point itself."""
    out = np.full((len(own), degree), -1, dtype=np.int64)
    for k in range(0, len(own), 128):
        mine, cand = own[k : k + 128], candidates[k : k + 128]
        held = points[cand]
        dist = ((held - points[mine][:, None, :]) ** 2).sum(axis=2)
        norm = (held**2).sum(axis=2)
        among = norm[:, :, None] + norm[:, None, :] - 2 * held @ held.transpose(0, 2, 1)
        dist = np.where((cand < 0) | (cand == mine[:, None]), np.inf, dist)
        alive, rows = np.isfinite(dist), np.arange(len(mine))
        for slot in range(degree):
            best = np.where(alive, dist, np.inf).argmin(axis=1)
            good = alive[rows, best]
            if not good.any():
                break
            out[k : k + 128][good, slot] = cand[rows, best][good]
            fallen = alpha * alpha * among[rows, best] <= dist
            alive &= ~(fallen & good[:, None])
            alive[rows, best] = False
    return out


def build_graph(points: np.ndarray, *, degree: int, beam: int, alpha: float, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Out-neighbours of each point, (n, degree) with -1 for none, and the starting points of a search."""
    n, rng = len(points), np.random.default_rng(seed)
    norms = (points**2).sum(axis=1)
    start = np.array([int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())])
    graph = rng.integers(0, n, (n, min(degree, max(1, n - 1))))
    graph = np.where(graph == np.arange(n)[:, None], (graph + 1) % n, graph)
    if graph.shape[1] < degree:
        graph = np.pad(graph, ((0, 0), (0, degree - graph.shape[1])), constant_values=-1)
    if n == 1:
        return np.full((1, degree), -1), start
    order = rng.permutation(n)
    for k in range(0, n, 512):
        own = order[k : k + 512]
        found, _ = beam_search(points, norms, graph, start, points[own], beam)
        graph[own] = robust_prune(points, own, np.concatenate([found, graph[own]], axis=1), degree, alpha)
        # Edges back: every new neighbour gets the point as a candidate.
        targets, sources = graph[own].ravel(), np.repeat(own, degree)
        targets, sources = targets[targets >= 0], sources[graph[own].ravel() >= 0]
        rank = np.argsort(targets, kind="stable")
        targets, sources = targets[rank], sources[rank]
        nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 1024):
            some = nodes[lo : lo + 1024]
            wide = count[lo : lo + 1024].max()
            at = first[lo : lo + 1024, None] + np.arange(wide)
            more = np.where(np.arange(wide) < count[lo : lo + 1024, None], sources[np.minimum(at, len(sources) - 1)], -1)
            both = np.sort(np.concatenate([graph[some], more], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(axis=1) > degree
            fits = -np.sort(-both[~full], axis=1)[:, :degree]
            graph[some[~full]] = fits
            if full.any():
                graph[some[full]] = robust_prune(points, some[full], both[full], degree, alpha)
    return graph, start


def build_index(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = 8192, degree: int = 40, beam: int = 96, alpha: float = 1.15,
) -> tuple[DataFrame, DataFrame]:
    """The usable rows (vec_id, embedding), and one graph per shard, written to the shared folder.

    Null and zero vectors, and those with null or non-finite components, take no part. Equal vectors are one point of a
    graph with its k + 1 smallest ids, which are all that an answer of k with ties to smaller ids can hold.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = raw.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    # Ranked within equal vectors; Spark keeps k + 1 of each in every task before the shuffle.
    ranked = rows.withColumn("place", F.expr("row_number() over (partition by embedding order by vec_id)")).where(F.col("place") <= k + 1)
    points = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "points")
    shards = max(1, -(-points.count() // shard_rows))
    largest = points.agg(F.max(F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)"))).first()[0] or 0.0

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        exact = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        extra = np.sqrt(np.maximum(largest - (exact**2).sum(axis=1), 0))
        lifted = np.concatenate([exact, extra[:, None]], axis=1)
        # Moved to the middle before it is rounded: one far longer vector must not blur the distances of the others.
        lifted = (lifted - np.median(lifted, axis=0)).astype(np.float32)
        graph, start = build_graph(lifted, degree=degree, beam=beam, alpha=alpha)
        ids = [np.asarray(x, dtype=np.int64) for x in pdf["ids"]]
        return pd.DataFrame({
            "shard": [pdf["shard"].iloc[0]], "dim": [exact.shape[1]], "points": [exact.tobytes()], "graph": [graph.astype(np.int32).tobytes()],
            "start": [start.astype(np.int64).tobytes()], "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(x) for x in ids], dtype=np.int64).tobytes()],
        })

    # Vectors of different length are never compared: each length has shards of its own.
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("long")).withColumn("size", F.size("embedding"))
    index = dealt.groupBy("shard", "size").applyInPandas(build, "shard long, dim int, points binary, graph binary, start binary, ids binary, counts binary")
    return rows, materialize(index, "graphs")


def search(index: DataFrame, queries: DataFrame, *, k: int = 20, beam: int = 256, degree: int = 40, block_rows: int = 1024) -> DataFrame:
    """The k nearest found of each query (vec_id, embedding): query_id, rank, vec_id, score.

    Queries go in blocks to every shard whose vectors have their length; a query's own row is never an answer. Scores
    are inner products of the original vectors in double precision; ties go to the smaller id.
    """
    blocks = max(1, -(-queries.count() // block_rows))
    shards = [r["shard"] for r in index.select("shard").distinct().collect()]

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "query_ids": [pdf["vec_id"].to_numpy(dtype=np.int64).tobytes()], "query_vectors": [np.stack(pdf["embedding"].to_numpy()).astype(np.float64).tobytes()]})

    dealt = queries.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("block"))
    asked = dealt.groupBy("block", "dim").applyInPandas(gather, "block long, dim int, query_ids binary, query_vectors binary")
    asked = asked.withColumn("shard", F.explode(F.array(*[F.lit(s).cast("long") for s in shards])) if shards else F.lit(None).cast("long"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                exact = np.frombuffer(row.points).reshape(-1, row.dim)
                graph = np.frombuffer(row.graph, dtype=np.int32).reshape(len(exact), -1).astype(np.int64)
                counts, ids = np.frombuffer(row.counts, dtype=np.int64), np.frombuffer(row.ids, dtype=np.int64)
                first = np.cumsum(counts) - counts
                who, asked = np.frombuffer(row.query_ids, dtype=np.int64), np.frombuffer(row.query_vectors).reshape(-1, row.dim)
                # All lifted norms are equal, so the order by distance is that of the inner products alone.
                points, wanted, norms = exact.astype(np.float32), asked.astype(np.float32), np.zeros(len(exact), dtype=np.float32)
                start = np.frombuffer(row.start, dtype=np.int64)
                for lo in range(0, len(who), 512):
                    found, _ = beam_search(points, norms, graph, start, wanted[lo : lo + 512], beam)
                    found = found[:, : 2 * k + 2]
                    q, c = np.nonzero(found >= 0)
                    point = found[q, c]
                    score = np.array([np.dot(asked[lo + a], exact[b]) for a, b in zip(q.tolist(), point.tolist())]) if len(q) else np.zeros(0)
                    times = counts[point]
                    q, score = np.repeat(q, times), np.repeat(score, times)
                    at = np.repeat(first[point] - np.cumsum(times) + times, times) + np.arange(times.sum())
                    out = pd.DataFrame({"query_id": who[lo + q], "vec_id": ids[at], "score": score})
                    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                    yield out.groupby("query_id", sort=False).head(k)

    met = asked.join(index.withColumnRenamed("dim", "size"), "shard").where("dim = size").drop("size", "block")
    found = met.mapInPandas(answer, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found of every row whose id is divisible by 20."""
    rows, index = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, rows.where(F.col("vec_id") % 20 == 0))
