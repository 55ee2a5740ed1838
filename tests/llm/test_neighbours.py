import math

import numpy as np

from gleaner.llm.neighbours import build_index, op10_graph_neighbours, search


def brute(rows, queries, k):
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q, v in queries:
        score = m @ np.asarray(v, dtype=np.float64)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_recall_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    vectors = dict(rows)
    for r in op10_graph_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert math.isclose(r.score, float(np.dot(np.asarray(vectors[r.query_id], dtype=float), np.asarray(vectors[r.vec_id], dtype=float))), abs_tol=1e-12)
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(set(v)) == 20 for v in got.values())
    recall = np.mean([len({*got[q]} & {x for x, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95, recall


def test_copies_bad_vectors_and_several_shards(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(1000 + k, [1.0] * 8) for k in range(60)] + [(5000, [3.0] * 8), (5001, [0.0] * 8), (5002, None), (5003, [float("nan")] + [1.0] * 7), (5004, [None] + [1.0] * 7), (5006, [float("inf")] * 8), (5005, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as shard", "2 as ids")
    good, index = build_index(frame, shard_rows=100)
    fine = [r for r in rows if r[0] not in (5001, 5002, 5003, 5004, 5005, 5006)]
    queries = [r for r in fine if r[0] % 20 == 0]
    got = {}
    for r in search(index, good.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute([(k, np.float32(v).tolist()) for k, v in fine], queries, 20)
    assert got.keys() == want.keys()
    assert got[1000] == [x for x, _ in want[1000]] and got[1000][0] == 5000
    assert np.mean([len({*got[q]} & {x for x, _ in want[q]}) / 20 for q in want]) > 0.97
    none, empty = build_index(frame.limit(0))
    assert search(empty, none).count() == 0


def test_recall_over_full_shards_with_uneven_norms(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9000, 24)) * rng.lognormal(0, 0.3, size=(9000, 1))
    m[77] *= 10_000 / np.linalg.norm(m[77])
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m.astype(np.float32))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good, index = build_index(frame, shard_rows=4096)
    want, got = brute(rows, [r for r in rows if r[0] % 60 == 0], 20), {}
    for r in search(index, good.where("vec_id % 60 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {x for x, _ in want[q]}) / 20 for q in want])
    print("recall", recall)
    assert got.keys() == want.keys() and recall >= 0.95, recall
