"""Every query of the library against its SQL, and those without SQL against plain Python."""

import random
import struct
import zlib

import numpy as np
import pytest
from compare import difference
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import groups as G
from gleaner.operators import learning as L
from gleaner.operators import ordered as W
from gleaner.operators import pairs as J
from gleaner.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SF), SF, catalog.ORACLES[name]) is None


def leaders(nodes, edges):
    """The sequential rule: the best remaining node leads and takes its direct neighbours."""
    left, out = sorted(nodes), {}
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in nodes}
    # A node leads unless an earlier neighbour does; members go to their best leader.
    leads = {}
    for n in left:
        leads[n] = not any(leads[m] for m in near[n] if m < n)
    for n in left:
        if near[n]:
            out[n] = n if leads[n] and any(not leads[m] and min(x for x in near[m] if leads[x]) == n for m in near[n]) else None if leads[n] else min(m for m in near[n] if leads[m])
    return {n: x for n, x in out.items() if x is not None}


def test_leader_split_equals_the_sequential_rule(spark):
    rng = random.Random(1)
    nodes = list(range(60))
    edges = {tuple(sorted(rng.sample(nodes, 2))) for _ in range(70)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r.n: r.leader for r in G.leader_split(spark.createDataFrame([(n,) for n in nodes], "n long"), frame, key="n", rank="n").collect()}
    assert got == leaders(nodes, edges)


def test_diversity_equals_the_sequential_rule(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(50), 2))) for _ in range(160)}
    kept = []
    for n in range(50):
        if sum((min(n, m), max(n, m)) in edges for m in kept) < 2:
            kept.append(n)
    items = spark.createDataFrame([(n,) for n in range(50)], "n long")
    out = G.diversity_demotions(items, spark.createDataFrame(sorted(edges), "src long, dst long"), key="n", rank="n", cap=2).where("kept")
    assert sorted(r.n for r in out.collect()) == kept


def test_series_picks_equal_the_sequential_rule_without_whole_groups(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1, 1, 1, 2, 3]), [rng.gauss(0, 1) for _ in range(4)] if k % 50 else [0.0] * 4, rng.choice([0.9, 0.95, 0.99, 1.0, 0.5, None])) for k in range(400)]
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)  # one task would hold a whole group
    frame = spark.createDataFrame(rows, "id long, g int, v array<double>, q double").repartition(5)
    got = {(r.g, r.id, r.pick) for r in G.series_picks(frame, by=["g"], key="id", vector="v", quality="q", most=4, alike=0.5).collect()}
    want = set()
    for g in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[1] == g and r[3] is not None), key=lambda r: (-r[3], r[0]))
        chosen = []
        for _, (k, _, v, q) in enumerate(own):
            u = np.array(v) / max(np.linalg.norm(v), 1e-8)
            if len(chosen) < 4 and q >= own[0][3] - 0.08 and all(c @ u < 0.5 for c in chosen):
                chosen.append(u)
                want.add((g, k, len(chosen)))
    assert got == want and len(want) > 10


def test_rankers_reach_the_least_loss_without_whole_profiles(spark, monkeypatch):
    from gleaner.operators.learning import fit_pairwise_ranker

    rng = np.random.default_rng(5)
    truth, rows = rng.normal(size=6), []
    for k in range(300):
        a, b = rng.normal(size=6), rng.normal(size=6)
        good = (a - b) @ truth + rng.normal() > 0
        rows.append((k % 2, a.tolist() if good else b.tolist(), b.tolist() if good else a.tolist()))
    rows += [(7, [1.0] * 6, [0.0] * 6), (0, None, [1.0] * 6), (0, [1.0], [2.0])]
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandas", None)  # one task would hold a whole profile
    got = {r.p: (np.array(r.weights), r.n) for r in fit_pairwise_ranker(spark.createDataFrame(rows, "p long, preferred array<double>, rejected array<double>").repartition(5), by="p").collect()}
    assert got.keys() == {0, 1} and got[1][1] == 150
    for p in (0, 1):
        x = np.array([np.array(a) - b for q, a, b in rows[:300] if q == p])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        w = np.zeros(6)
        for _ in range(5000):
            w += (1 / (1 + np.exp(x @ w))) @ x / len(x) - 0.015 * w
            w *= min(1, 3 / np.linalg.norm(w))
        assert np.abs(w - got[p][0]).max() < 0.02


def test_reranked_groups_keep_ids_of_the_same_members(spark):
    from gleaner.operators.groups import member_digest, rerank_groups

    members = spark.createDataFrame([(1, 10, 1, 0.1), (2, 10, 1, 0.9), (3, 10, 1, 0.5), (4, 20, 4, 0.2), (5, 20, 4, 0.8), (6, 30, 6, 1.0)], "id long, grp long, leader long, s double")
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (5, 6)], "src long, dst long")
    before = spark.createDataFrame([(1, "a"), (2, "a"), (4, "b"), (5, "b")], "id long, group_id string")
    got = {r.id: (r.group_id, r.leader, r.n) for r in rerank_groups(members, edges, before, key="id", score="s").collect()}
    digest = {r.grp: r.digest for r in member_digest(members, by="grp", key="id").collect()}
    first = "series-" + digest[10][:12]
    assert got == {1: (first, 1, 3), 2: (first, 1, 3), 3: (first, 1, 3), 4: ("b", 5, 2), 5: ("b", 5, 2), 6: ("series-" + digest[30][:12], 6, 1)}


def test_reliability_trusts_training_accuracy_by_half(spark):
    names = "held_pairs held_accuracy held_items held_contexts own_pairs own_accuracy own_items own_contexts".split()
    rows = [(3, 1.0, 24, 3, 9, 0.5, 24, 3), (2, 1.0, 24, 3, 60, 1.0, 24, 3), (0, None, 0, 0, 9, None, 9, 9), (5, 0.4, 24, 3, 60, 1.0, 24, 3), (9, 0.75, 12, 3, 9, 1.0, 48, 2)]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" if "accuracy" in n else f"{n} long" for n in names))
    assert [r.x for r in frame.select(X.ranker_reliability({n: F.col(n) for n in names}).alias("x")).collect()] == [1.0, 0.5, 0.0, 0.0, 0.25]


def test_thresholds_are_exact_at_every_ratio(spark):
    rng = random.Random(4)
    rows = [("a", rng.random() * 100) for _ in range(20000)] + [("b", float(rng.randrange(3))) for _ in range(5000)] + [("c", 7.0), ("d", None), ("e", -5.0), ("e", 250.0)]
    frame = spark.createDataFrame(rows, "g string, s double").repartition(9)
    for ratio in (0.0, 0.001, 0.45, 1.0):
        want = {}
        for g in "abcde":
            v = sorted((min(max(s, 0.0), 100.0) for h, s in rows if h == g and s is not None), reverse=True)
            want[g] = v[max(int(np.ceil(len(v) * ratio)), 1) - 1] if v else 60.0
        assert {r.g: r.threshold for r in W.selection_threshold(frame, by=["g"], score="s", ratio=ratio, default=60.0).collect()} == want


@pytest.mark.parametrize("bands", [J.BANDS_64, J.BANDS_60])
def test_signature_pairs_lose_no_flip_pattern(spark, bands):
    rng, rows = random.Random(3), []
    width = sum(bands)
    for _ in range(30):
        a = rng.getrandbits(width)
        for flips in (0, 1, 5, 10):
            b = a
            for k in rng.sample(range(width), flips):
                b ^= 1 << k
            rows += [(a,), (b,)]
    rows = [(x - (1 << 64) if x >= 1 << 63 else x,) for (x,) in rows]
    frame = spark.createDataFrame(rows, "s long")
    got = {(r.src, r.dst) for r in J.signature_pairs(frame, signature="s", bands=bands).collect()}
    own = sorted({x for (x,) in rows})
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 10}
    assert got == want


def test_interval_pairs_keep_all_of_a_dense_second(spark):
    rows = [(k, 1_000_000 * (k % 3), "a") for k in range(41)] + [(99, 200_000_000, "a"), (100, None, "a")]
    frame = spark.createDataFrame(rows, "id long, t long, g string")
    assert J.interval_pairs(frame, key="id", micros=F.col("t"), within=120, by=["g"]).count() == 41 * 40 // 2


def test_ranks_of_nulls_ties_and_single_rows(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 1.0), ("b", 5.0), ("c", None)], "g string, v double")
    got = sorted(((r.g, r.v, r.p) for r in W.percentile_rank(frame, "v", by=["g"], out="p").collect()), key=str)
    assert got == sorted([("a", 1.0, 1.0), ("a", None, None), ("a", 1.0, 1.0), ("b", 5.0, 0.5), ("c", None, None)], key=str)


def test_unknown_gaps_never_split(spark):
    rows = [(k, t) for k, t in enumerate([0, 10, None, 20, 5000, 5010])]
    frame = spark.createDataFrame(rows, "id long, s long").withColumn("g", F.lit(1))
    out = W.adaptive_episodes(frame, micros=F.col("s") * 1_000_000, by=["g"], order=["id"], high=1800).orderBy("id")
    assert [r.episode for r in out.collect()] == [0, 0, 0, 0, 1, 1]


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0]), (None, [1.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [1.0, None, None, None, None]


@pytest.mark.parametrize("partitions", [1, 17])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(partitions)
    out = J.cosine_pairs(docs, key="vec_id", vector="embedding", threshold=0.25, by=["label"], block=16)
    assert difference(out.withColumn("cosine", F.round("cosine", 6)), SF, catalog.ORACLES["j17_cosine_pairs"]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).head(1)


def png(cells):
    """A grey PNG of rows of 0..255."""
    raw = b"".join(b"\0" + bytes(row) for row in cells)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(cells[0]), len(cells), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_measured(spark, tmp_path):
    from gleaner.sources.images import scan_images
    from gleaner.sources.inventory import fingerprint_files

    flat, board = [[128] * 64] * 64, [[255 * ((x + y) % 2) for x in range(64)] for y in range(64)]
    ramp = [[4 * x for x in range(64)]] * 64
    for name, cells in (("flat", flat), ("board", board), ("ramp", ramp)):
        (tmp_path / f"{name}.png").write_bytes(png(cells))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.origin.rsplit("/", 1)[1].split(".")[0]: r for r in scan_images(spark, str(tmp_path)).collect()}
    assert got["broken"].status == "error" and got["flat"].laplacian_variance == 0 and got["flat"].entropy == 0
    assert got["board"].laplacian_variance > got["ramp"].laplacian_variance and (got["board"].height, got["board"].width) == (64, 64)
    assert got["ramp"].dhash == -1 and abs(got["ramp"].mean - np.mean(ramp) / 255) < 0.01
    assert fingerprint_files(spark, str(tmp_path), settings="v1").count() == 4


def test_broken_manifests_are_skipped(spark, tmp_path):
    from gleaner.sources.inventory import read_manifests, write_manifests

    write_manifests(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "album string, id long"), str(tmp_path / "m"), album="album")
    (tmp_path / "m" / "extra.json").write_text("{broken")
    assert sorted(tuple(r) for r in read_manifests(spark, str(tmp_path / "m"), "id long").collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_failing_models_give_error_rows(spark):
    from gleaner.sources.images import score_model

    out = score_model(spark.range(5), lambda: lambda b: b["missing"], key="id", engine="e", version="1").collect()
    assert {r.status for r in out} == {"error"} and len(out) == 5


def test_ensemble_weights_have_the_least_loss(spark):
    from gleaner.plans.review_queries import ensemble_pairs

    pairs, engines = ensemble_pairs(spark, SF)
    got = L.fit_ensemble_weights(pairs, key="l_orderkey", context="context", engines=engines).first()
    raw = [r.asDict() for r in pairs.collect()]

    def percentile(pool, x):
        below, equal = sum(v < x for v in pool), sum(v == x for v in pool)
        return 50.0 if len(pool) < 2 else (below + (equal - 1) / 2) / (len(pool) - 1) * 100

    pools = {}
    for r in raw:
        for e in engines:
            pools.setdefault((r["context"], e), []).extend((r[f"{e}_preferred"], r[f"{e}_other"]))
    gaps = {s: np.array([[percentile(pools[r["context"], e], r[f"{e}_preferred"]) - percentile(pools[r["context"], e], r[f"{e}_other"]) for e in engines] for r in raw if r["split"] == s]) for s in ("calibration", "held_out")}
    loss = lambda w: np.logaddexp(0, -gaps["calibration"] @ np.asarray(w).T / 12).mean(axis=0)
    grid = np.array([(a / 100, b / 100, (100 - a - b) / 100) for a in range(101) for b in range(101 - a)])
    assert loss(got.weights) <= loss(grid).min() + 1e-9
    assert abs(sum(got.weights) - 1) < 1e-5 and min(got.weights) >= 0
    right = lambda w: (gaps["held_out"] @ np.asarray(w) > 0).mean()
    assert got.accuracy == pytest.approx(right(got.weights), abs=0.01) and got.first_engine_accuracy == pytest.approx(right([1, 0, 0]), abs=1e-6)
    assert (got.calibration_pairs, got.held_out_pairs) == tuple(len(gaps[s]) for s in ("calibration", "held_out")) and got.status == "validated"


def test_ensemble_weights_need_pairs_and_disjoint_contexts(spark):
    schema = "k long, c long, split string, a_preferred double, a_other double, b_preferred double, b_other double"
    fit = lambda rows: L.fit_ensemble_weights(spark.createDataFrame(rows, schema), key="k", context="c", engines=["a", "b"]).first()
    rows = [(k, k % 4, "held_out" if k % 4 == 3 else "calibration", 1.0 * (k % 5), 1.0, 2.0, 1.0 * (k % 3)) for k in range(120)]
    assert fit(rows).status in ("failed", "validated")
    shared = fit([*rows, (120, 3, "calibration", 1.0, 0.0, 1.0, 0.0)])
    assert shared.status == "unfit" and shared.weights is None
    assert fit([]).status == fit(rows[:40]).status == fit([(*r[:3], None, *r[4:]) for r in rows]).status == "unfit"


def test_batches_keep_groups_whole_and_stay_within_the_limit(spark):
    rng = random.Random(4)
    sizes = {(p, g): rng.choice([1, 2, 3, 5, 9, 30]) for p in (None, 1, 2) for g in range(25)}
    rows = [key for key, n in sizes.items() for _ in range(n)]
    out = G.group_batches(spark.createDataFrame(rows, "p long, g long"), group="g", limit=8, by=["p"])
    want = []
    for p in (None, 1, 2):
        fill = batch = 0
        for g in range(25):
            for piece, start in enumerate(range(0, sizes[p, g], 8)):
                n = min(8, sizes[p, g] - start)
                if fill + n > 8:
                    fill, batch = 0, batch + 1
                fill += n
                want.append((p, g, piece, n, batch))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert G.group_batches(spark.createDataFrame([], "p long, g long"), group="g", limit=8, by=["p"]).count() == 0


def test_changed_snapshots_are_refused_with_their_context(spark):
    schema = "round string, k string, feature string"
    old = spark.createDataFrame([("a", "x", "1"), ("a", "gone", "1"), ("b", "x", "1"), ("c", "x", None), ("d", "y", "9")], schema)
    new = spark.createDataFrame([("a", "x", "1"), ("a", "x", "1"), ("a", "z", "2"), ("b", "x", "other"), ("b", "w", "1"), ("c", "x", "1"), (None, "x", "1"), ("a", None, "1")], schema)
    corpus, audit = L.project_corpus(old, new, context="round", key="k", frozen=["feature"])
    assert sorted(map(tuple, corpus.collect()), key=repr) == sorted([("a", "x", "1"), ("a", "z", "2"), ("b", "x", "1"), ("c", "x", None), ("d", "y", "9")], key=repr)
    assert sorted((r["round"], r.n_rows, r.n_changed, r.status) for r in audit.collect()) == [("a", 2, 0, "completed"), ("b", 2, 1, "failed"), ("c", 1, 1, "failed")]
    again, second = L.project_corpus(corpus, new, context="round", key="k", frozen=["feature"])
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, corpus.collect()), key=repr)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, audit.collect()))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = {"few": [3.0, 1.0, 2.0], "one": [7.0], "two": [1.0, 5.0], "ties": [2.0] * 500 + [9.0] * 499, "wide": [*rng.normal(size=40000).tolist(), 1e12, -1e12], "none": [None]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("few", None), ("few", float("nan")), (None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]
    for accuracy in (10000, 100):  # at 100 the sketch is coarser than the rows
        got = {r.k: r.q for r in W.quantiles(frame, "v", by=["k"], shares=shares, accuracy=accuracy).collect()}
        assert set(got) == {"few", "one", "two", "ties", "wide"}
        for k, q in got.items():
            assert q == pytest.approx(np.quantile(values[k], shares).tolist(), abs=1e-9)
