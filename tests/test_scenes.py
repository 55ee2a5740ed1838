"""Stacks and subsets of scenes against their sequential rules, in blocks and parts far smaller than a scene."""

import math
import random

import numpy as np
import pytest

from gleaner.operators import groups as G
from gleaner.operators import scenes as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = [(k, rng.choice(["big"] * 9 + [None, "c"]), [rng.gauss(0, 1) for _ in range(4)], rng.choice([0.1, 0.5, 0.5, 0.9, None]), rng.random() < 0.02, rng.choice(["x", "y", *map(str, range(40)), None])) for k in range(240)]
    return rows


def unit(v):
    return np.array(v) / max(np.linalg.norm(v), 1e-8)


@pytest.mark.parametrize("block, part", [(1024, 8192), (7, 10)])
def test_stacks(spark, data, monkeypatch, block, part):
    monkeypatch.setattr(S, "PART", part)
    frame = spark.createDataFrame([r[:3] for r in data], "id long, g string, v array<double>").repartition(4)
    got = {(r.g, r.id): r.stack for r in S.complete_link_stacks(frame, by=["g"], key="id", vector="v", threshold=0.3, block=block).collect()}
    want = {}
    for g in {r[1] for r in data}:
        stacks = []
        for k, _, v, *_ in (r for r in data if r[1] == g):
            at = next((i for i, own in enumerate(stacks) if all(unit(v) @ m >= 0.3 for m in own)), len(stacks))
            stacks += [[]] if at == len(stacks) else []
            stacks[at].append(unit(v))
            want[(g, k)] = at
    assert got == want


@pytest.mark.parametrize("part, leading, density", [(8192, 256, 1.0), (20, 2, 2.5)])
@pytest.mark.parametrize("guarded", [False, True])
def test_subsets(spark, data, part, leading, density, guarded):
    frame = spark.createDataFrame(data, "id long, g string, v array<double>, q double, p boolean, h string").repartition(4)
    more = {"protected": "p", "render": "h"} if guarded else {}
    out = S.ranked_subset(frame, by=["g"], key="id", vector="v", rank="q", density=density, part=part, leading=leading, **more)
    got = {(r.g, r.id): r.place for r in out.collect()}
    want = {}
    for g in {r[1] for r in data}:
        own = [(k, unit(v), q or 0.0, p and guarded, h if guarded else None) for k, x, v, q, p, h in data if x == g]
        kept = sorted((r for r in own if r[3]), key=lambda r: (-r[2], r[0])) or [max(own, key=lambda r: (r[2], r[0]))]
        while len(kept) < min(len(own), max(1, math.ceil(math.sqrt(len(own)) * density))):
            left = [r for r in own if r[0] not in {c[0] for c in kept} and (r[4] is None or r[4] not in {c[4] for c in kept})]
            if not left:
                break
            kept.append(max(left, key=lambda r: (round(0.7 * r[2] + 0.3 * max(0, 1 - max(min(1, c[1] @ r[1]) for c in kept)), 12), r[2], r[0])))
        want |= {(g, r[0]): i + 1 for i, r in enumerate(kept)}
    assert got == want


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("n")), spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    nodes, edges = chain(spark, 3000)
    written = []
    real = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: written.append(1) or real(df))
    got = {r.n: r.leads for r in G.first_independent(nodes.withColumn("r", F.col("n")), edges).collect()}
    assert got == {n: n % 2 == 0 for n in range(3000)} and len(written) < 40


def test_exact_copies_are_peeled_off_first(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b"), (5, "c")], "n long, h string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    got = {r.n: r.leader for r in G.leader_split(nodes, edges, key="n", rank="n", exact="h").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


@pytest.mark.parametrize("cap", [1, 2, 3])
def test_demotions_on_random_graphs(spark, cap):
    rng = random.Random(cap)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(500)}
    kept = []
    for n in range(80):
        if sum((m, n) in edges for m in kept) < cap:
            kept.append(n)
    items = spark.range(80).select(F.col("id").alias("n"))
    out = G.diversity_demotions(items, spark.createDataFrame(sorted(edges), "src long, dst long"), key="n", rank="n", cap=cap)
    rows = out.collect()
    assert len(rows) == 80 and sorted(r.n for r in rows if r.kept) == kept
