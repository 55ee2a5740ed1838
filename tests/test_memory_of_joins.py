"""Sides of a join that grow by copies of their rows, which Spark's estimate leaves out, never go to the driver."""

import hashlib
import random

from pyspark.sql import functions as F

from gleaner.operators import groups as G
from gleaner.operators import pairs as J
from gleaner.plans import pair_queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_near_in_time_and_signature_are_merged(spark):
    frame = spark.createDataFrame([(k, k % 7, 1) for k in range(400)], "id long, s long, n long")
    out = J.representative_pairs_within(frame, key="id", signature="s", order=["n"], micros=F.col("id") * 1_000_000, within=120)
    assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)
    # The first rows of the signatures are 0 to 6: each meets the rows of other signatures in the next 120 seconds.
    assert {(r.src, r.dst) for r in out.collect()} == {(a, b) for a in range(7) for b in range(a + 1, 400) if b - a <= 120 and b % 7 != a}


def test_disjoint_pairs_compare_no_two_pairs_of_an_item(spark, monkeypatch):
    rng, rows, write = random.Random(5), [], G.materialize
    pairs = {(0, k) for k in range(1, 1500)} | {tuple(sorted(rng.sample(range(2000, 2060), 2))) for _ in range(400)}

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(G, "materialize", counted)
    out = G.disjoint_pairs(spark.createDataFrame([(a, b, 0 if a < 2000 else 2000) for a, b in pairs], "src long, dst long, component long"), most=50)
    digest = lambda p: hashlib.sha256(f"{p[0]}|{p[1]}".encode()).hexdigest()
    used, want, turn = set(), [], {}
    for p in sorted(pairs, key=digest):
        if not used & {*p}:
            used |= {*p}
            own = 0 if p[0] < 2000 else 2000
            turn[own] = turn.get(own, 0) + 1
            want.append((own, turn[own], *(p if digest(p) < "8" else p[::-1])))
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert max(rows) <= len(pairs)


def test_edges_of_components_broadcast_no_copies_of_rows(spark):
    """g1, g2, j15 and w18 begin with these edges."""
    lines = plan(Q.confirmed(Q.described(spark, "/root/testdata/sf0.001"))).split("Initial Plan")[-1].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = lines[k + 1 : next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))]
            assert not any("Generate" in y for y in below), "\n".join([x, *below])
