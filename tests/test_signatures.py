"""Pairs of near signatures in blocks, against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import pairs as J
from gleaner.operators import signatures as S


def like(rng, n):
    """Signatures of which many are near, some equal and some negative."""
    heads = [rng.getrandbits(64) - (1 << 63) for _ in range(5)]
    out = []
    for k in range(n):
        s = rng.choice(heads)
        for bit in rng.sample(range(64), rng.choice((0, 0, 2, 4, 6, 12))):
            s ^= 1 << bit if bit < 63 else -(1 << 63)
        out.append((f"k{k}", s))
    return out


@pytest.mark.parametrize("block, given", [(1 << 15, 1 << 17), (40, 16)])
def test_representatives_meet_all_near_rows_once(spark, monkeypatch, block, given):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "GIVEN", given)
    monkeypatch.setattr(S, "AT_ONCE", 100)
    rows = like(random.Random(11), 300)
    out = J.representative_pairs(spark.createDataFrame(rows, "id string, s long").withColumn("n", F.lit(1)), key="id", signature="s", order=["n"])
    first = {}
    for k, s in sorted(rows):
        first.setdefault(s, k)
    near = lambda x, y: x[1] != y[1] and ((x[1] ^ y[1]) & ((1 << 64) - 1)).bit_count() <= 10 and (first[x[1]] == x[0] or first[y[1]] == y[0])
    rows.sort()
    want = [(x[0], y[0]) for k, x in enumerate(rows) for y in rows[k + 1 :] if near(x, y)]
    assert sorted((r.src, r.dst) for r in out.collect()) == sorted(want)
    assert len(first) < len(rows) and want


def test_no_block_is_broadcast_and_none_is_no_error(spark):
    frame = spark.createDataFrame(like(random.Random(12), 100), "id string, s long")
    out = J.signature_pairs(frame, signature="s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert out.count()
    assert J.signature_pairs(frame.where("false"), signature="s").collect() == []
