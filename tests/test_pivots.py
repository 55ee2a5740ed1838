"""Pairs by angle: equal to all pairs, with block pairs left out where vectors lie in clusters."""

import numpy as np
import pytest

from gleaner.operators.pivots import angle_pairs, blocks_of, near_blocks
from pyspark.sql import functions as F


def vectors(spark, data):
    return spark.createDataFrame([(int(k), g, None if v is None else [float(x) for x in v]) for k, g, v in data], "id long, g string, v array<double>").repartition(4)


def brute(data, threshold):
    good = [(k, g, np.array(v) / np.linalg.norm(v)) for k, g, v in data if v is not None and len(v) and 1e-8 < np.linalg.norm(v) < np.inf]
    return {(g, min(k, m), max(k, m)) for i, (k, g, v) in enumerate(good) for m, h, w in good[i + 1 :] if g == h and k != m and len(v) == len(w) and v @ w >= threshold}


@pytest.mark.parametrize("threshold, spread", [(0.94, 0.1), (0.3, 1.0)])
def test_equal_to_all_pairs(spark, threshold, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    data = [(k, "ab"[k % 7 == 0], centres[k % 12] + spread * rng.normal(size=8)) for k in range(700)]
    data += [(1000 + k, "a", centres[0]) for k in range(90)]  # copies that no pivot parts
    data += [(2000, "a", None), (2001, "a", [0.0] * 8), (2002, "a", [float("nan")] * 8), (2003, "a", [1.0, 2.0]), (2004, "a", [2.0, 4.0]), (2005, "a", [])]
    found = angle_pairs(vectors(spark, data), key="id", vector="v", threshold=threshold, by=["g"], block=32, fanout=4).collect()
    got = [(r.g, r.src, r.dst) for r in found]
    assert len(got) == len(set(got)) and set(got) == brute(data, threshold)


def test_far_blocks_do_not_meet(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16))
    m = np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "k long, v array<double>").select(F.struct(F.lit("a").alias("g")).alias("_by"), "k", "v")
    cut = blocks_of(rows, block=64, fanout=16)
    assert cut.groupBy("path").count().agg({"count": "max"}).first()[0] <= 64
    own = {}
    for r in cut.collect():
        own.setdefault(tuple(r.path), []).append(r.v)
    leaves = []
    for path, vs in own.items():
        total = np.sum(vs, axis=0)
        centre = total / np.linalg.norm(total)
        leaves.append((("a",), list(path), len(vs), total.tolist(), centre.tolist(), float(np.arccos(np.clip(vs @ centre, -1, 1)).max())))
    table = spark.createDataFrame(leaves, "_by struct<g:string>, path array<int>, n long, total array<double>, centre array<double>, radius double")
    tried = near_blocks(table, threshold=0.94).count()
    assert len(leaves) > 30 and tried < 0.1 * len(leaves) * (len(leaves) + 1) / 2
