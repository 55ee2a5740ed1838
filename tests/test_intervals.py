"""Interval pairs against all pairs in plain Python, in batches and buckets of any size."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import pairs as J


@pytest.mark.parametrize("records, partitions", [(3, 1), (7, 4), (10_000, 4)])
def test_all_pairs_in_the_interval_once(spark, monkeypatch, records, partitions):
    rng = random.Random(6)
    rows = [(rng.choice(("a", "b", None)) if k % 3 else "a", k // 2 * 2 if k % 31 == 1 else k, None if k % 40 == 39 else rng.choice((rng.randrange(-9000, 9000), 120 * rng.randrange(-40, 40)))) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, id long, s long")
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(records)), ("spark.sql.shuffle.partitions", str(partitions))):
        spark.conf.set(name, value)
    try:
        out = J.interval_pairs(frame, key="id", micros=F.col("s") * 1_000_000, within=120, by=["g"])
        got = sorted(tuple(r) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    known = [r for r in rows if r[0] and r[2] is not None]
    want = [(g, min(a, b), max(a, b), float(t - s)) for g, a, s in known for h, b, t in known if g == h and 0 <= t - s <= 120 and (t > s or a < b)]
    assert got == sorted(want)


def test_rows_are_shuffled_about_once(spark):
    frame = spark.range(1000).selectExpr("id", "id * 40000000 as t", "'a' as g")
    plan = J.interval_pairs(frame, key="id", micros=F.col("t"), within=120, by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
