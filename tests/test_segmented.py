"""Segmented scans: equal to windows, and no range holds a partition that has nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import ordered as W
from gleaner.operators import pairs as J
from gleaner.operators.segmented import finished, ranged, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(k, "hot" if rng.random() < 0.95 else rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(40)]), rng.randrange(3000), f"s{k % 7}") for k in range(5000)]
    return spark.createDataFrame(data, "id long, g string, v int, t long, s string").repartition(5).cache()


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_scan_equals_windows_and_deals_out_a_hot_partition(spark, rows):
    order = ["t", "id"]
    cut = ranged(rows, by=["g"], order=order, ranges=16)
    sizes = sorted(r["count"] for r in cut.where("g = 'hot'").groupBy("_range").count().collect())
    assert len(sizes) >= 14 and sizes[-1] <= 3 * 5000 / 16
    found = finished(scan(cut, order=order, sums={"total": F.col("v"), "n": F.lit(1)}, lags={"before": "v", "name": "s"}, number="place"))
    w = "over (partition by g order by t, id"
    want = rows.selectExpr("*", f"coalesce(sum(v) {w} rows unbounded preceding), 0)", f"count(*) {w} rows unbounded preceding)", f"lag(v) {w})", f"lag(s) {w})", f"row_number() {w})")
    same(found, want)


def test_scan_of_an_empty_table(rows):
    assert scan(ranged(rows.where("false"), by=["g"], order=["t"]), order=["t"], number="n").collect() == []


def test_ranks_with_ties_and_nulls(rows):
    a = W.percentile_rank(rows, "v", by=["g"], out="p")
    same(a, W.percentile_rank(rows, "v", by=["g"], out="p", bounded=True))
    below, equal, n = "rank() over (partition by g order by v) - 1", "count(*) over (partition by g, v)", "count(*) over (partition by g)"
    same(W.midrank_percentile(rows, "v", by=["g"], out="m"), rows.selectExpr("*", f"case when {n} <= 1 then 50D else (({below}) + ({equal} - 1) / 2) / ({n} - 1) * 100 end"))


def test_next_pairs_end_where_the_zone_changes(spark, rows):
    found = J.k_next_pairs(rows, key="id", micros=F.col("t") * 1_000_000, within=20, by=["g"], k=3, zoned=F.col("id") % 3 > 0)
    by = {}
    for r in rows.collect():
        by.setdefault(r.g, []).append((r.t, r.id))
    want = set()
    for g, own in by.items():
        own.sort()
        for i, (t, k) in enumerate(own):
            for u, m in own[i + 1 : i + 4]:
                if u - t > 20 or (k % 3 > 0) != (m % 3 > 0):
                    break
                want.add((g, min(k, m), max(k, m), float(u - t)))
    got = [(r.g, r.src, r.dst, r.seconds) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_episodes_of_a_hot_partition(spark, rows):
    found = W.adaptive_episodes(rows.select("id", "g", "t"), micros=F.col("t") * 1_000_000, by=["g"], order=["t", "id"], low=1, high=3, least=0, spread=0)
    by = {}
    for r in found.collect():
        by.setdefault(r.g, []).append((0, r.id, r.gap, r.limit, r.episode))
    times = {r.id: r.t for r in rows.collect()}
    for own in by.values():
        own.sort(key=lambda r: (times[r[1]], r[1]))
        episode = 0
        for k, r in enumerate(own):
            gap = times[r[1]] - times[own[k - 1][1]] if k else 0
            assert r[2] == gap
            episode += r[3] is not None and gap > r[3]
            assert r[4] == episode
