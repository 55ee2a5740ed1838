"""Digest trees, sketches, remembered splits, typed fields."""

import random

from gleaner.functions import expressions as X
from gleaner.operators.learning import balanced_split
from gleaner.operators.sketches import distinct_items, exact_stats, quantile, rolled_up, sketched
from gleaner.sources import digests
from pyspark.sql import functions as F


def test_only_differing_buckets_are_read(spark, tmp_path):
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("b"))
    paths = {name: f"file://{tmp_path}/{name}" for name in ("old", "same", "few")}
    few = rows.withColumn("a", F.when(F.col("id") == 77, 100).otherwise(F.col("a"))).where("id <> 78")
    for name, df in (("old", rows), ("same", rows.repartition(7)), ("few", few)):
        digests.write_snapshot(df, paths[name], key="id", fields=["a", "b"], depth=2)
    schema = "id long, a long, b string"
    assert digests.differing_buckets(spark, paths["old"], paths["same"]) == []
    buckets = digests.differing_buckets(spark, paths["old"], paths["few"])
    assert len(buckets) in (1, 2)
    read = digests.snapshot_rows(spark, paths["old"], buckets, schema)
    folders = {f.split("bucket=")[1].split("/")[0] for f in read.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert folders == set(buckets) and read.count() < 40
    out = digests.snapshot_drift(spark, paths["old"], paths["few"], key="id", fields=["a", "b"], schema=schema)
    assert {r.id: r.reasons for r in out.collect()} == {77: ["changed:a"], 78: ["missing"]}
    tree = spark.read.parquet(f"{paths['old']}/tree")
    assert {r.level: r.n for r in tree.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {0: 2000, 1: 2000, 2: 2000}


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), k % 9, rng.gauss(0, 10) if k % 50 else None, k % 700) for k in range(20_000)]
    rows = spark.createDataFrame(data, "g string, day int, v double, u long").repartition(6)
    daily = sketched(rows, by=["g", "day"], value="v", item="u")
    weekly = rolled_up(daily.withColumn("week", F.col("day") % 2), by=["g", "week"])
    ranks = {}
    for name, df in (("once", rolled_up(daily, by=["g"])), ("twice", rolled_up(weekly, by=["g"])), ("direct", sketched(rows, by=["g"], value="v", item="u"))):
        for r in df.select("g", "n", "least", "most", *(quantile(s).alias(f"q{k}") for k, s in enumerate((0.05, 0.5, 0.95))), distinct_items().alias("items")).collect():
            own = sorted(v for g, _, v, _ in data if g == r.g and v is not None)
            users = len({u for g, _, _, u in data if g == r.g})
            for k, s in enumerate((0.05, 0.5, 0.95)):
                assert abs(sum(v <= r[f"q{k}"] for v in own) / len(own) - s) < 0.015
            assert abs(r["items"] - users) <= 0.03 * users
            ranks.setdefault(r.g, set()).add((r.n, r.least, r.most))
    assert all(len(x) == 1 for x in ranks.values())
    for r in exact_stats(rows, by=["g"], value="v").collect():
        own = sorted(v for g, _, v, _ in data if g == r.g and v is not None)
        middle = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
        assert abs(r.med - middle) < 1e-9


def test_a_second_batch_changes_no_earlier_context(spark):
    first = spark.createDataFrame([(f"c{k % 11}",) for k in range(40)] + [(None,)], "ctx string")
    none = spark.createDataFrame([], "ctx string, examples long, split string")
    one = balanced_split(first, none, context="ctx")
    before = {r.ctx: (r.examples, r.split) for r in one.collect()}
    sides = [s for c, (_, s) in before.items() if c is not None]
    assert before[None] == (1, "calibration") and abs(sides.count("held_out") - sides.count("calibration")) <= 1
    more = spark.createDataFrame([(f"c{k}",) for k in range(5, 25)], "ctx string")
    after = {r.ctx: (r.examples, r.split) for r in balanced_split(more, one, context="ctx").collect()}
    assert {c: s for c, (_, s) in after.items() if c in before} == {c: s for c, (_, s) in before.items()}
    sides = [s for c, (_, s) in after.items() if c is not None]
    assert len(after) == 26 and abs(sides.count("held_out") - sides.count("calibration")) <= 1
    mixed = spark.createDataFrame([("x", 2, "held_out"), ("x", 1, "calibration"), ("y", 1, "held_out")], "ctx string, examples long, split string")
    assert {r.ctx: r.split for r in balanced_split(first.where("false"), mixed, context="ctx").collect()} == {"x": "calibration", "y": "held_out"}


def test_broken_json_has_empty_values(spark):
    texts = ['{"k": 3, "tags": ["a", "b"], "m": {"x": 1}}', '{"k": "no", "tags": 5}', '{"k"', "[1]", "7", None, "", "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    own = X.decode_fields(F.col("t"), {"k": "bigint", "tags": "array<string>", "m": "map<string,bigint>"}, whole="map<string,string>")
    got = {r.i: (r.f.k, r.f.tags, r.f.m, len(r.f.whole)) for r in rows.select("i", own.alias("f")).collect()}
    assert got[0] == (3, ["a", "b"], {"x": 1}, 3) and got[1] == (None, [], {}, 2)
    assert all(got[k] == (None, [], {}, 0) for k in range(2, 8))
