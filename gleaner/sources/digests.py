"""Snapshots with a tree of digests: two of them are compared from the root down, and only buckets that differ are read.

Rows lie in 16 ** depth buckets by a hash of their key, each written to a folder of its own. A bucket's digest is a sum
of row hashes, so tasks add up their own rows before anything is shuffled; every node above digests its sixteen children.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.pairs import drift

NODES = "level int, node string, n long, digest string"


def bucketed(df: DataFrame, *, key: str, depth: int) -> DataFrame:
    """Rows with their ``bucket``: the first ``depth`` hexadecimal digits of the key's digest."""
    return df.withColumn("bucket", F.substring(F.md5(F.col(key).cast("string")), 1, depth))


def digest_tree(df: DataFrame, *, key: str, fields: list[str], depth: int) -> DataFrame:
    """(level, node, n, digest) of all levels, the root at 0 with an empty name. The digest of a bucket depends on its
    rows, repeated ones included, and not on their order; nulls differ from empty values."""
    own = [F.col(c) for c in (key, *fields)]
    known = [c.isNull() for c in own]
    sums = [F.sum(F.xxhash64(F.lit(seed), *own, *known).cast("decimal(38,0)")) for seed in (1, 2)]
    level = bucketed(df.select(key, *fields), key=key, depth=depth).groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", *(s.cast("string") for s in sums)), 256).alias("digest"))
    levels = [level.select(F.lit(depth).alias("level"), F.col("bucket").alias("node"), "n", "digest")]
    for k in range(depth - 1, -1, -1):
        # Sixteen children at most.
        children = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "node", "digest"))), ",")
        up = levels[-1].groupBy(F.substring("node", 1, k).alias("parent")).agg(F.sum("n").alias("n"), F.sha2(children, 256).alias("digest"))
        levels.append(up.select(F.lit(k).alias("level"), F.col("parent").alias("node"), "n", "digest"))
    return reduce(DataFrame.unionByName, levels)


def depth_for(rows: int) -> int:
    """Levels for buckets of some 65,536 rows, at most 65,536 buckets."""
    return next((k for k in range(1, 4) if rows <= 16**k << 16), 4)


def write_snapshot(df: DataFrame, path: str, *, key: str, fields: list[str], depth: int) -> None:
    """Rows by bucket below ``path``/rows, and their tree in ``path``/tree. Snapshots that are to be compared need one depth."""
    bucketed(df.select(key, *fields), key=key, depth=depth).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(df.select(key, *fields).schema).parquet(f"{path}/rows/bucket=*")
    digest_tree(stored, key=key, fields=fields, depth=depth).coalesce(1).write.parquet(f"{path}/tree")


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[str]:
    """The names of the buckets whose digests differ, by descent: a level is compared below nodes that differ alone."""
    a, b = (spark.read.schema(NODES).parquet(f"{path}/tree") for path in (old, new))
    depth = a.agg(F.max("level").alias("d")).first()["d"]
    if depth != b.agg(F.max("level").alias("d")).first()["d"]:
        raise ValueError("the snapshots have trees of different depths")
    open_ = [""]
    for level in range((depth or 0) + 1):
        x, y = (t.where((F.col("level") == level) & F.substring("node", 1, max(0, level - 1)).isin(open_)) for t in (a, b))
        met = x.select("node", F.col("digest").alias("x")).join(y.select("node", F.col("digest").alias("y")), "node", "full")
        open_ = [r["node"] for r in met.where(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect()]
        if not open_:
            break
    return sorted(open_)


def snapshot_rows(spark: SparkSession, path: str, buckets: list[str], schema: str) -> DataFrame:
    """The rows of some buckets of a snapshot; no other folder is read."""
    rows = spark.read.schema(f"{schema}, bucket string").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.where(F.col("bucket").isin(buckets)).drop("bucket")


def snapshot_drift(spark: SparkSession, old: str, new: str, *, key: str, fields: list[str], schema: str) -> DataFrame:
    """(key, reasons) as :func:`gleaner.operators.pairs.drift` of the two snapshots, reading only buckets that differ."""
    buckets = differing_buckets(spark, old, new)
    return drift(snapshot_rows(spark, old, buckets, schema), snapshot_rows(spark, new, buckets, schema), key=key, fields=fields)
