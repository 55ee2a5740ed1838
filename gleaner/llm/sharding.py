"""Operator 1: two-pass external shuffle of a document table into shards.

Pass one scatters every record, by seeded hashes alone, to a bucket that fits in memory; pass two draws a
Fisher-Yates permutation of each bucket and writes the bucket in that order. Buckets belong to shards, and a record's
place in its shard is the number of records in the earlier buckets plus its place in its own bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import scratch_dir, table, total_bytes

#: Bytes added to each record's size for its framing.
RECORD_BYTES = 16


def rendezvous_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is highest; another shard only takes rows into itself."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.xxhash64(F.lit(seed), i, key))
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1 by Fisher-Yates exchanges."""
    order = np.arange(n).tolist()
    draws = rng.random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def shuffle_shards(
    docs: DataFrame, path: str, *, shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text",
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """Write ``docs`` to ``path`` as shuffled shards and return the written table.

    Columns: shard, grown_shard (with one more shard), bucket, position (in the bucket), doc_id, size, text_crc32 and
    ``record``, the whole input row as a struct, so that extra columns never clash. The shard depends on the id and the
    shard count only. Null texts count no bytes and have checksum 0; null ids share one shard; repeated rows are kept;
    an empty table gives an empty table. Buckets are dealt by id and text, so only equal rows must share one.
    """
    per_shard = max(1, -(-total_bytes(docs, text_col) // (shards * bucket_bytes)))
    key, text = F.col(id_col), F.col(text_col)
    scattered = docs.select(
        rendezvous_shard(key, shards, seed).alias("shard"),
        rendezvous_shard(key, shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), key, text), F.lit(per_shard)).cast("int").alias("bucket"),
        key.cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.struct("*").alias("record"),
    )
    schema = T.StructType([*scattered.schema.fields[:3], T.StructField("position", T.LongType()), *scattered.schema.fields[3:]])

    def deal(bucket: pa.Table) -> pa.Table:
        where = [bucket.column(0)[0].as_py(), bucket.column(2)[0].as_py()]
        ranked = bucket.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("text_crc32", "ascending")])
        order = fisher_yates(ranked.num_rows, np.random.default_rng([seed, *where]))
        out = ranked.take(pa.array(order))
        return out.add_column(3, "position", pa.array(np.arange(out.num_rows)))

    dealt = scattered.groupBy("shard", "bucket").applyInArrow(deal, schema)
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def op1_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the ``key`` law, with their shuffled places."""
    written = shuffle_shards(table(spark, sf_dir, "documents"), scratch_dir(spark, "shards"))
    rows = written.drop("record")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select(
        "shard", "bucket",
        F.expr("sum(n) over (partition by shard order by bucket rows unbounded preceding) - n").alias("first"),
    )
    return rows.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("position")).alias("slot"), "grown_shard",
    )
