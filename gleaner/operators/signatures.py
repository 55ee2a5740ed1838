"""Pairs of near signatures, all against all: blocks of bits meet as arrays, so a pair costs a word's xor and count.

Chance meetings of texts' signatures grow with the square of the rows whatever the index, so nothing is indexed. What is
shuffled is the blocks, not the pairs, and a worker holds a few blocks and one batch of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.tables import materialize

#: Rows of a block at most, blocks in which few rows are cut at least, and the fewest rows worth a block.
BLOCK, LEAST_BLOCKS, SMALL = 1 << 15, 12, 512
#: Comparisons made at once, pairs of blocks to a task, and pairs given on at once.
AT_ONCE, PER_TASK, GIVEN = 1 << 16, 8, 1 << 17


def near_pairs(rows: DataFrame, *, most: int) -> DataFrame:
    """(k, k2, distance): pairs of ``rows`` (k, s, lead) with different signatures at most ``most`` bits apart, of which at
    least one leads; each once, in no order. Rows must differ in ``k`` and have a signature."""
    rows = materialize(rows.select("k", "s", "lead"))
    spark, kind = rows.sparkSession, dict(rows.dtypes)["k"]
    n = {r["lead"]: r["n"] for r in rows.groupBy("lead").agg(F.count("*").alias("n")).collect()}
    cut = lambda m: max(math.ceil(m / BLOCK), min(LEAST_BLOCKS, math.ceil(m / SMALL)))
    leads, others = cut(n.get(True, 0)), cut(n.get(False, 0))
    own = F.xxhash64("k")
    # Leading blocks come first.
    place = F.when(F.col("lead"), F.pmod(own, F.lit(max(leads, 1)))).otherwise(leads + F.pmod(own, F.lit(max(others, 1)))).cast("int")

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"block": group.column("block").slice(0, 1), "ks": pa.array([group.column("k").combine_chunks()], pa.list_(group.schema.field("k").type)), "m": pa.array([group.column("s").to_numpy().tobytes()], pa.binary())})

    packed = materialize(rows.select(place.alias("block"), "k", "s").groupBy("block").applyInArrow(pack, f"block int, ks array<{kind}>, m binary"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leads * (leads + others) / PER_TASK))
    # A block is copied once for each that it meets, which Spark's estimate leaves out: without the hint it would broadcast them.
    a = packed.where(F.col("block") < leads).select(F.col("block").alias("a"), F.col("ks").alias("ka"), F.col("m").alias("ma"), F.explode(F.sequence(F.col("block"), F.lit(max(leads + others - 1, 0)))).alias("b"))
    b = packed.select(F.col("block").alias("b"), F.col("ks").alias("kb"), F.col("m").alias("mb"), F.explode(F.sequence(F.lit(0), F.least("block", F.lit(max(leads - 1, 0))))).alias("a"))
    met = a.repartition(tasks, "a", "b").join(b.repartition(tasks, "a", "b").hint("merge"), ["a", "b"]).select("a", "b", "ka", "kb", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                x, y = (np.frombuffer(row[c].as_buffer(), dtype=np.uint64) for c in ("ma", "mb"))
                found, held = [], 0
                step = max(1, AT_ONCE // len(y))
                for at in range(0, len(x), step):
                    gap = np.bitwise_count(x[at : at + step, None] ^ y[None, :])
                    near = np.flatnonzero(gap <= most)
                    i, j, gap = near // len(y) + at, near % len(y), gap.ravel()[near]
                    # Of a block with itself, each pair once.
                    good = gap > 0 if row["a"] != row["b"] else (gap > 0) & (i < j)
                    found.append((i[good], j[good], gap[good]))
                    held += len(found[-1][0])
                    if held >= GIVEN or at + step >= len(x):
                        i, j, gap = (np.concatenate(c) for c in zip(*found))
                        yield pa.RecordBatch.from_arrays([row["ka"].values.take(pa.array(i)), row["kb"].values.take(pa.array(j)), pa.array(gap.astype(np.int32))], ["k", "k2", "distance"])
                        found, held = [], 0

    return met.mapInArrow(run, f"k {kind}, k2 {kind}, distance int")
