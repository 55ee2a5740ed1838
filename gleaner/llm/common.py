"""Shared helpers: the shared scratch folder, materialised tables and word patterns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import spread

#: ASCII white space; words are maximal runs of anything else.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; texts are dealt over all cores where their files have fewer splits than these."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a temporary folder of the driver is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gleaner-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once while a step is written: whole texts are large, and both sides hold them.
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
#: Shuffle files of a step go as soon as it is written, not when the driver happens to collect their handles.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers live on from step to step."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path, rows, cleanup = scratch_dir(spark, name), spark.conf.get(ARROW_ROWS), spark.conf.get(CLEANUP, "false")
    spark.conf.set(ARROW_ROWS, str(min(int(rows), BATCH_ROWS)))
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
        spark.conf.set(CLEANUP, cleanup)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which Spark keeps until the driver collects their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bits of the filter that :func:`holding` hands to every task: 8 MB, whatever the number of ids.
FILTER_BITS = 1 << 26


Batches = Iterator[pa.RecordBatch]


def holding(rows: DataFrame, ids: DataFrame, key: str, then: Callable[[Batches], Batches] | None = None, schema: str | None = None) -> DataFrame:
    """The ``rows`` whose long column ``key`` may be in ``ids``: all that are, and few others unless very many ids fill
    the bitmap of fixed size that decides. ``then`` turns them into rows of ``schema`` in the same worker."""
    spark = rows.sparkSession
    slots = ids.select(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = slots.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = spark.sparkContext.broadcast(bitmap)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            good = (bits[slot >> 6] >> (slot & 63)) & 1
            yield batch.filter(pa.array(good.astype(bool))).select(list(range(batch.num_columns - 1)))

    run = (lambda batches: then(keep(batches))) if then else keep
    return rows.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))).mapInArrow(run, schema or rows.schema)


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` (all columns kept) joined with ``ids`` on the long column ``key``.

    A bitmap drops rows whose key is in no row of ``ids`` before the join shuffles them; when very many ids fill it, it
    lets more rows pass and the join alone decides.
    """
    return holding(rows, ids, key).join(ids, key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
