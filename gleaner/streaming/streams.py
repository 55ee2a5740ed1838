"""Structured Streaming forms of incremental operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The state store that list states and timers need; set as spark.sql.streaming.stateStore.providerClass before a query starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with timers inside; the session's own state store is set again afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def latest_decisions(stream: DataFrame, *, key: str, generation: str, value: str) -> DataFrame:
    """Decisions guarded by a generation: one is applied only over a lower generation; one without always is.

    Late means a lower generation, not an earlier time; state is kept per key without a time limit.
    """
    kind, of = dict(stream.dtypes), {"bigint": int, "int": int, "string": str}

    def apply(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, decision = state.get if state.exists else (-1, None)
        changed = False
        for batch in batches:
            for g, v in zip(batch[generation], batch[value]):
                if pd.isna(g) or g > own:
                    own, decision, changed = own if pd.isna(g) else int(g), str(v), True
        state.update((own, decision))
        if changed:
            yield pd.DataFrame({key: [of[kind[key]](k[0])], "generation": [own], "decision": [decision]})

    rows = stream.select(key, generation, value)
    return rows.groupBy(key).applyInPandasWithState(apply, f"{key} {kind[key]}, generation long, decision string", "generation long, decision string", "update", GroupStateTimeout.NoTimeout)


def exact_dedup(stream: DataFrame, *, time: str, content: str, delay: str) -> DataFrame:
    """First row of equal content within the watermark."""
    return stream.withColumn("content_hash", F.sha2(F.col(content).cast("string"), 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def interval_pairs(stream: DataFrame, *, time: str, key: str, by: str, seconds: int, delay: str) -> DataFrame:
    """Stream-stream join of rows of one partition at most so many seconds apart; state goes after that and the delay.

    Rows meet in time buckets as long as the interval, the later one in its own and the one before: a row is compared with
    what the state holds of two intervals, not of the whole partition.
    """
    bucket = F.floor(F.unix_micros(time) / (seconds * 1_000_000))
    a = stream.select(F.col(by).alias("by"), F.col(key).alias("src"), F.col(time).alias("ta"), bucket.alias("bucket")).withWatermark("ta", delay)
    b = stream.select(F.col(by).alias("by2"), F.col(key).alias("dst"), F.col(time).alias("tb"), F.explode(F.array(bucket, bucket - 1)).alias("bucket2")).withWatermark("tb", delay)
    near = F.expr(f"by = by2 and bucket = bucket2 and tb >= ta and tb <= ta + interval {seconds} seconds and (tb > ta or src < dst) and src <> dst")
    return a.join(b, near).select(F.col("by").alias(by), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def episodes(stream: DataFrame, *, time: str, by: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a fixed gap; the adaptive gap needs the whole partition and is the batch operator's."""
    return stream.withWatermark(time, delay).groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Episodes(StatefulProcessor):
    """State of a key: the times that may still be preceded by others, and the open episode with the key's gap.

    Times up to the watermark are final and are folded in order; an episode is told when the watermark has passed its last
    time by more than the gap, or when a later time has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long")
        self.open = handle.getValueState("open", "first long, last long, n long, gap long")

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        first, last, n, gap = self.open.get() if self.open.exists() else (None, None, 0, 0)
        final = watermark * 1000
        times = sorted(t for (t,) in self.waiting.get()) if self.waiting.exists() else []
        told = []
        for t in [t for t in times if t <= final]:
            if n and t - last > gap:
                told.append((first, last, n))
                n = 0
            first, last, n = (first if n else t), t, n + 1
        if n and last + gap < final:
            told.append((first, last, n))
            n = 0
        left = [(t,) for t in times if t > final]
        self.waiting.put(left) if left else self.waiting.clear()
        self.open.update((first if n else 0, last if n else 0, n, gap))
        for at in ([(last + gap) // 1000 + 1] if n else []) + ([left[-1][0] // 1000 + 1] if left else []):
            self.handle.registerTimer(at)
        if not n and not left:
            self.open.clear()
        if told:
            yield self._rows(key, told, 0)

    @staticmethod
    def _rows(key: tuple, told: list[tuple], late: int) -> pd.DataFrame:
        return pd.DataFrame({"by": [key[0]] * len(told), **{c: pd.array([x[k] for x in told], dtype="Int64") for k, c in enumerate(("first", "last", "n"))}, "late": [late] * len(told)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        times, gap = [], 0
        for part in rows:
            times += [(int(t),) for t in part["micros"]]
            gap = int(part["gap"].iloc[-1])
        # What is final can't change: the source drops late rows only from the next batch on.
        seen, final = len(times), timerValues.getCurrentWatermarkInMs() * 1000
        times = [x for x in times if x[0] > final]
        if len(times) < seen:
            yield self._rows(key, [(None, None, 0)], seen - len(times))
        first, last, n, _ = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        self.open.update((first, last, n, gap))
        if times:
            self.waiting.appendList(times)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def adaptive_episodes(stream: DataFrame, limits: DataFrame, *, time: str, by: str, delay: str, default: float = 1800) -> DataFrame:
    """(by, first, last, n, late): episodes of each key of a stream, by the key's own gap in ``limits`` (by, seconds).

    Rows may come in any order within ``delay``; later ones are dropped, and told as a row of their number ``late`` without times
    (from a batch later on the query's progress counts them: numRowsDroppedByWatermark). An episode is given once, when nothing can join it any more. Start within :func:`timed_state`.
    """
    kind = dict(stream.dtypes)[by]
    gaps = limits.select(F.col(by).alias("by"), (F.col("seconds") * 1_000_000).cast("long").alias("gap"))
    rows = stream.withWatermark(time, delay).select(F.col(by).alias("by"), time, F.unix_micros(time).alias("micros")).join(gaps, "by", "left")
    rows = rows.withColumn("gap", F.coalesce("gap", F.lit(int(default * 1_000_000))))
    out = rows.groupBy("by").transformWithStateInPandas(_Episodes(), f"by {kind}, first long, last long, n long, late long", "Append", "EventTime")
    return out.select(F.col("by").alias(by), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "late")


def window_summary(stream: DataFrame, *, time: str, by: str, value: str, width: str, delay: str) -> DataFrame:
    """Counts and sums of tumbling windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def pending(stream: DataFrame, signals: DataFrame, *, key: str, version: str) -> DataFrame:
    """Rows of the stream whose ready signal of this version is missing from a static table (key, status, version)."""
    ready = signals.where((F.col("status") == "ready") & (F.col("version") == version)).select(key, F.lit(True).alias("done")).distinct()
    return stream.join(ready, key, "left").where("done is null").drop("done")
