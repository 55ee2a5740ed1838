"""Scans over ordered partitions of any size.

A sketch of the keys cuts the rows into ranges, which ascend with partition and order. Each range is scanned by itself;
its number of rows, sums and last row are carried to the ranges after it in the same partition. So a partition that
holds all rows is dealt over all tasks, and only one small row for each range and partition meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.tables import materialize


def ranged(df: DataFrame, *, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows, written once, with their partition as one value ``_by`` (nulls are values) and their range ``_range``.

    Rows with equal keys lie in one range; nulls come first. There are as many ranges as shuffle partitions, or ``ranges``.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_by", F.struct(*by)).repartitionByRange(n, "_by", *order)
    return materialize(rows.withColumn("_range", F.spark_partition_id()))


def _carried(rows: DataFrame, sums: dict[str, Column], last: list[str], order: list[str]) -> DataFrame:
    """(_by, _range, _before: rows, one sum each, last row): what the ranges before each one hold."""
    own = [F.count("*").alias("_rows"), *(F.sum(c).alias(f"_own_{k}") for k, c in enumerate(sums.values()))]
    own += [F.max_by(F.struct(*last), F.struct(*order)).alias("_end")] if last else []
    before = Window.partitionBy("_by").orderBy("_range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_by", "_range").agg(*own)
    zero = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    out = [zero("_rows").alias("_rows_before"), *(zero(f"_own_{k}").alias(f"_before_{k}") for k in range(len(sums)))]
    return ends.select("_by", "_range", *out, *([F.lag("_end").over(before).alias("_end")] if last else []))


def scan(rows: DataFrame, *, order: list[str], sums: dict[str, Column] | None = None, lags: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """:func:`ranged` rows with running sums up to each row, columns of the row before it, and its place from 1.

    As the window functions over (partition by the partition, order by ``order``) would give; the first row of a partition has
    null lags, and null summands don't count. ``order`` must tell a partition's rows apart where the result is to be the same each time.
    """
    sums, lags = sums or {}, lags or {}
    last = list(dict.fromkeys(lags.values()))
    within = Window.partitionBy("_by", "_range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_sum_{k}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in enumerate(sums.values())}
    local |= {"_place": F.row_number().over(within)} | ({"_last": F.lag(F.struct(*last)).over(within)} if last else {})
    met = rows.withColumns(local).join(_carried(rows, sums, last, order), ["_by", "_range"])
    found = {out: F.col(f"_before_{k}") + F.col(f"_sum_{k}") for k, out in enumerate(sums)}
    found |= {out: F.when(F.col("_place") == 1, F.col("_end")[c]).otherwise(F.col("_last")[c]) for out, c in lags.items()}
    found |= {number: F.col("_rows_before") + F.col("_place")} if number else {}
    return met.select(*rows.columns, *(c.alias(out) for out, c in found.items()))


def finished(rows: DataFrame) -> DataFrame:
    """Scanned rows without the columns that :func:`ranged` added."""
    return rows.drop("_by", "_range")


def value_counts(df: DataFrame, col: str, *, by: list[str]) -> DataFrame:
    """(_by, _v, c, upto, n): each different value of a partition, its rows, the rows up to it in ascending order (nulls
    first), and the partition's rows. Equal values are counted before anything is put in order."""
    counts = df.groupBy(F.struct(*by).alias("_by"), F.col(col).alias("_v")).agg(F.count("*").alias("c"))
    rows = materialize(counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_by", "_v").withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy("_by").agg(F.sum("c").alias("n"))
    return scan(rows, order=["_v"], sums={"upto": F.col("c")}).drop("_range").join(sizes, "_by")
