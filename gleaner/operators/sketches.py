"""Summaries as mergeable sketches: stored by part, merged to any coarser level without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ordered import quantiles

#: Size of the quantile sketch (rank error about 2.3 / K ** 0.9) and, as a power of two, of the distinct sketch.
K, LOG = 400, 14


def sketched(df: DataFrame, *, by: list[str], value: str, item: str) -> DataFrame:
    """(by, n, total, least, most, values, items): count, sum, bounds, a quantile sketch of ``value`` and a distinct sketch
    of ``item``. Null and NaN values count in ``n`` alone, null items not at all."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, F.lit(K)).alias("values"), F.hll_sketch_agg(F.col(item).cast("string"), F.lit(LOG)).alias("items"),
    )


def rolled_up(sketches: DataFrame, *, by: list[str]) -> DataFrame:
    """The same columns for coarser groups; merging in any order and in several steps gives estimates within the same
    bounds, and exactly the same counts, sums and bounds."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_double("values", F.lit(K)).alias("values"), F.hll_union_agg("items").alias("items"),
    )


def distinct_items(items: str = "items") -> Column:
    """The estimated number of different items, within some 2 % (two deviations)."""
    return F.hll_sketch_estimate(items)


def quantile(share: float, values: str = "values") -> Column:
    """The estimated quantile; its rank errs by some 1 % at most."""
    return F.kll_sketch_get_quantile_double(F.col(values), F.lit(float(share)))


def robust_stats(sketches: DataFrame, *, by: list[str]) -> DataFrame:
    """(by, n, med, p05, p95, items): estimates from sketches of the wanted level."""
    return sketches.select(*by, "n", quantile(0.5).alias("med"), quantile(0.05).alias("p05"), quantile(0.95).alias("p95"), distinct_items().alias("items"))


def exact_stats(df: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """(by, med, mad, p05, p95): exact, by two passes over the rows, where an estimate is not enough."""
    first = quantiles(df, value, by=by, shares=[0.5, 0.05, 0.95]).select(*by, F.col("q")[0].alias("med"), F.col("q")[1].alias("p05"), F.col("q")[2].alias("p95"))
    away = quantiles(df.join(first, by), F.abs(F.col(value) - F.col("med")), by=by, shares=[0.5])
    return first.join(away, by).select(*by, "med", F.col("q")[0].alias("mad"), "p05", "p95")
