"""Window operators: relative ranks, sessions, scenes, pages, shortlists, samples and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators.segmented import finished, ranged, scan, value_counts
from gleaner.sources.tables import materialize


def _part(by: list[str]) -> str:
    return ", ".join(by)


def percentile_rank(df: DataFrame, col: str, *, by: list[str], out: str, bounded: bool = False) -> DataFrame:
    """(number of values <= v, less 1) over (n - 1); null stays null and isn't counted; one value gives 0.5.

    Different values are counted and put in order by a segmented scan, whatever the size of a partition; where
    partitions are known to be small (``bounded``) one window each does.
    """
    if bounded:
        below = F.expr(f"count({col}) over (partition by {_part(by)} order by {col} range between unbounded preceding and current row)")
        n = F.expr(f"count({col}) over (partition by {_part(by)})")
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.when(n == 1, F.lit(0.5)).otherwise((below - 1) / (n - 1))))
    ranks = value_counts(df.where(F.col(col).isNotNull()), col, by=by)
    ranks = ranks.select("_by", "_v", F.when(F.col("n") == 1, F.lit(0.5)).otherwise((F.col("upto") - 1) / (F.col("n") - 1)).alias(out))
    return df.withColumns({"_by": F.struct(*by), "_v": F.col(col)}).join(ranks, ["_by", "_v"], "left").select(*df.columns, out)


def midrank_percentile(df: DataFrame, col: str, *, by: list[str], out: str) -> DataFrame:
    """(values below + (equal - 1) / 2) over (n - 1), times 100; 50 for one value. Nulls are equal and come first."""
    ranks = value_counts(df, col, by=by)
    middle = (F.col("upto") - F.col("c") + (F.col("c") - 1) / 2) / (F.col("n") - 1) * 100
    ranks = ranks.select("_by", F.struct("_v").alias("_v"), F.when(F.col("n") <= 1, F.lit(50.0)).otherwise(middle).alias(out))
    return df.withColumns({"_by": F.struct(*by), "_v": F.struct(F.col(col).alias("_v"))}).join(ranks, ["_by", "_v"]).select(*df.columns, out)


def normalize_metrics(df: DataFrame, metrics: list[str], *, by: list[str], quality_of: list[str], bounded: bool = False) -> DataFrame:
    """Relative ranks ``<metric>_rank`` of each metric and the mean of some of them as ``quality``."""
    for m in metrics:
        df = percentile_rank(df, m, by=by, out=f"{m}_rank", bounded=bounded)
    return df.withColumn("quality", X.weighted_mean([(F.col(f"{m}_rank"), 1.0) for m in quality_of], None))


def named_score_ranks(df: DataFrame, names: list[str], *, key: list[str], by: list[str]) -> DataFrame:
    """Relative rank of each named score in its partition, as a map; 0 counts as missing."""
    cells = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    long = df.select(*dict.fromkeys([*key, *by]), F.expr(f"stack({len(names)}, {cells}) as (name, raw)")).withColumn("score", F.when(F.col("raw") != 0, F.col("raw")))
    ranked = percentile_rank(long, "score", by=[*by, "name"], out="rank").where("rank is not null")
    return ranked.groupBy(*dict.fromkeys([*key, *by])).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rank")))).alias("ranks"))


def quantiles(df: DataFrame, value: Column | str, *, by: list[str], shares: list[float], accuracy: int = 10000) -> DataFrame:
    """(by, q): the exact quantiles of a value, interpolated between neighbours; null or NaN values and null keys don't count.

    A sketch of known error gives bounds on both sides of each quantile; what lies outside is only counted, and the
    different values between the bounds, some 4 / ``accuracy`` of all, are put in order.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    around = [min(1.0, max(0.0, s + side * 2 / accuracy)) for side in (-1, 1) for s in shares]
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", around, accuracy).alias("b"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share"), F.col("b")[i].alias("low"), F.col("b")[len(shares) + i].alias("high")) for i, s in enumerate(shares))))
    met = rows.join(bounds.select(*by, "n", each.alias("e")).select(*by, "n", "e.*"), by)
    zone = F.when(F.col("v") < F.col("low"), 0).when(F.col("v") <= F.col("high"), 1).otherwise(2).alias("zone")
    met = met.select(*by, "i", "n", "share", zone, "v").withColumn("own", F.when(F.col("zone") == 1, F.col("v")))
    cells = met.groupBy(*by, "i", "n", "share", "zone", "own").agg(F.count("*").alias("c"), F.max("v").alias("most"), F.min("v").alias("least"))
    # Below the bounds only the largest value is known, above them only the smallest; either may be a neighbour.
    cells = cells.withColumn("upto", F.expr(f"sum(c) over (partition by {_part(by)}, i order by zone, own rows unbounded preceding)"))
    at = F.col("share") * (F.col("n") - 1)
    lower = F.floor(at)
    upper = F.least(lower + 1, F.col("n") - 1)

    def rank(r: Column) -> Column:
        outside = ((F.col("zone") == 0) & (r != F.col("upto") - 1)) | ((F.col("zone") == 2) & (r != F.col("upto") - F.col("c")))
        held = F.when(outside, F.raise_error(F.lit("a quantile lies outside its bounds")).cast("double")).when(F.col("zone") == 0, F.col("most")).otherwise(F.col("least"))
        return F.max(F.when((r >= F.col("upto") - F.col("c")) & (r < F.col("upto")), held))

    found = cells.groupBy(*by, "i").agg(rank(lower).alias("x"), rank(upper).alias("y"), F.first(at - lower).alias("part"))
    found = found.select(*by, F.struct("i", (F.col("x") + (F.col("y") - F.col("x")) * F.col("part")).alias("q")).alias("e"))
    return found.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("e")).select(*by, F.transform("e", lambda e: e["q"]).alias("q"))


def median_and_deviation(df: DataFrame, value: str, *, by: list[str]) -> DataFrame:
    """(by, med, mad): the exact median of a column and the median distance from it."""
    rows = materialize(df.select(*by, value))
    middle = materialize(quantiles(rows, value, by=by, shares=[0.5]).select(*by, F.col("q")[0].alias("med")))
    away = quantiles(rows.join(middle, by), F.abs(F.col(value) - F.col("med")), by=by, shares=[0.5])
    return middle.join(away, by).select(*by, "med", F.col("q")[0].alias("mad"))


def adaptive_episodes(df: DataFrame, *, micros: Column, by: list[str], order: list[str], low: float = 300, high: float = 1800, spread: float = 6, least: float = 90, moved: Column | None = None) -> DataFrame:
    """Rows with their ``episode``: a new one where the gap exceeds a threshold per partition, or the place changes.

    The threshold is median + max(least, spread * MAD) of the positive gaps, within bounds; unknown gaps never split.
    ``moved`` may use columns of the row and of the one before it (prefixed ``prev_``).
    """
    rows = scan(ranged(df.withColumn("t", micros), by=by, order=order), order=order, lags={"_t": "t"})
    rows = materialize(rows.withColumn("gap", F.greatest(F.col("t") - F.col("_t"), F.lit(0)) / 1e6))
    mad = median_and_deviation(rows.where("gap > 0"), "gap", by=by)
    limit = X.clamp(F.greatest(F.lit(float(low)), F.col("med") + F.greatest(F.lit(float(least)), spread * F.col("mad"))), low, high)
    split = F.coalesce(F.col("gap") > F.col("_limit"), F.lit(False)) | (moved if moved is not None else F.lit(False))
    limited = rows.join(mad.select(F.struct(*by).alias("_by"), limit.alias("_limit")), "_by", "left")
    return finished(scan(limited, order=order, sums={"episode": split.cast("int")})).withColumnRenamed("_limit", "limit").drop("t", "_t")


def semantic_scenes(df: DataFrame, *, vector: str, by: list[str], order: list[str], low: float = 0.72, high: float = 0.93, spread: float = 2.5, least: float = 0.025) -> DataFrame:
    """Rows with their ``scene``: a break where the similarity to the row before falls below median - max(least,
    spread * MAD) of its partition, within bounds; unknown similarity never breaks."""
    rows = scan(ranged(df, by=by, order=order), order=order, lags={"_before": vector})
    rows = materialize(rows.withColumn("sim", X.cosine(F.col(vector), F.col("_before"))).drop("_before"))
    mad = median_and_deviation(rows.where("sim is not null"), "sim", by=by)
    limits = mad.select(F.struct(*by).alias("_by"), X.clamp(F.col("med") - F.greatest(F.lit(least), spread * F.col("mad")), low, high).alias("limit"))
    limited = rows.join(limits, "_by", "left")
    return finished(scan(limited, order=order, sums={"scene": F.coalesce(F.col("sim") < F.col("limit"), F.lit(False)).cast("int")}))


def keyset_page(df: DataFrame, *, score: str, key: str, limit: int, cursor: tuple[float, object] | None = None, offset: int = 0) -> DataFrame:
    """One page by descending score (null last) and ascending key, after a cursor or an offset."""
    rows = df.withColumn("order_score", F.coalesce(F.col(score), F.lit(-1.0)))
    if cursor:
        rows = rows.where((F.col("order_score") < cursor[0]) | ((F.col("order_score") == cursor[0]) & (F.col(key) > cursor[1])))
    rows = rows.orderBy(F.desc("order_score"), F.asc(key))
    return (rows.offset(offset) if offset else rows).limit(limit)


def next_cursor(page: DataFrame, *, key: str, limit: int) -> DataFrame:
    """The last row of a full page; no row otherwise."""
    last = F.max_by(F.struct("order_score", key), F.struct(-F.col("order_score"), F.col(key)))
    return page.agg(last.alias("last"), F.count("*").alias("n")).where(F.col("n") == limit).select("last.*")


def top_k(df: DataFrame, *, by: list[str], order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each partition with their ``place`` and the partition's size."""
    sized = df.withColumn("group_size", F.expr(f"count(*) over (partition by {_part(by)})"))
    return sized.withColumn("place", F.expr(f"row_number() over (partition by {_part(by)} order by {order})")).where(F.col("place") <= k)


def selection_threshold(df: DataFrame, *, by: list[str], score: str, ratio: float, default: float) -> DataFrame:
    """(by, threshold): the score of the ceil(n * ratio)-th best, scores within 0..100.

    Scores are first counted in 10,001 slices of a partition; then only the different scores of the slice that holds the
    wanted one are put in order.
    """
    rows = df.where(F.col(score).isNotNull()).select(*by, X.clamp(F.col(score), 0.0, 100.0).alias("s")).withColumn("slice", F.floor(F.col("s") * 100))
    p = _part(by)
    slices = rows.groupBy(*by, "slice").agg(F.count("*").alias("c"))
    placed = slices.withColumn("upto", F.expr(f"sum(c) over (partition by {p} order by slice desc)")).withColumn("n", F.expr(f"sum(c) over (partition by {p})"))
    placed = placed.withColumn("k", F.greatest(F.ceil(F.col("n") * ratio), F.lit(1)) - (F.col("upto") - F.col("c")))
    held = placed.where((F.col("k") >= 1) & (F.col("k") <= F.col("c"))).select(*by, "slice", "k")
    counts = rows.join(held, [*by, "slice"]).groupBy(*by, "s").agg(F.count("*").alias("c"), F.first("k").alias("k"))
    found = counts.withColumn("upto", F.expr(f"sum(c) over (partition by {p} order by s desc)")).where("upto >= k").groupBy(*by).agg(F.max("s").alias("threshold"))
    return df.select(*by).distinct().join(found, by, "left").select(*by, F.coalesce("threshold", F.lit(default)).alias("threshold"))


def center_deltas(df: DataFrame, *, by: list[str], delta: str, ready: Column, most: float = 12) -> DataFrame:
    """Deltas less their partition's median over ready rows, within bounds; 0 for the others."""
    middle = quantiles(df.where(ready), delta, by=by, shares=[0.5]).select(*by, F.col("q")[0].alias("middle"))
    centered = X.clamp(F.col(delta) - F.col("middle"), -most, most)
    return df.join(middle, by, "left").withColumn("centered", F.when(ready, centered).otherwise(F.lit(0.0))).drop("middle")


def latest(df: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each partition by the order columns."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(*order)).alias("r")).select(*by, "r.*")


def hash_sample(df: DataFrame, *, key: str, n: int, seed: str, reserved: Column | None = None) -> DataFrame:
    """``n`` rows by the digest of seed and key, reserved ones first."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    first = F.coalesce(reserved, F.lit(False)) if reserved is not None else F.lit(False)
    return df.withColumns({"digest": digest, "is_reserved": first}).orderBy(F.desc("is_reserved"), "digest").limit(n)


def best_sized_group(df: DataFrame, *, group: str, low: int = 2, high: int = 12, target: int = 6) -> DataFrame:
    """The group whose size within bounds is nearest the target, ties by digest."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    order = F.struct(F.abs(F.col("n") - target), F.sha2(F.col(group).cast("string"), 256))
    return sizes.agg(F.min_by(F.struct(group, "n"), order).alias("g")).select("g.*")


def position_coherence(df: DataFrame, *, by: list[str], position: str, gap: int = 25, base: int = 50, each: int = 5) -> DataFrame:
    """Whether a group's positions lie together: no gap over ``gap`` and a span of at most max(base, each * n)."""
    steps = df.withColumn("step", F.col(position) - F.expr(f"lag({position}) over (partition by {_part(by)} order by {position})"))
    g = steps.groupBy(*by).agg(F.count("*").alias("n"), F.max("step").alias("max_gap"), (F.max(position) - F.min(position)).alias("span"))
    return g.withColumn("coherent", (F.coalesce("max_gap", F.lit(0)) <= gap) & (F.col("span") <= F.greatest(F.lit(base), each * F.col("n"))))


def adjacent_pairs(df: DataFrame, *, by: list[str], key: str, order: str) -> DataFrame:
    """Consecutive items of ordered lists: (by, preferred, other)."""
    rows = df.select(*by, F.col(key).alias("preferred"), F.expr(f"lead({key}) over (partition by {_part(by)} order by {order})").alias("other"))
    return rows.where("other is not null")
