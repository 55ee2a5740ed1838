"""Quality of grids of cells: whole grids and marked regions of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The figures that :func:`cell_metrics` gives.
METRICS = [
    "laplacian_variance", "gradient_energy", "mean", "spread", "dynamic_range", "edge_density", "coherence", "p01", "p05", "p50", "p95", "p99", "dark_ratio", "bright_ratio", "entropy",
]
#: A gradient that is an edge, values that are clipped, and the bins of the entropy over 0..1.
EDGE, DARK, BRIGHT, BINS = 0.08, 0.01, 0.99, 256


def _next_to(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with the values right, left, below and above of them, null outside the grid."""
    part = ", ".join(by)
    return cells.withColumns({
        "rt": F.expr(f"lead(v) over (partition by {part}, y order by x)"), "lt": F.expr(f"lag(v) over (partition by {part}, y order by x)"),
        "dn": F.expr(f"lead(v) over (partition by {part}, x order by y)"), "up": F.expr(f"lag(v) over (partition by {part}, x order by y)"),
    })


def cell_metrics(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """(by, METRICS) of grids of cells (by, x, y, v): sharpness, gradients and their common direction, exposure, contrast
    and entropy; null where a grid is too small for a figure. One grid's cells meet in one task."""
    q = F.percentile("v", F.array(*(F.lit(p) for p in (0.01, 0.05, 0.5, 0.95, 0.99))))
    gx, gy = F.col("rt") - F.col("v"), F.col("dn") - F.col("v")
    both = gx.isNotNull() & gy.isNotNull()
    grad = gx * gx + gy * gy
    mean = lambda c: F.avg(F.when(both, c))
    xx, yy, xy = mean(gx * gx), mean(gy * gy), mean(gx * gy)
    coherence = F.when(xx + yy > 1e-12, F.sqrt(F.greatest(F.lit(0.0), F.pow(xx - yy, 2) + 4 * xy * xy)) / (xx + yy)).otherwise(F.when(xx.isNotNull(), F.lit(0.0)))
    own = _next_to(cells, by).groupBy(*by).agg(
        F.var_pop(F.col("rt") + F.col("lt") + F.col("dn") + F.col("up") - 4 * F.col("v")).alias("laplacian_variance"), F.avg(grad).alias("gradient_energy"),
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"), (q[4] - q[0]).alias("dynamic_range"), mean((F.sqrt(grad) > EDGE).cast("double")).alias("edge_density"), coherence.alias("coherence"),
        *(q[k].alias(name) for k, name in enumerate(["p01", "p05", "p50", "p95", "p99"])), F.avg((F.col("v") <= DARK).cast("double")).alias("dark_ratio"), F.avg((F.col("v") >= BRIGHT).cast("double")).alias("bright_ratio"),
    )
    counts = cells.where(F.col("v").between(0, 1)).groupBy(*by, F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.count("*").alias("_c"))
    # With c of n values in a bin: the sum of -c/n log c/n is log n - (the sum of c log c) / n.
    entropy = counts.groupBy(*by).agg((F.log2(F.sum("_c")) - F.sum(F.col("_c") * F.log2("_c")) / F.sum("_c")).alias("entropy"))
    same = [own[c].eqNullSafe(entropy[c]) for c in by]
    return own.join(entropy, same, "left").select(*(own[c] for c in by), *(own[c] for c in METRICS[:-1]), F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


#: Angles that lines are looked for at, in degrees.
ANGLES = list(range(-29, 30, 2))


def dominant_lines(cells: DataFrame, *, by: list[str]) -> DataFrame:
    """(by, angle, support): the one long, nearly level line of each grid of cells (by, x, y, v), by votes.

    Strong, level-facing edge cells of the middle rows vote, by their gradient, for every angle and the intercept bin that
    puts a line of it through them. The bin with most votes wins; its support is the share of columns it covers times
    its dominance, less for parallel lines and for upright structure. The angle is null under a support of 0.08; grids with
    too few edge cells or too few on the line have (null, 0). One grid's cells meet in one task, the votes do not.
    """
    size = cells.groupBy(*by).agg(F.max("y").alias("h"), F.max("x").alias("w"))  # of the gradients: one less than the cells
    met = _next_to(cells, by).where("rt is not null and dn is not null").join(size, by)
    met = met.withColumns({"gx": F.col("rt") - F.col("v"), "gy": F.col("dn") - F.col("v")}).withColumn("g", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    middle = met.where((F.col("y") >= F.floor(F.col("h") * 0.2)) & (F.col("y") < F.greatest(F.floor(F.col("h") * 0.8), F.lit(1)))).select(*by, "x", "y", "h", "w", "gx", "gy", "g")
    found = middle.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("g") > 1e-6).alias("edges"), F.percentile(F.when(F.col("g") > 1e-6, F.col("g")), 0.75).alias("q"))
    limits = found.where("n >= 64 and edges >= 32").select(*by, F.greatest(F.lit(0.025), "q").alias("least"))
    strong = middle.join(limits, by).where(F.col("g") >= F.col("least"))
    level = F.abs("gy") >= F.abs("gx") * 0.5
    sums = strong.groupBy(*by).agg(F.count_if(level).alias("level"), F.coalesce(F.sum(F.when(level, F.col("g"))), F.lit(0.0)).alias("weight"), F.coalesce(F.sum(F.when(F.abs("gx") > F.abs("gy") * 1.5, F.col("g"))), F.lit(0.0)).alias("upright"))
    facing = strong.where(level).join(sums.where("level >= 32").select(*by), by)
    step = F.greatest(F.lit(2.0), F.col("h") / 80)
    slope = F.tan(F.radians("angle"))
    across = F.col("x") - (F.col("w") - 1) / 2
    voters = facing.withColumn("angle", F.explode(F.array(*map(F.lit, ANGLES)))).withColumn("step", step)
    voters = voters.withColumn("bin", F.floor((F.col("y") - slope * across) / F.col("step")).cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < F.greatest(F.lit(1), F.ceil(F.col("h") / F.col("step")) + 1)))
    votes = voters.groupBy(*by, "angle", "bin").agg(F.sum("g").alias("votes"))
    best = votes.groupBy(*by).agg(F.max_by(F.struct("angle", "bin", "votes"), F.struct("votes", -F.col("angle"), -F.col("bin"))).alias("best")).select(*by, F.col("best.angle").alias("angle"), F.col("best.bin").alias("bin"), F.col("best.votes").alias("most"))
    line = facing.join(best, by).withColumn("step", step)
    on = F.abs(F.col("y") - ((F.col("bin") + 0.5) * F.col("step") + slope * across)) <= F.col("step")
    inliers = line.where(on).groupBy(*by).agg(F.count("*").alias("inliers"), F.count_distinct(F.least(F.floor(F.col("x") * 16 / F.greatest(F.lit(1), F.col("w"))), F.lit(15))).alias("columns"))
    # Bins at the winner's angle with a good share of its votes; neighbours are one line.
    rivals = votes.join(best.select(*by, "angle", "most"), [*by, "angle"]).where(F.col("votes") >= F.col("most") * 0.35)
    gaps = rivals.withColumn("gap", F.col("bin") - F.expr(f"lag(bin) over (partition by {', '.join(by)} order by bin)"))
    lines = gaps.groupBy(*by).agg(F.count_if(F.coalesce(F.col("gap") > 2, F.lit(True))).alias("lines"))
    told = best.join(inliers, by).join(lines, by).join(sums, by).where("inliers >= 24")
    plain = 1 / (1 + 0.65 * F.greatest(F.lit(0), F.col("lines") - 1)) * F.greatest(F.lit(0.25), 1 - F.col("upright") / F.greatest(F.col("weight") + F.col("upright"), F.lit(1e-9)))
    support = F.round(F.col("columns") / 16 * F.least(F.lit(1.0), F.col("most") / F.greatest(F.col("weight"), F.lit(1e-9)) * 2.5) * plain, 4)
    told = told.select(*by, F.when(support >= 0.08, F.col("angle").cast("double")).alias("angle"), support.alias("support"))
    return size.select(*by).join(told, by, "left").select(*by, "angle", F.coalesce("support", F.lit(0.0)).alias("support"))


def marked_regions(marks: DataFrame, *, key: str, cols: int, rows: int, least: int = 8, pad: float = 0.08, first: int = 10) -> DataFrame:
    """(key, region, left, right, top, bottom, area, contacts) of marks (key, region, x, y, w, h), shares of the grid from
    its bottom left.

    The first marks count, by region from 0; what leaves the grid is cut off, what is under 0.25 % of it or, padded,
    under ``least`` cells wide or high is dropped, and so are marks with a null. ``contacts``: sides at the grid's edge.
    """
    inside = lambda c, top=F.lit(1.0): F.greatest(F.lit(0.0), F.least(top, F.col(c)))
    m = marks.where(F.col("region") < first).dropna(subset=["x", "y", "w", "h"]).withColumns({"x": inside("x"), "y": inside("y")})
    m = m.withColumns({"w": inside("w", 1 - F.col("x")), "h": inside("h", 1 - F.col("y"))}).withColumn("area", F.col("w") * F.col("h")).where("area >= 0.0025")
    x, y, w, h = (F.col(c) for c in "xywh")
    cell = lambda share, size: F.bround(share * size).cast("int")
    m = m.withColumns({
        "left": F.greatest(F.lit(0), cell(x - w * pad, cols)), "right": F.least(F.lit(cols), cell(x + w + w * pad, cols)),
        "top": F.greatest(F.lit(0), cell(1 - y - h - h * pad, rows)), "bottom": F.least(F.lit(rows), cell(1 - y + h * pad, rows)),
        "contacts": (x <= 0.012).cast("int") + (y <= 0.012).cast("int") + (x + w >= 0.988).cast("int") + (y + h >= 0.988).cast("int"),
    })
    return m.where((F.col("right") - F.col("left") >= least) & (F.col("bottom") - F.col("top") >= least)).select(key, "region", "left", "right", "top", "bottom", "area", "contacts")


def region_metrics(cells: DataFrame, marks: DataFrame, *, key: str, cols: int, rows: int, least: int = 8) -> DataFrame:
    """One row per grid with a region that counts: region_count, coverage, boundary (share of the weight at the grid's
    edge) and METRICS, each the mean over regions weighted by the root of their area; 0 stands for a null figure."""
    regions = marked_regions(marks, key=key, cols=cols, rows=rows, least=least)
    inside = (F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")) & (F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom"))
    own = cells.join(regions, key).where(inside).select(key, "region", "x", "y", "v")
    weight = F.sqrt("area")
    met = cell_metrics(own, by=[key, "region"]).join(regions.select(key, "region", "area", "contacts"), [key, "region"])
    mean = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * weight) / F.sum(weight)
    edge = F.sum(weight * F.least(F.lit(1.0), F.col("contacts") / 2)) / F.sum(weight)
    return met.groupBy(key).agg(
        F.count("*").alias("region_count"), F.least(F.lit(1.0), F.sum("area")).alias("coverage"), F.least(F.lit(1.0), edge).alias("boundary"), *(mean(c).alias(c) for c in METRICS)
    )
