"""Evaluation against truth, and data-quality checks that return the rows that violate a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.segmented import ranged, scan


def pair_precision_recall(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: precision and recall of (src, dst) pairs. No prediction: precision 1 if there is no truth, else 0;
    no truth: recall 1."""
    t, p = truth.select("src", "dst").distinct().withColumn("t", F.lit(1)), predicted.select("src", "dst").distinct().withColumn("p", F.lit(1))
    n = t.join(p, ["src", "dst"], "full").agg(F.count("t").alias("t"), F.count("p").alias("p"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("both"))
    precision = F.when(F.col("p") > 0, F.col("both") / F.col("p")).when(F.col("t") == 0, 1.0).otherwise(0.0)
    return n.select(precision.alias("precision"), F.when(F.col("t") > 0, F.col("both") / F.col("t")).otherwise(1.0).alias("recall"))


def leader_accuracy(truth: DataFrame, predicted: DataFrame, *, key: str) -> DataFrame:
    """Share of truth groups whose leader is the leader of the one predicted group that overlaps it most, by two at least.

    Both frames: key, grp, leader."""
    t, p = truth.select(key, F.col("grp").alias("tg"), F.col("leader").alias("tl")), predicted.select(key, F.col("grp").alias("pg"), F.col("leader").alias("pl"))
    over = t.join(p, key).groupBy("tg", "tl", "pg", "pl").agg(F.count("*").alias("n")).where("n >= 2")
    best = over.withColumn("r", F.expr("rank() over (partition by tg order by n desc)")).where("r = 1").groupBy("tg").agg(F.count("*").alias("ties"), F.first("tl").alias("tl"), F.first("pl").alias("pl"))
    groups = t.select("tg").distinct().join(best.where("ties = 1"), "tg", "left")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("tl") == F.col("pl")).alias("right"))


def preference_accuracy(pairs: DataFrame, scores: DataFrame, *, key: str, score: str) -> DataFrame:
    """(right + ties / 2) / pairs, of (preferred, other) pairs that have both scores."""
    a, b = scores.select(F.col(key).alias("preferred"), F.col(score).alias("sp")), scores.select(F.col(key).alias("other"), F.col(score).alias("so"))
    won = F.when(F.col("sp") > F.col("so"), 1.0).when(F.col("sp") == F.col("so"), 0.5).otherwise(0.0)
    return pairs.join(a, "preferred").join(b, "other").agg(F.avg(won).alias("accuracy"), F.count("*").alias("pairs"))


def preference_accuracy_within(df: DataFrame, *, by: list[str], score: str, label: str) -> DataFrame:
    """:func:`preference_accuracy` of every chosen row (``label`` 1) against every rejected one (0) of its partition, from the
    rows of each different score and the rejected ones up to it: the pairs themselves are not made."""
    c = F.col
    known = df.where(" and ".join(f"{x} is not null" for x in by)).select(*by, c(score).alias("v"), (c(label) == 1).alias("a"), (c(label) == 0).alias("b"))
    counts = known.groupBy(*by, "v").agg(F.count_if("a").alias("chosen"), F.count_if("b").alias("rejected"))
    rows = scan(ranged(counts, by=by, order=["v"]), order=["v"], sums={"upto": c("rejected")})
    # A null score wins and ties with nothing, and comes first.
    sizes = counts.groupBy(F.struct(*by).alias("_by")).agg(F.sum("rejected").alias("n"), F.sum(F.when(c("v").isNull(), c("rejected")).otherwise(0)).alias("unknown"))
    halves = F.when(c("v").isNull(), F.lit(0)).otherwise(c("chosen") * (2 * (c("upto") - c("unknown")) - c("rejected")))
    wide = lambda x: F.sum(x.cast("decimal(38,0)"))
    total = rows.join(sizes, "_by").agg(wide(halves).alias("h"), wide(c("chosen") * c("n")).alias("p"))
    return total.select(F.when(c("p") > 0, c("h").cast("double") / c("p").cast("double") / 2).alias("accuracy"), F.coalesce(c("p").cast("bigint"), F.lit(0).cast("bigint")).alias("pairs"))


def top_k_overlap(expected: DataFrame, scores: DataFrame, *, key: str, score: str, k: int) -> DataFrame:
    top = scores.orderBy(F.desc(score), key).limit(k).select(key)
    return top.join(expected.select(key).distinct(), key, "left_semi").agg((F.count("*") / k).alias("overlap"))


def calibration_bins(df: DataFrame, *, probability: str, correct: str) -> DataFrame:
    """Ten bins, the last closed at 1: (bin, n, mean_p, share). Values out of range are ignored."""
    rows = df.where(F.col(probability).between(0, 1) & ~F.isnan(F.col(probability)))
    b = F.least(F.floor(F.col(probability) * 10), F.lit(9)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_p"), F.avg(F.col(correct).cast("double")).alias("share"))


def brier_ece(df: DataFrame, *, probability: str, correct: str) -> DataFrame:
    rows = df.where(F.col(probability).between(0, 1) & ~F.isnan(F.col(probability)))
    brier = rows.agg(F.avg(F.pow(F.col(probability) - F.col(correct).cast("double"), 2)).alias("brier"))
    ece = calibration_bins(df, probability=probability, correct=correct).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"))
    return brier.crossJoin(ece)  # two tables of one row


def violations(df: DataFrame, rules: list[tuple[str, Column]], *, key: str) -> DataFrame:
    """(rule, key) for every row and every rule it breaks; an unknown condition is no violation."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicate_keys(df: DataFrame, *, key: str, rule: str = "duplicate") -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def unknown_keys(df: DataFrame, known: DataFrame, *, key: str, rule: str = "unknown") -> DataFrame:
    return df.select(key).distinct().join(known.select(key), key, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def check_groups(df: DataFrame, *, group: str, leader: Column) -> DataFrame:
    """Groups with fewer than two members, or not exactly one leader."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(leader).alias("leaders"))
    return violations(g, [("too small", F.col("n") < 2), ("leaders", F.col("leaders") != 1)], key=group)


def check_output(requested: DataFrame, returned: DataFrame, *, key: str) -> DataFrame:
    """Ids returned twice, not requested, or missing."""
    return duplicate_keys(returned, key=key).unionByName(unknown_keys(returned, requested, key=key, rule="not requested")).unionByName(unknown_keys(requested, returned, key=key, rule="missing"))


def check_preferences(pairs: DataFrame, known: DataFrame, *, key: str) -> DataFrame:
    """Pairs (left, right, preferred) of an item with itself, a foreign preference, unknown items, and repeats in either order."""
    named = pairs.withColumn("pair", F.concat_ws("|", F.least("left", "right"), F.greatest("left", "right")))
    own = violations(named, [("self", F.col("left") == F.col("right")), ("foreign", ~F.col("preferred").isin(F.col("left"), F.col("right")))], key="pair")
    items = named.select(F.explode(F.array("left", "right")).alias(key))
    return own.unionByName(duplicate_keys(named, key="pair", rule="repeated")).unionByName(unknown_keys(items, known, key=key))


def frozen_universe(df: DataFrame, *, key: str, buckets: int = 256) -> DataFrame:
    """One row: number and digest of the sorted ids, as a digest of bucket digests, so no task sees all ids."""
    ids = df.select(F.col(key).cast("string").alias("id")).distinct().withColumn("bucket", F.substring(F.md5("id"), 1, 2))
    each = ids.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("digest"))
    return each.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest"))


#: Least values, but for the rate of false exclusions, which is a most.
GATES = {"precision": 0.999, "recall": 0.95, "leaders": 0.85, "false_exclusion": 0.005, "preference": 0.65, "top_k": 0.60}


def evaluate(metrics: DataFrame, gates: dict[str, float] = GATES) -> DataFrame:
    """One row: the metrics, the gates they miss, whether the labels suffice for a release, and whether all passed.

    ``metrics`` has one row with a column for every gate, and labels, truth_pairs, truth_groups, held_pairs and expected:
    50 to 100 labels, a pair, a group, ten held-out preferences and five expected items make it eligible.
    """
    c = F.col
    fails = [(name, c(name) > top if name == "false_exclusion" else c(name) < top) for name, top in gates.items()]
    missed = F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(True)), F.lit(name)) for name, f in fails]))
    fit = c("labels").between(50, 100) & (c("truth_pairs") > 0) & (c("truth_groups") > 0) & (c("held_pairs") >= 10) & (c("expected") >= 5)
    return metrics.withColumns({"missed": missed, "eligible": F.coalesce(fit, F.lit(False))}).withColumn("passed", c("eligible") & (F.size("missed") == 0))


def compare_scores(pairs: DataFrame, expected: DataFrame, scores: DataFrame, *, key: str, engine: str, score: str, k: int, candidate: str, baseline: str, least_pairs: float = 0.05, least_top: float = 0.10) -> DataFrame:
    """One row: accuracy on (preferred, other) pairs and share of the expected among the top k of a candidate and a
    baseline engine, scored on the same items, the uplifts, and whether both suffice."""
    out = None
    for name, which in (("candidate", candidate), ("baseline", baseline)):
        own = scores.where(F.col(engine) == which)
        right = preference_accuracy(pairs, own, key=key, score=score).select(F.col("accuracy").alias(f"{name}_accuracy"))
        one = right.crossJoin(top_k_overlap(expected, own, key=key, score=score, k=k).withColumnRenamed("overlap", f"{name}_overlap"))
        out = one if out is None else out.crossJoin(one)  # tables of one row
    up = out.withColumns({"pair_uplift": F.col("candidate_accuracy") - F.col("baseline_accuracy"), "top_uplift": F.col("candidate_overlap") - F.col("baseline_overlap")})
    return up.withColumn("passed", F.coalesce((F.col("pair_uplift") >= least_pairs) & (F.col("top_uplift") >= least_top), F.lit(False)))


def build_truth(members: DataFrame, *, group: str, leader: Column, labelled: Column, provenance: str, unchanged: Column) -> DataFrame:
    """Members of complete groups alone: two members or more, one leader, all labelled, of one known provenance and with
    unchanged content."""
    known = lambda c: F.coalesce(c, F.lit(False))
    g = members.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(known(leader)).alias("leaders"), F.min(known(labelled) & known(unchanged)).alias("whole"),
        F.count_distinct(provenance).alias("sources"), F.count_if(F.col(provenance).isNull()).alias("unknown"),
    )
    return members.join(g.where("n >= 2 and leaders = 1 and whole and sources = 1 and unknown = 0").select(group), group, "left_semi")


def check_series(series: DataFrame, *, key: str, codes: list[str]) -> DataFrame:
    """Rules of a labelled series (members, leader, budget, essential, redundant, reasons) that it breaks."""
    c, n = F.col, F.size(F.array_distinct("members"))
    ess, red, why = (F.array_distinct(F.coalesce(x, F.array())) for x in ("essential", "redundant", "reasons"))
    told = c("budget").isNotNull()
    return violations(series, [
        ("too small", n < 2), ("leader", ~F.array_contains("members", c("leader"))), ("budget", told & ~c("budget").between(1, n)),
        ("leader not essential", told & ~F.array_contains(ess, c("leader"))), ("foreign", told & (F.size(F.array_except(F.array_union(ess, red), "members")) > 0)),
        ("both", told & (F.size(F.array_intersect(ess, red)) > 0)), ("over budget", told & (F.size(ess) > c("budget"))), ("no reason", told & (F.size(why) == 0)),
        ("unknown reason", told & (F.size(F.array_except(why, F.array(*map(F.lit, codes)))) > 0)), ("no budget", ~told & (F.size(ess) + F.size(red) + F.size(why) > 0)),
    ], key=key)


def check_corpus(rows: DataFrame, *, key: str, columns: list[str], context: str, split: str) -> DataFrame:
    """Rows of a learning corpus not made by people or with a vector that isn't whole 32-bit numbers, contexts in two
    splits, and columns that are missing or not expected."""
    odd = sorted(set(rows.columns) ^ set(columns))
    own = violations(rows, [("origin", ~F.col("human_origin").eqNullSafe(1)), ("vector", F.length("vector") % 4 != 0)], key=key)
    torn = rows.groupBy(context).agg(F.count_distinct(split).alias("n")).where("n > 1").select(F.lit("context").alias("rule"), F.col(context).cast("string").alias("key"))
    shape = rows.sparkSession.createDataFrame([("column", c) for c in odd], "rule string, key string")
    return own.unionByName(torn).unionByName(shape)
