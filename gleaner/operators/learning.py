"""Preference learning without leaks between contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators.ordered import midrank_percentile
from gleaner.operators.segmented import finished, ranged, scan
from gleaner.sources.tables import materialize


def derive_preferences(sources: list[DataFrame]) -> DataFrame:
    """(x, y, preferred) from (preferred, other) frames; for an unordered pair the first source that has it wins."""
    rows = None
    for k, s in enumerate(sources):
        one = s.select(F.least("preferred", "other").alias("x"), F.greatest("preferred", "other").alias("y"), "preferred", F.lit(k).alias("priority"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("x", "y").agg(F.min_by("preferred", F.struct("priority", "preferred")).alias("preferred"))


def assign_split(df: DataFrame, *, context: str, every: int = 4) -> DataFrame:
    """(context, split): whole contexts in digest order, each ``every``-th held out."""
    held = F.col("place") % every == 0
    return _in_digest_order(df.select(context).distinct(), context).select(context, F.when(held, "held_out").otherwise("calibration").alias("split"))


def _in_digest_order(contexts: DataFrame, context: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """Different contexts numbered by ``place``, with running sums, over all tasks."""
    rows = contexts.withColumns({"_all": F.lit(0), "_digest": F.sha2(F.col(context).cast("string"), 256)})
    order = ["_digest", context]
    return finished(scan(ranged(rows, by=["_all"], order=order), order=order, sums=sums, number="place")).drop("_all", "_digest")


def balanced_split(rows: DataFrame, memory: DataFrame, *, context: str, least: int = 3) -> DataFrame:
    """(context, examples, split) of all contexts: those of ``memory`` (context, examples, split) keep their split for ever.

    A context remembered in both is for calibration. New contexts come in digest order: while fewer than ``least`` examples
    are for calibration they go there; then the next is held out while fewer contexts are held out than calibrate, and
    calibrates otherwise. Examples without a context calibrate. ``rows`` has one row for each new example.
    """
    known = memory.groupBy(F.col(context).alias("_m")).agg(F.sum("examples").alias("seen"), F.when(F.bool_and(F.col("split") == "held_out"), "held_out").otherwise("calibration").alias("old"))
    now = rows.groupBy(F.col(context).alias("_n")).agg(F.count("*").alias("more"))
    own = F.coalesce("_m", "_n")
    both = known.join(now, F.col("_m").eqNullSafe(F.col("_n")), "full")
    both = materialize(both.select(own.alias(context), (F.coalesce("seen", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("examples"), F.when(own.isNull(), "calibration").otherwise(F.col("old")).alias("old")))
    settled = both.where("old is not null")
    named = settled.where(F.col(context).isNotNull())
    calibrates = F.col("old") == "calibration"
    start = settled.agg(F.coalesce(F.sum(F.when(calibrates, F.col("examples"))), F.lit(0)).alias("had"))
    sides = named.agg(F.count_if(calibrates).alias("c"), F.count_if(~calibrates).alias("h"))
    new = _in_digest_order(both.where("old is null").select(context, "examples"), context, {"upto": F.col("examples")})
    new = new.crossJoin(F.broadcast(start)).withColumn("early", F.col("had") + F.col("upto") - F.col("examples") < least)
    new = materialize(new)
    lead = new.agg(F.count_if("early").alias("first"))
    placed = new.crossJoin(F.broadcast(sides)).crossJoin(F.broadcast(lead)).withColumn("j", F.col("place") - F.col("first"))
    # So many go to the smaller side first; from then on the sides take turns.
    ahead = F.col("c") + F.col("first") - F.col("h")
    turn = F.col("j") - F.when(ahead > 0, ahead).otherwise(1 - ahead)
    held = F.when(turn <= 0, ahead > 0).otherwise(F.when(ahead > 0, turn % 2 == 0).otherwise(turn % 2 == 1))
    split = F.when(~F.col("early") & held, "held_out").otherwise("calibration")
    return settled.select(context, "examples", F.col("old").alias("split")).unionByName(placed.select(context, "examples", split.alias("split")))


def filter_leakage(pairs: DataFrame, *, left: str, right: str) -> DataFrame:
    """Held-out pairs whose items are in no training pair."""
    train = pairs.where("split = 'calibration'")
    seen = train.select(F.col(left).alias("item")).union(train.select(right)).distinct()
    held = pairs.where("split = 'held_out'")
    for side in (left, right):
        held = held.join(seen.withColumnRenamed("item", side), side, "left_anti")
    return held


def fit_pairwise_ranker(pairs: DataFrame, *, by: str, rounds: int = 30, shrink: float = 0.015, longest: float = 3.0) -> DataFrame:
    """(by, weights, n): logistic weights of the unit differences of (preferred, rejected) vectors, one model per profile.

    All pairs of a profile count at once in each of ``rounds`` accelerated gradient steps, which replace single steps in
    row order: every task sums the slopes of its own rows, so a profile of any size is dealt over all tasks. Weights
    shrink a little each step and stay within ``longest``; fewer than three pairs fit none. Pairs with a null, or with
    vectors of different lengths, don't count; those of another length than their profile's longest don't either.
    """
    gap = F.zip_with("preferred", "rejected", lambda a, b: a.cast("double") - b.cast("double"))
    rows = pairs.where(F.size("preferred") == F.size("rejected")).select(by, gap.alias("gap")).where(F.col(by).isNotNull() & F.forall("gap", lambda x: x.isNotNull() & ~F.isnan(x)))
    length = F.greatest(X.norm(F.col("gap")), F.lit(1e-8))
    rows = materialize(rows.select(by, F.transform("gap", lambda x: x / length).alias("gap")))
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(F.size("gap")).alias("dim")).where("n >= 3")
    zero = F.array_repeat(F.lit(0.0), F.col("dim"))
    models = materialize(sizes.select(by, "n", "dim", zero.alias("weights"), zero.alias("ahead")))
    kind = dict(pairs.dtypes)[by]

    def slopes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby(by, sort=False):
                x, w = np.stack(own["gap"].to_numpy()), own["ahead"].iloc[0]
                pull = 1 / (1 + np.exp(np.clip(x @ w, -20, 20)))
                yield pd.DataFrame({by: [name], "slope": [pull @ x]})

    for k in range(rounds):
        met = rows.join(models.select(by, "dim", "ahead"), by).where(F.size("gap") == F.col("dim")).select(by, "gap", "ahead")
        cells = met.mapInPandas(slopes, f"{by} {kind}, slope array<double>").select(by, F.posexplode("slope").alias("at", "s"))
        summed = cells.groupBy(by, "at").agg(F.sum("s").alias("s")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("sums"))
        # The loss bends by .25 + shrink at most, since differences have length one.
        step = 1 / (0.25 + shrink)
        moved = F.zip_with("ahead", "sums", lambda w, g: w + F.lit(step) * (g["s"] / F.col("n") - F.lit(shrink) * w))
        new = models.join(summed, by).select(by, "n", "dim", F.col("weights").alias("old"), moved.alias("moved"))
        new = new.withColumn("size", X.norm(F.col("moved"))).withColumn("new", F.transform("moved", lambda w: F.when(F.col("size") > longest, w * longest / F.col("size")).otherwise(w)))
        ahead = F.zip_with("new", "old", lambda w, o: w + F.lit(k / (k + 3)) * (w - o))
        models = materialize(new.select(by, "n", "dim", F.col("new").alias("weights"), ahead.alias("ahead")))
    return models.select(by, "weights", "n")


def pairwise_accuracy(pairs: DataFrame, models: DataFrame, *, by: str) -> DataFrame:
    """(by, accuracy, n): share of pairs whose preferred vector scores higher."""
    gap = F.zip_with("preferred", "rejected", lambda a, b: a.cast("double") - b.cast("double"))
    scored = pairs.join(models.select(by, "weights"), by).withColumn("right", (X.dot(F.col("weights"), gap) > 0).cast("double"))
    return scored.groupBy(by).agg(F.round(F.avg("right"), 6).alias("accuracy"), F.count("*").alias("n"))


def apply_ranker(vector: Column, weights: Column, reliability: Column) -> Column:
    """Personal delta within 20 points; 0 for vectors of another size."""
    value = F.tanh(2 * X.dot(vector, weights) / F.greatest(X.norm(vector), F.lit(1e-8))) * 20 * reliability
    return F.when(F.size(vector) == F.size(weights), value).otherwise(F.lit(0.0))


def simplex(w: np.ndarray) -> np.ndarray:
    """The nearest point with parts of 0 or more that sum to 1."""
    high = np.sort(w)[::-1]
    over = (np.cumsum(high) - 1) / np.arange(1, len(w) + 1)
    return np.maximum(w - over[np.nonzero(high > over)[0][-1]], 0)


def _downhill(w: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The least point on the simplex of a quadratic given at ``w``; one weight per engine, so a handful of numbers."""
    at, step = w, 1 / max(float(np.trace(bend)), 1e-12)
    for _ in range(2000):
        at = simplex(at - step * (slope + bend @ (at - w)))
    return at


def engine_gaps(pairs: DataFrame, *, key: str, context: str, engines: list[str]) -> DataFrame:
    """(key, context, split, gap): per engine, how much higher the preferred side's mid-rank percentile within its context
    is than the other's. ``pairs`` has ``<engine>_preferred`` and ``<engine>_other``; pairs with a null don't count."""
    side = lambda s: F.struct(F.lit(s == "preferred").alias("won"), *(F.col(f"{e}_{s}").cast("double").alias(e) for e in engines))
    rows = pairs.dropna(subset=[key, context, "split", *(f"{e}_{s}" for e in engines for s in ("preferred", "other"))])
    rows = rows.select(key, context, "split", F.explode(F.array(side("preferred"), side("other"))).alias("side")).select(key, context, "split", "side.*")
    for e in engines:
        rows = midrank_percentile(rows, e, by=[context], out=f"{e}_rank")
    gap = F.array(*(F.sum(F.when(F.col("won"), F.col(f"{e}_rank")).otherwise(-F.col(f"{e}_rank"))) for e in engines))
    return rows.groupBy(key, context, "split").agg(gap.alias("gap"))


def fit_ensemble_weights(pairs: DataFrame, *, key: str, context: str, engines: list[str], rounds: int = 25, scale: float = 12.0) -> DataFrame:
    """One row: status, weights (0 or more, sum 1, in the order of ``engines``), numbers of pairs and contexts of both
    splits, held-out accuracy, that of the first engine alone, and the uplift.

    The weights have the least logistic loss of the calibration pairs' gaps, by steps on sums that all tasks add up: one
    row of slopes and bends comes back for each step. ``unfit``, without weights: fewer than 50 calibration or 20
    held-out pairs, fewer than two calibration contexts, or a context in both splits. ``validated``: an accuracy of 0.65
    and an uplift of 0.02; else ``failed``.
    """
    gaps = materialize(engine_gaps(pairs, key=key, context=context, engines=engines))
    k = len(engines)
    splits = gaps.groupBy(context).agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("calibration", "held_out")))
    counts = splits.agg(
        F.coalesce(F.sum("calibration"), F.lit(0)).alias("calibration_pairs"), F.coalesce(F.sum("held_out"), F.lit(0)).alias("held_out_pairs"),
        F.count_if(F.col("calibration") > 0).alias("calibration_contexts"), F.count_if(F.col("held_out") > 0).alias("held_out_contexts"), F.count_if((F.col("calibration") > 0) & (F.col("held_out") > 0)).alias("shared"),
    ).first()
    fit = counts["calibration_pairs"] >= 50 and counts["held_out_pairs"] >= 20 and counts["calibration_contexts"] >= 2 and not counts["shared"]
    train, held = gaps.where("split = 'calibration'"), gaps.where("split = 'held_out'")

    def score(w: np.ndarray) -> Column:
        return sum((F.lit(float(x)) * F.col("gap")[i] for i, x in enumerate(w)), F.lit(0.0))

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        g = [F.col("gap")[i] / scale for i in range(k)]
        margin = score(w) / scale
        p = 1 / (1 + F.exp(-margin))
        loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        row = train.agg(F.avg(loss), *(F.avg((p - 1) * x) for x in g), *(F.avg(p * (1 - p) * x * y) for x in g for y in g)).first()
        return row[0], np.array(row[1 : k + 1]), np.array(row[k + 1 :]).reshape(k, k)

    weights = accuracy = alone = None
    if fit:
        w, share = np.full(k, 1 / k), 1.0
        loss, slope, bend = sums(w)
        for _ in range(rounds):
            there = w + share * (_downhill(w, slope, bend) - w)
            new = sums(there)
            if new[0] > loss:
                share /= 4
                continue
            moved, share = float(np.abs(there - w).max()), 1.0
            w, (loss, slope, bend) = there, new
            if moved < 1e-8:
                break
        weights = [round(float(x), 6) for x in w]
        first = np.eye(k)[0]
        accuracy, alone = held.agg(*(F.avg((score(x) > 0).cast("double")) for x in (w, first))).first()
    uplift = round(accuracy - alone, 6) if fit else None
    status = "unfit" if not fit else "validated" if accuracy >= 0.65 and uplift >= 0.02 else "failed"
    numbers = ["calibration_pairs", "held_out_pairs", "calibration_contexts", "held_out_contexts"]
    row = (status, weights, *(counts[n] for n in numbers), round(accuracy, 6) if fit else None, round(alone, 6) if fit else None, uplift)
    return pairs.sparkSession.createDataFrame([row], f"status string, weights array<double>, {', '.join(n + ' long' for n in numbers)}, accuracy double, first_engine_accuracy double, uplift double")


def project_corpus(retained: DataFrame, snapshots: DataFrame, *, context: str, key: str, frozen: list[str]) -> tuple[DataFrame, DataFrame]:
    """(corpus, audit) of new snapshots (context, key, frozen columns as strings) over the rows retained so far.

    The snapshots of a context replace what it had, unless a row that it had is there with other frozen columns: then the
    whole context is refused and its retained rows stay. ``audit``: context, input_hash (of the snapshots in any order),
    n_rows, n_changed, status ``completed`` or ``failed``. Contexts without snapshots keep their rows. Repeated rows count
    once, rows without context or key not at all; the same input gives the same corpus again.
    """
    columns = [context, key, *frozen]
    old, new = (materialize(x.select(*columns).dropna(subset=[context, key]).distinct()) for x in (retained, snapshots))
    same = F.lit(True)
    for c in frozen:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    before = old.select(context, key, *(F.col(c).alias(f"old_{c}") for c in frozen))
    changed = new.join(before, [context, key]).where(~same).groupBy(context).agg(F.count("*").alias("n_changed"))
    text = F.concat_ws("\x1f", F.col(key).cast("string"), *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in frozen))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    sizes = new.groupBy(context).agg(F.count("*").alias("n_rows"), F.sum(number).alias("total"))
    audit = sizes.join(changed, context, "left").select(
        context, F.sha2(F.concat_ws("|", "n_rows", F.col("total").cast("string")), 256).alias("input_hash"), "n_rows",
        F.coalesce("n_changed", F.lit(0).cast("long")).alias("n_changed"), F.when(F.col("n_changed") > 0, "failed").otherwise("completed").alias("status"),
    )
    audit = materialize(audit)
    done = audit.where("status = 'completed'").select(context)
    return new.join(done, context, "left_semi").unionByName(old.join(done, context, "left_anti")), audit


def fit_platt(df: DataFrame, *, probability: str, correct: str, rounds: int = 1000, rate: float = 0.5) -> DataFrame:
    """(intercept, slope, n) of a logistic calibration. Rows are first summed by probability, at most 1001 values."""
    counts = df.where(F.col(probability).between(0, 1)).groupBy(F.round(probability, 3).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("double")).alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.clip(pdf["p"].to_numpy(), 0.001, 0.999)
        x, n, y = np.log(p / (1 - p)), pdf["n"].to_numpy(), pdf["y"].to_numpy()
        a, b = 0.0, 1.0
        for _ in range(rounds):
            off = n / (1 + np.exp(-np.clip(a + b * x, -20, 20))) - y
            a, b = a - rate * off.sum() / n.sum(), float(np.clip(b - rate * (off * x).sum() / n.sum(), 0.05, 8))
        return pd.DataFrame({"intercept": [round(a, 6)], "slope": [round(b, 6)], "n": [int(n.sum())]})

    return counts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: fit(pdf.sort_values("p")), "intercept double, slope double, n long")


def context_conflicts(df: DataFrame, *, context: str, split: str, number: str) -> DataFrame:
    """Contexts that carry more than one split, with the number their next round would get."""
    g = df.groupBy(context).agg(F.count_distinct(split).alias("splits"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("bigint").alias("next_round"))
    return g.where("splits <> 1")


def compatible_models(models: DataFrame, features: DataFrame, *, by: str, version: str) -> DataFrame:
    """The models (by, feature_schema, status, model_version) that may be applied: not paused, of this version or none,
    and trained on the one schema that all present features of their profile have."""
    seen = features.where("feature_schema is not null").groupBy(by).agg(F.min("feature_schema").alias("low"), F.max("feature_schema").alias("high"))
    fit = (F.col("low") == F.col("high")) & (F.col("low") == F.col("feature_schema"))
    usable = ~F.col("status").eqNullSafe("paused") & F.coalesce(F.col("model_version") == version, F.lit(True))
    return models.join(seen, by).where(fit & usable).drop("low", "high")


def sync_training_examples(pairs: DataFrame, vectors: DataFrame, *, exclusions: DataFrame, existing: DataFrame, key: str, vector: str) -> DataFrame:
    """New training rows (pair_id, preferred, rejected, and both vectors): training-split pairs that are neither excluded,
    in either order, nor there already, and whose items both have a vector."""
    ends = lambda a, b: (F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    fresh = pairs.where("split = 'training'").select("pair_id", "preferred", "rejected", *ends("preferred", "rejected"))
    fresh = fresh.join(exclusions.select(*ends("preferred", "rejected")).distinct(), ["x", "y"], "left_anti").join(existing.select("pair_id").distinct(), "pair_id", "left_anti")
    for side in ("preferred", "rejected"):
        fresh = fresh.join(vectors.select(F.col(key).alias(side), F.col(vector).alias(f"{side}_vector")), side)
    return fresh.select("pair_id", "preferred", "rejected", "preferred_vector", "rejected_vector")
