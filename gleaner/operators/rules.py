"""Decision tables over joined context: scores, penalties, flags, dispositions, reasons and overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X


@dataclass(frozen=True)
class ScoreWeights:
    generic: float = 0.50
    series: float = 0.08
    content: float = 0.18
    composition: float = 0.14
    moment: float = 0.10
    portrait: float = 0.08


def technical_penalty(blur: Column, clipped: Column, contrast: Column, most: float = 65) -> Column:
    """Points for blur, clipped exposure and low contrast; unknown evidence costs nothing."""
    hit = lambda c, points: F.when(F.coalesce(c, F.lit(False)), F.lit(float(points))).otherwise(F.lit(0.0))
    return F.least(hit(blur, 12) + hit(clipped, 14) + hit(contrast, 8), F.lit(float(most)))


def composite_score(parts: dict[str, Column], *, penalty: Column, utility: Column, delta: Column, weights: ScoreWeights = ScoreWeights()) -> Column:
    """Weighted mean of the available parts, less penalties, plus a bounded personal delta, within 0..100."""
    base = X.weighted_mean([(parts[k], getattr(weights, k)) for k in parts], 50.0)
    return X.clamp(base - penalty - F.when(utility, F.lit(8.0)).otherwise(F.lit(0.0)) + X.clamp(F.coalesce(delta, F.lit(0.0)), -20.0, 20.0), 0.0, 100.0)


def ensemble_generic(engines: dict[str, Column], weights: dict[str, float] | None, fallback: list[Column]) -> Column:
    """Weighted engines where weights are validated, else the first engine, then fallbacks, then neutral 50."""
    own = X.weighted_mean([(c, weights[k]) for k, c in engines.items()], None) if weights else next(iter(engines.values()))
    return F.coalesce(own, *fallback, F.lit(50.0))


def evidence_confidence(parts: list[tuple[Column, float]], engines: Column, disagreement: Column) -> Column:
    """Coverage .30 plus increments, at most .90; one engine caps it, disagreement lowers it; within .20 .. .90."""
    cover = F.least(sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.30)), F.lit(0.90))
    value = F.when(engines <= 1, F.least(F.lit(0.70), 0.8 * cover)).otherwise(cover * (1 - 0.65 * F.coalesce(disagreement, F.lit(0.0))))
    return X.clamp(value, 0.20, 0.90)


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


#: Limits of the twelve flags.
LOW_SHARPNESS, LOW_CONTRAST_RANK, LOW_OVERALL = 0.10, 0.08, 0.05
BLUR_VARIANCE, BLUR_ENERGY, MOTION_COHERENCE = 0.0004, 0.00025, 0.45
CLIPPED, DARK_P95, BRIGHT_P05 = 0.35, 0.35, 0.65
FLAT_SPREAD, FLAT_RANGE = 0.06, 0.25
POOR_FACE, TILT_DEGREES, TILT_SUPPORT, CUT_BOUNDARY = 0.20, 12.0, 0.25, 0.6
DEFECTS = ["possible_blur", "motion_blur", "defocus_blur", "underexposed", "overexposed", "low_contrast"]


def metric_flags(m: dict[str, Column]) -> Column:
    """The flags that an item's figures raise, in fixed order. A subject's figures stand before the whole image's: for
    sharpness each by itself, for exposure only where both are known. Unknown figures raise nothing.

    ``m``: sharpness_rank, contrast_rank, overall_rank, laplacian, gradient, black, white, p05, p95, spread, range,
    subject_laplacian, subject_gradient, subject_coherence, subject_black, subject_white, subject_p05, subject_p95, faces,
    face_quality, tilt, tilt_support, boundary, boundary_source.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    blur = known((F.coalesce(m["subject_laplacian"], m["laplacian"]) < BLUR_VARIANCE) & (F.coalesce(m["subject_gradient"], m["gradient"]) < BLUR_ENERGY))
    motion = blur & known(m["subject_coherence"] >= MOTION_COHERENCE)

    def exposure(share: str, level: str) -> tuple[Column, Column]:
        own = m[f"subject_{share}"].isNotNull() & m[f"subject_{level}"].isNotNull()
        return F.when(own, m[f"subject_{share}"]).otherwise(m[share]), F.when(own, m[f"subject_{level}"]).otherwise(m[level])

    (black, p95), (white, p05) = exposure("black", "p95"), exposure("white", "p05")
    return flags([
        ("relative_low_sharpness", m["sharpness_rank"] <= LOW_SHARPNESS), ("possible_blur", blur), ("motion_blur", motion), ("defocus_blur", blur & ~motion & m["subject_laplacian"].isNotNull()),
        ("underexposed", (black >= CLIPPED) & (p95 <= DARK_P95)), ("overexposed", (white >= CLIPPED) & (p05 >= BRIGHT_P05)), ("relative_low_contrast", m["contrast_rank"] <= LOW_CONTRAST_RANK),
        ("low_contrast", (m["spread"] < FLAT_SPREAD) & (m["range"] < FLAT_RANGE)), ("low_overall", m["overall_rank"] <= LOW_OVERALL), ("poor_face_capture", (F.coalesce(m["faces"], F.lit(0)) > 0) & (m["face_quality"] <= POOR_FACE)),
        ("extreme_horizon", (F.abs(m["tilt"]) >= TILT_DEGREES) & (m["tilt_support"] >= TILT_SUPPORT)), ("blocked_subject", (m["boundary_source"] == "faces") & (m["boundary"] >= CUT_BOUNDARY)),
    ])


def fallback_score(m: dict[str, Column], raised: Column, *, member: Column, leader: Column, exact: Column, margin: Column) -> Column:
    """(score, quality, sharpness, contrast, exposure, overall, bonus, penalty, series_rank): a score from an item's
    own figures, where no engine's is to be had; whole numbers, rounded to even.

    ``m``: quality, sharpness_rank, contrast_rank, overall_rank, mean, favorite, edited, face_quality. Unknown quality counts
    as 50, other unknown ranks as the quality.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    whole = lambda c: F.bround(c, 0)
    hit = lambda c, points: F.when(known(c), F.lit(float(points))).otherwise(F.lit(0.0))
    holds = lambda *names: F.arrays_overlap(raised, F.array(*map(F.lit, names)))
    quality = F.coalesce(whole(m["quality"] * 100), F.lit(50.0))
    sharpness, contrast, overall = (F.coalesce(whole(m[c] * 100), quality) for c in ("sharpness_rank", "contrast_rank", "overall_rank"))
    exposure = F.coalesce(F.greatest(F.lit(0.0), whole(100 - F.abs(m["mean"] - 0.5) * 180)), F.lit(100.0))
    loser, led = known(member) & ~known(leader), known(member) & known(leader)
    penalty = hit(holds("possible_blur"), 18) + hit(holds("underexposed", "overexposed"), 18) + hit(holds("low_contrast"), 12) + hit(loser & known(exact), 55) + hit(loser & ~known(exact), 28)
    bonus = hit(m["favorite"], 10) + hit(m["edited"], 6) + hit(led, 8) + F.coalesce(whole(m["face_quality"] * 8), F.lit(0.0))
    rank = F.when(led, F.lit(100.0)).when(loser, F.greatest(F.lit(0.0), whole(75 - F.greatest(F.lit(0.0), F.coalesce(margin, F.lit(0.0))) * 100))).otherwise(F.lit(0.0))
    score = whole(quality * 0.35 + sharpness * 0.25 + contrast * 0.12 + exposure * 0.18 + overall * 0.10 + bonus - penalty)
    parts = {"quality": quality, "sharpness": sharpness, "contrast": contrast, "exposure": exposure, "overall": overall, "bonus": bonus, "penalty": penalty, "series_rank": rank}
    return F.struct(X.clamp(score, 0.0, 100.0).alias("score"), *(c.alias(name) for name, c in parts.items()))


def decision_reasons(*, disposition: Column, leading: Column, raised: Column, member: Column, leader: Column, told: Column, parts: dict[str, Column], delta: Column, scored: Column, most: int = 3) -> Column:
    """Up to three different codes for a decision: the leading one, then those of its side.

    Kept for review: the defects. Kept otherwise: best in series, then the score's good reasons (``told``), else that it is
    above the cutoff. Rejected: flags, weaker copy, weak parts of the score (``scored`` tells whether there is one),
    mismatch, penalty, and at last that it is below the cutoff.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda names: F.filter(F.array(*map(F.lit, names)), lambda x: F.array_contains(raised, x))
    code = lambda c, name: F.when(known(c), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    first = F.when(leading.isNotNull(), F.array(leading)).otherwise(F.array().cast("array<string>"))
    good = F.filter(told, lambda x: x.isin("strong_aesthetics", "strong_composition", "interesting_subject", "strong_moment", "personal_taste_match", "adds_variety"))
    kept = F.concat(first, code(known(member) & known(leader), "best_in_series"), F.when(known(scored), good).otherwise(F.array().cast("array<string>")))
    review = F.concat(first, listed([*DEFECTS, "poor_face_capture"]))
    weak = [("generic", "weak_aesthetics"), ("composition", "weak_composition"), ("content", "weak_subject"), ("moment", "weak_moment")]
    # A part that is unknown or 0 counts as 50.
    low = [code(scored & (F.when(parts[p] != 0, parts[p]) < 50), name) for p, name in weak]
    own = [code(scored & (delta <= -2), "personal_taste_mismatch"), code(scored & (F.size(listed(DEFECTS)) > 0), "technical_penalty"), F.array(F.lit("below_album_cutoff"))]
    gone = F.concat(first, listed(["possible_blur", "underexposed", "overexposed", "low_contrast", "low_overall", "poor_face_capture", "extreme_horizon", "bad_angle", "blocked_subject"]), code(known(member) & ~known(leader), "weaker_duplicate"), *low, *own)
    short = lambda c: F.slice(F.array_distinct(c), 1, most)
    keep = F.when(known(leading == "defect_review_required"), short(review)).otherwise(F.when(F.size(kept) > 0, short(kept)).otherwise(F.array(F.lit("above_album_cutoff"))))
    return F.when(disposition == "keep", keep).otherwise(short(gone))


def score_reasons(*, delta: Column, led: Column, parts: dict[str, Column], utility: Column, penalty: Column, most: int = 3) -> Column:
    """Up to three codes: the personal taste from 2 points on, the leader of a series, then the ``parts`` (code to value) of 60
    or more from the greatest on (ties in their order), utility, penalty; the neutral baseline where there is none."""
    code = lambda c, name: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    own = F.array(*(F.struct((-v).alias("v"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, v) in enumerate(parts.items())))
    strong = F.transform(F.array_sort(F.filter(own, lambda x: x["v"] <= -60)), lambda x: x["name"])
    found = F.slice(F.concat(code(delta >= 2, "personal_taste_match"), code(led, "best_in_series"), strong, code(utility, "utility_image"), code(penalty > 0, "technical_penalty")), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("neutral_baseline")))


def automatic_culling(*, raised: Column, disposition: Column, member: Column, leader: Column, recommended: Column, confidence: Column) -> Column:
    """(category, reason) of the two review buckets; the first rule that holds. Only absolute defects that bear each other
    out suggest a removal, no rank and no taste."""
    row = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("reason"))
    known = lambda c: F.coalesce(c, F.lit(False))
    holds = lambda *names: known(F.arrays_overlap(raised, F.array(*map(F.lit, names))))
    guarded = holds("duplicate_leader", "favorite_protected", "edited_protected", "missing_preview", "analysis_error", "ambiguous_duplicate", "resolution_inversion")
    redundant = known(member) & ~known(leader) & ~known(recommended) & known(confidence >= 0.92)
    return (
        F.when(guarded, row("keep", "protected_or_uncertain")).when(known(member) & known(leader), row("keep", "series_representative"))
        .when(known(disposition == "reject"), row("reject", "confirmed_duplicate_or_defect")).when(redundant, row("reject", "redundant_frame"))
        .when(holds("motion_blur", "defocus_blur") & holds("possible_blur"), row("reject", "visible_blur_candidate"))
        .when(holds("underexposed", "overexposed") & holds("low_contrast"), row("reject", "exposure_detail_loss")).otherwise(row("keep", "no_clear_removal_reason"))
    )


def reasons(ladder: list[tuple[str, Column]], most: int = 3, default: str | None = None) -> Column:
    """The first few different codes of a ladder; the default where none holds."""
    found = F.slice(F.array_distinct(flags(ladder)), 1, most)
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def bad_near_duplicate(kind: Column, confidence: Column, seconds: Column, margin: Column, defect: Column, mae: Column, phash: Column, dhash: Column, hist: Column) -> Column:
    close = F.coalesce(mae <= 0.12, F.lit(False)) | ((phash <= 4) & (dhash <= 8) & (hist >= 0.90))
    return F.coalesce(kind.isin("near", "burst", "scene") & (confidence >= 0.92) & (seconds <= 15) & (margin >= 0.12) & defect & close, F.lit(False))


def threshold_confidence(score: Column, threshold: Column, signal: Column) -> Column:
    return F.least(F.lit(0.95), 0.75 * (0.52 + F.least(F.lit(0.38), F.abs(score - threshold) / 35)) + 0.25 * signal)


def decide(
    *, available: Column, protected: Column, loser: Column, leader: Column, exact: Column, confirmed: Column, confidence: Column, score: Column, threshold: Column,
    signal: Column, model_reject: Column | None = None, model_confidence: Column | None = None, validated: bool = False,
) -> Column:
    """First match wins: (disposition, confidence, rule).

    Exact copies go. Near copies with a confirmed defect, and what a model rejects with .90 or more, go only once such
    rejects are ``validated``; before that, the former are kept for review. A low score alone rejects nothing.
    """
    row = lambda d, c, r: F.struct(F.lit(d).alias("disposition"), c.cast("double").alias("confidence"), F.lit(r).alias("rule"))
    known = lambda c: F.coalesce(c, F.lit(False))
    sure, held = F.coalesce(confidence, F.lit(0.0)), X.clamp(F.coalesce(confidence, F.lit(0.0)), 0.55, 0.9)
    defect = known(confirmed) & F.lit(validated)
    out = F.when(~known(available), row("keep", F.lit(0.5), "unavailable")).when(known(protected), row("keep", F.lit(0.9), "protected"))
    out = out.when(known(loser) & (known(exact) | defect), row("reject", sure, "weaker copy"))
    out = out.when(known(loser) & known(confirmed), row("keep", held, "copy for review")).when(known(loser), row("keep", held, "copy"))
    out = out.when(known(leader), row("keep", F.lit(0.9), "leader"))
    if validated and model_reject is not None:
        out = out.when(known(model_reject & (model_confidence >= 0.9)), row("reject", model_confidence, "model defect"))
    kept = threshold_confidence(score, threshold, signal)
    return out.when(score < threshold, row("keep", kept, "no defect")).otherwise(row("keep", kept, "threshold"))


def apply_diversity(components: Column, reasons: Column, versions: Column, *, value: Column, demoted: Column, method: Column, version: Column) -> Column:
    """(components, reasons, versions) with the evidence of diversity: its value always, a reason if the item was demoted
    or is an anchor or distant item of 65 or more, the model's version where there is one."""
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda name, _: name != k), F.create_map(F.lit(k), v))
    varied = F.coalesce(method.isin("semantic_anchor", "semantic_distance") & (value >= 65), F.lit(False))
    told = F.when(F.coalesce(demoted, F.lit(False)), F.array_append(reasons, "too_similar")).when(varied, F.array_append(reasons, "adds_variety")).otherwise(reasons)
    return F.struct(
        put(components, "diversity_value", value).alias("components"), told.alias("reasons"),
        F.when(version.isNotNull(), put(versions, "diversity", version)).otherwise(versions).alias("versions"),
    )


def series_role(*, protected: Column, best: Column, selected: Column) -> Column:
    known = lambda c: F.coalesce(c, F.lit(False))
    return F.when(known(protected), "protected").when(known(best), "best_in_stack").when(known(selected), "alternative").otherwise("redundant_but_good")


def low_appeal(score: Column, confidence: Column, families: list[Column]) -> Column:
    votes = sum((F.coalesce(c, F.lit(False)).cast("int") for c in families), F.lit(0))
    return F.coalesce((score <= 25) & (confidence >= 0.82) & (votes >= 2), F.lit(False))


def selection_state(disposition: Column, score: Column, threshold: Column, confidence: Column, alternative: Column) -> Column:
    return F.when(disposition == "reject", "reject").when(confidence < 0.4, "review").when(alternative, "alternative").when(score >= threshold, "pick").otherwise("review")


def culling_state(protected: Column, rejected: Column, redundant: Column, confidence: Column) -> Column:
    row = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("reason"))
    return F.when(protected, row("keep", "protected")).when(rejected, row("reject", "defect")).when(redundant & (confidence >= 0.92), row("reject", "redundant")).otherwise(row("keep", "default"))


def effective_category(manual_disposition: Column, manual_selection: Column, automatic: Column) -> Column:
    """Manual disposition over manual selection over automatic; anything but reject is keep."""
    picked = F.when(manual_selection == "pick", F.lit("keep")).otherwise(manual_selection)
    return F.when(F.coalesce(manual_disposition, picked, automatic, F.lit("keep")) == "reject", "reject").otherwise("keep")


def apply_overrides(decisions: DataFrame, overrides: DataFrame, *, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """``final_<field>`` is the newest override's value where it has one, else the automatic value."""
    newest = overrides.groupBy(key).agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f"manual_{f}") for f in fields])
    joined = decisions.join(newest, key, "left")
    return joined.withColumns({f"final_{f}": F.coalesce(f"manual_{f}", f) for f in fields})


def mark_flag(df: DataFrame, ids: DataFrame, *, key: str, flag: str, column: str = "flags") -> DataFrame:
    """Set one flag for the ids and clear it for all others."""
    hit = ids.select(key).distinct().withColumn("hit", F.lit(True))
    bare = F.array_remove(F.col(column), flag)
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("hit"), F.array_sort(F.array_union(bare, F.array(F.lit(flag))))).otherwise(F.array_sort(bare))).drop("hit")
