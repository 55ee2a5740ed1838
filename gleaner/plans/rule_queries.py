"""Queries over rules, evaluation, checks, set operations and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import evaluation as E
from gleaner.operators import rules as R
from gleaner.plans.ordered_queries import r6
from gleaner.plans.registry import query
from gleaner.sources.tables import read

LINE = ["l_orderkey", "l_linenumber"]
C = F.col

_PARTS = "l_quantity * 2 as g, case when l_discount > 0.03 then l_discount * 1000 end as s, l_tax * 1000 as c"
_SCORE = "least(greatest((g * 0.50 + coalesce(s * 0.08, 0) + c * 0.18) / (0.50::double + case when s is not null then 0.08::double else 0 end + 0.18::double) - pen - case when l_linestatus = 'F' then 8 else 0 end + least(greatest(l_discount * 100 - 5, -20), 20), 0.0), 100.0)"
_PEN = "least((case when l_quantity < 5 then 12 else 0 end) + (case when l_tax > 0.07 then 14 else 0 end) + (case when l_discount < 0.01 then 8 else 0 end), 65) as pen"
_SCORED = f"with x as (select *, {_PARTS}, {_PEN} from lineitem), y as (select *, {_SCORE} as score from x)"


def scored(spark, d):
    rows = read(spark, d, "lineitem")
    parts = {"generic": C("l_quantity") * 2, "series": F.when(C("l_discount") > 0.03, C("l_discount") * 1000), "content": C("l_tax") * 1000}
    pen = R.technical_penalty(C("l_quantity") < 5, C("l_tax") > 0.07, C("l_discount") < 0.01)
    return rows.withColumn("pen", pen).withColumn("score", R.composite_score(parts, penalty=C("pen"), utility=C("l_linestatus") == "F", delta=C("l_discount") * 100 - 5))


@query("r1_composite_score", f"{_SCORED} select l_orderkey, l_linenumber, round(score, 6) as score from y")
def r1(spark, d):
    return scored(spark, d).select(*LINE, r6(C("score"), "score"))


@query("r2_ensemble_generic", """select l_orderkey, l_linenumber, round(coalesce(case when l_quantity > 25 or l_discount > 0.05 then (coalesce(case when l_quantity > 25 then l_quantity end * 0.7, 0) + coalesce(case when l_discount > 0.05 then l_discount * 1000 end * 0.3, 0)) / (case when l_quantity > 25 then 0.7::double else 0 end + case when l_discount > 0.05 then 0.3::double else 0 end) end, case when l_tax > 0 then l_tax * 100 end, 50.0), 6) as score from lineitem""")
def r2(spark, d):
    engines = {"a": F.when(C("l_quantity") > 25, C("l_quantity")), "b": F.when(C("l_discount") > 0.05, C("l_discount") * 1000)}
    return read(spark, d, "lineitem").select(*LINE, r6(R.ensemble_generic(engines, {"a": 0.7, "b": 0.3}, [F.when(C("l_tax") > 0, C("l_tax") * 100)]), "score"))


@query("r3_evidence_confidence", """
with x as (select *, least(0.30 + (case when l_quantity > 10 then 0.3 else 0 end) + (case when l_discount > 0.02 then 0.35 else 0 end), 0.90)::double as cover from lineitem)
select l_orderkey, l_linenumber, round(least(greatest(case when l_linenumber <= 1 then least(0.70, 0.8 * cover) else cover * (1 - 0.65 * l_tax) end, 0.20), 0.90), 6) as confidence from x""")
def r3(spark, d):
    c = R.evidence_confidence([(C("l_quantity") > 10, 0.3), (C("l_discount") > 0.02, 0.35)], C("l_linenumber"), C("l_tax"))
    return read(spark, d, "lineitem").select(*LINE, r6(c, "confidence"))


@query("r4_technical_penalty", f"select l_orderkey, l_linenumber, cast(pen as double) as penalty from (select *, {_PEN} from lineitem)")
def r4(spark, d):
    return scored(spark, d).select(*LINE, C("pen").alias("penalty"))


_LADDER = [("delta", "l_discount > 0.08"), ("leader", "l_linenumber = 1"), ("content", "l_tax > 0.05"), ("quality", "l_quantity > 40")]


def _ladder_sql(rules, most):
    return f"array_to_string(list_filter([{', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in rules)}], lambda x: x is not null)[1:{most}], ',')"


@query("r5_r10_reasons", f"select l_orderkey, l_linenumber, coalesce(nullif({_ladder_sql(_LADDER, 3)}, ''), 'neutral') as reasons from lineitem")
def r5(spark, d):
    return read(spark, d, "lineitem").select(*LINE, F.array_join(R.reasons([(n, F.expr(c)) for n, c in _LADDER], 3, "neutral"), ",").alias("reasons"))


_FLAGS = [("blur", "l_quantity < 3"), ("clipped", "l_tax >= 0.07"), ("flat", "l_discount < 0.01"), ("small", "l_extendedprice < 5000")]


@query("r6_metric_flags", f"select l_orderkey, l_linenumber, {_ladder_sql(_FLAGS, 9)} as flags from lineitem")
def r6q(spark, d):
    return read(spark, d, "lineitem").select(*LINE, F.array_join(R.flags([(n, F.expr(c)) for n, c in _FLAGS]), ",").alias("flags"))


#: Figures of an item, as expressions of an order line that both engines read; some are unknown.
_FIGURES = {
    "sharpness_rank": "l_discount * 10", "contrast_rank": "l_tax * 12", "overall_rank": "(l_quantity - 1) / 49.0", "laplacian": "l_quantity / 60000.0", "gradient": "l_tax / 200.0", "black": "l_tax * 7", "white": "l_tax * 6",
    "p05": "1 - l_discount * 5", "p95": "l_discount * 5", "spread": "l_discount", "range": "l_tax * 6", "subject_laplacian": "case when l_linenumber % 3 = 0 then l_quantity / 50000.0 end", "subject_gradient": "case when l_linenumber % 3 = 0 then l_tax / 160.0 end",
    "subject_coherence": "case when l_linenumber % 2 = 0 then l_discount * 8 end", "subject_black": "case when l_linenumber % 4 = 0 then l_tax * 8 end", "subject_white": "case when l_linenumber = 5 then l_tax * 9 end", "subject_p05": "case when l_linenumber >= 4 then 1 - l_discount * 6 end",
    "subject_p95": "case when l_linenumber >= 4 then l_discount * 6 end", "faces": "l_linenumber % 2", "face_quality": "case when l_linenumber < 6 then l_tax * 10 end", "tilt": "l_quantity - 25", "tilt_support": "l_discount * 5", "boundary": "l_discount * 10",
    "boundary_source": "case when l_linenumber > 3 then 'faces' else 'mask' end", "quality": "case when l_linenumber <> 2 then l_quantity / 50.0 end", "mean": "l_discount * 9", "favorite": "l_linenumber = 7", "edited": "l_linestatus = 'F'",
    "member": "l_returnflag <> 'N'", "leader": "l_linenumber = 1", "exact": "l_tax < 0.03", "margin": "l_discount * 3",
}
_BLUR = "(coalesce(subject_laplacian, laplacian) < 0.0004 and coalesce(subject_gradient, gradient) < 0.00025)"
_TWELVE = [
    ("relative_low_sharpness", "sharpness_rank <= 0.10"), ("possible_blur", _BLUR), ("motion_blur", f"{_BLUR} and subject_coherence >= 0.45"), ("defocus_blur", f"{_BLUR} and coalesce(subject_coherence < 0.45, true) and subject_laplacian is not null"),
    ("underexposed", "case when subject_black is not null and subject_p95 is not null then subject_black >= 0.35 and subject_p95 <= 0.35 else black >= 0.35 and p95 <= 0.35 end"),
    ("overexposed", "case when subject_white is not null and subject_p05 is not null then subject_white >= 0.35 and subject_p05 >= 0.65 else white >= 0.35 and p05 >= 0.65 end"),
    ("relative_low_contrast", "contrast_rank <= 0.08"), ("low_contrast", "spread < 0.06 and range < 0.25"), ("low_overall", "overall_rank <= 0.05"), ("poor_face_capture", "faces > 0 and face_quality <= 0.20"),
    ("extreme_horizon", "abs(tilt) >= 12 and tilt_support >= 0.25"), ("blocked_subject", "boundary_source = 'faces' and boundary >= 0.6"),
]
_ITEMS = f"with i as (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, {', '.join(f'{e} as {name}' for name, e in _FIGURES.items())} from lineitem), f as (select *, list_filter([{', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _TWELVE)}], lambda x: x is not null) as raised from i)"


def items(spark, d):
    """Order lines with figures and their flags."""
    rows = read(spark, d, "lineitem").select(*LINE, "l_quantity", "l_discount", "l_tax", *(F.expr(e).alias(name) for name, e in _FIGURES.items()))
    return rows.withColumn("raised", R.metric_flags({name: C(name) for name in _FIGURES}))


@query("r6_twelve_flags", f"{_ITEMS} select l_orderkey, l_linenumber, array_to_string(raised, ',') as flags from f")
def r6_all(spark, d):
    return items(spark, d).select(*LINE, F.array_join("raised", ",").alias("flags"))


_HAS = lambda *names: f"len(list_intersect(raised, [{', '.join(repr(n) for n in names)}])) > 0"


@query("r11_fallback_selection", f"""{_ITEMS}, p as (select *, coalesce(round_even(quality * 100, 0), 50) as q from f),
s as (select *, coalesce(round_even(sharpness_rank * 100, 0), q) as sharp, coalesce(round_even(contrast_rank * 100, 0), q) as contrast, coalesce(round_even(overall_rank * 100, 0), q) as overall, greatest(0, round_even(100 - abs(mean - 0.5) * 180, 0)) as exposure,
 case when {_HAS("possible_blur")} then 18 else 0 end + case when {_HAS("underexposed", "overexposed")} then 18 else 0 end + case when {_HAS("low_contrast")} then 12 else 0 end + case when member and not leader then case when exact then 55 else 28 end else 0 end as penalty,
 case when favorite then 10 else 0 end + case when edited then 6 else 0 end + case when member and leader then 8 else 0 end + coalesce(round_even(face_quality * 8, 0), 0) as bonus,
 case when member and leader then 100 when member then greatest(0, round_even(75 - margin * 100, 0)) else 0 end as series_rank from p)
select l_orderkey, l_linenumber, least(greatest(round_even(q * 0.35 + sharp * 0.25 + contrast * 0.12 + exposure * 0.18 + overall * 0.10 + bonus - penalty, 0), 0), 100)::double as score, exposure::double as exposure, bonus::double as bonus, penalty::double as penalty, series_rank::double as series_rank from s""")
def r11_full(spark, d):
    s = R.fallback_score({name: C(name) for name in _FIGURES}, C("raised"), member=C("member"), leader=C("leader"), exact=C("exact"), margin=C("margin"))
    return items(spark, d).withColumn("s", s).select(*LINE, *(C(f"s.{c}") for c in ("score", "exposure", "bonus", "penalty", "series_rank")))


@query("r14_automatic_culling", f"""{_ITEMS}, g as (select *, case when l_linenumber = 7 then list_append(raised, 'favorite_protected') else raised end as every from f)
select l_orderkey, l_linenumber, case when list_contains(every, 'favorite_protected') then 'keep:protected_or_uncertain' when member and leader then 'keep:series_representative' when l_quantity > 45 then 'reject:confirmed_duplicate_or_defect'
 when member and not leader and l_linenumber <> 3 and 1 - l_tax >= 0.92 then 'reject:redundant_frame' when {_HAS("motion_blur", "defocus_blur")} then 'reject:visible_blur_candidate'
 when {_HAS("underexposed", "overexposed")} and list_contains(raised, 'low_contrast') then 'reject:exposure_detail_loss' else 'keep:no_clear_removal_reason' end as state from g""")
def r14_full(spark, d):
    every = F.when(C("l_linenumber") == 7, F.array_append("raised", "favorite_protected")).otherwise(C("raised"))
    s = R.automatic_culling(raised=every, disposition=F.when(C("l_quantity") > 45, "reject").otherwise("keep"), member=C("member"), leader=C("leader"), recommended=C("l_linenumber") == 3, confidence=1 - C("l_tax"))
    return items(spark, d).select(*LINE, F.concat_ws(":", s["category"], s["reason"]).alias("state"))


_PARTS = {"generic": "l_quantity * 2", "composition": "l_discount * 1000", "content": "l_tax * 1250", "moment": "l_linenumber * 14"}
_STRONG = {"strong_aesthetics": "generic", "strong_composition": "composition", "interesting_subject": "content", "strong_moment": "moment"}
_IN = lambda names: ", ".join(f"case when list_contains(raised, '{n}') then '{n}' end" for n in names)
_TOLD = f"""{_ITEMS}, q as (select *, {', '.join(f'({e})::double as {name}' for name, e in _PARTS.items())}, l_quantity - 25 as delta from f),
t as (select *, list_filter(list_concat([case when delta >= 2 then 'personal_taste_match' end, case when member and leader then 'best_in_series' end], list_concat(list_transform(list_sort([{', '.join(f"{{'v': -{p}, 'k': {k}, 'n': '{name}'}}" for k, (name, p) in enumerate(_STRONG.items()))}]), lambda x: case when x.v <= -60 then x.n end),
 [case when l_linenumber = 6 then 'utility_image' end, case when {_HAS(*R.DEFECTS)} then 'technical_penalty' end])), lambda x: x is not null)[1:3] as found from q), u as (select *, case when len(found) > 0 then found else ['neutral_baseline'] end as told from t)"""


def told(spark, d):
    """The items with the parts of their score and its reasons."""
    rows = items(spark, d).withColumns({**{name: F.expr(e).cast("double") for name, e in _PARTS.items()}, "delta": C("l_quantity") - 25})
    defect = F.arrays_overlap("raised", F.array(*map(F.lit, R.DEFECTS)))
    return rows.withColumn("told", R.score_reasons(delta=C("delta"), led=C("member") & C("leader"), parts={name: C(p) for name, p in _STRONG.items()}, utility=C("l_linenumber") == 6, penalty=F.when(defect, 12).otherwise(0)))


@query("r5_score_reasons", f"{_TOLD} select l_orderkey, l_linenumber, array_to_string(told, ',') as reasons from u")
def r5_full(spark, d):
    return told(spark, d).select(*LINE, F.array_join("told", ",").alias("reasons"))


@query("r10_decision_reasons", f"""{_TOLD}, w as (select *, case when l_linenumber = 4 then 'defect_review_required' when l_linenumber = 5 then 'model_defect' end as first_code, l_linenumber <> 3 as scored, l_quantity > 12 as keep from u),
k as (select *, case when first_code = 'defect_review_required' then list_concat([first_code], [{_IN([*R.DEFECTS, 'poor_face_capture'])}])
 else list_concat([first_code, case when member and leader then 'best_in_series' end], case when scored then list_filter(told, lambda x: x in ('strong_aesthetics', 'strong_composition', 'interesting_subject', 'strong_moment', 'personal_taste_match', 'adds_variety')) else [] end) end as good,
 list_concat([first_code, {_IN(["possible_blur", "underexposed", "overexposed", "low_contrast", "low_overall", "poor_face_capture", "extreme_horizon", "bad_angle", "blocked_subject"])}], [case when member and not leader then 'weaker_duplicate' end,
 case when scored and nullif(generic, 0) < 50 then 'weak_aesthetics' end, case when scored and nullif(composition, 0) < 50 then 'weak_composition' end, case when scored and nullif(content, 0) < 50 then 'weak_subject' end, case when scored and nullif(moment, 0) < 50 then 'weak_moment' end,
 case when scored and delta <= -2 then 'personal_taste_mismatch' end, case when scored and {_HAS(*R.DEFECTS)} then 'technical_penalty' end, 'below_album_cutoff']) as bad from w),
c as (select *, list_filter(good, lambda x: x is not null) as g, list_filter(bad, lambda x: x is not null) as b from k)
select l_orderkey, l_linenumber, array_to_string(case when keep then case when len(g) > 0 then g[1:3] else ['above_album_cutoff'] end else b[1:3] end, ',') as reasons from c""")
def r10_full(spark, d):
    leading = F.when(C("l_linenumber") == 4, "defect_review_required").when(C("l_linenumber") == 5, "model_defect")
    own = R.decision_reasons(disposition=F.when(C("l_quantity") > 12, "keep").otherwise("reject"), leading=leading, raised=C("raised"), member=C("member"), leader=C("leader"), told=C("told"), parts={p: C(p) for p in _PARTS}, delta=C("delta"), scored=C("l_linenumber") != 3)
    return told(spark, d).select(*LINE, F.array_join(own, ",").alias("reasons"))


@query("r7_bad_near_duplicate", "select l_orderkey, l_linenumber, l_returnflag in ('N') and 1 - l_discount >= 0.92 and l_linenumber <= 15 and l_tax >= 0.03 and l_quantity < 25 and l_discount <= 0.12 as bad from lineitem")
def r7(spark, d):
    bad = R.bad_near_duplicate(F.when(C("l_returnflag") == "N", "near"), 1 - C("l_discount"), C("l_linenumber"), C("l_tax") * 4, C("l_quantity") < 25, C("l_discount"), F.lit(9), F.lit(9), F.lit(0.0))
    return read(spark, d, "lineitem").select(*LINE, bad.alias("bad"))


def _decide_sql(validated):
    gone, model = (" or l_tax > 0.05", "when l_quantity > 45 and 1 - l_tax >= 0.9 then 'model defect'") if validated else ("", "")
    return _SCORED + f""", z as (select *, case when l_quantity < 2 then 'unavailable' when l_linestatus = 'F' and l_tax = 0 then 'protected' when l_linenumber > 4 and (l_discount > 0.08{gone}) then 'weaker copy'
 when l_linenumber > 4 and l_tax > 0.05 then 'copy for review' when l_linenumber > 4 then 'copy' when l_linenumber = 1 then 'leader' {model} when score < 40 then 'no defect' else 'threshold' end as rule from y)"""


_DECIDE = _decide_sql(False)
_CONF = """case rule when 'unavailable' then 0.5 when 'protected' then 0.9 when 'weaker copy' then 1 - l_discount when 'copy for review' then least(0.9, greatest(0.55, 1 - l_discount)) when 'copy' then least(0.9, greatest(0.55, 1 - l_discount))
 when 'leader' then 0.9 when 'model defect' then 1 - l_tax else least(0.95, 0.75 * (0.52 + least(0.38, abs(score - 40) / 35)) + 0.25 * (1 - l_discount)) end"""
_DECISION = f"select l_orderkey, l_linenumber, case when rule in ('weaker copy', 'model defect') then 'reject' else 'keep' end as disposition, round({_CONF}, 6) as confidence, rule from z"


def decided(spark, d, validated=False):
    pick = R.decide(
        available=C("l_quantity") >= 2, protected=(C("l_linestatus") == "F") & (C("l_tax") == 0), loser=C("l_linenumber") > 4, leader=C("l_linenumber") == 1, exact=C("l_discount") > 0.08, confirmed=C("l_tax") > 0.05,
        confidence=1 - C("l_discount"), score=C("score"), threshold=F.lit(40.0), signal=1 - C("l_discount"), model_reject=C("l_quantity") > 45, model_confidence=1 - C("l_tax"), validated=validated,
    )
    return scored(spark, d).withColumn("decision", pick)


@query("r8_r9_decide", f"{_DECIDE} {_DECISION}")
def r8(spark, d):
    return decided(spark, d).select(*LINE, C("decision.disposition"), r6(C("decision.confidence"), "confidence"), C("decision.rule"))


@query("r8_decide_validated", f"{_decide_sql(True)} {_DECISION}")
def r8v(spark, d):
    return decided(spark, d, True).select(*LINE, C("decision.disposition"), r6(C("decision.confidence"), "confidence"), C("decision.rule"))


@query("r11_fallback_score", "select l_orderkey, l_linenumber, round((l_quantity * 0.4 + l_discount * 1000 * 0.35 + l_tax * 1000 * 0.25) / (0.4::double + 0.35::double + 0.25::double), 6) as score from lineitem")
def r11(spark, d):
    return read(spark, d, "lineitem").select(*LINE, r6(X.weighted_mean([(C("l_quantity"), 0.4), (C("l_discount") * 1000, 0.35), (C("l_tax") * 1000, 0.25)]), "score"))


@query("r12_low_appeal", f"{_SCORED} select l_orderkey, l_linenumber, score <= 25 and 1 - l_tax >= 0.82 and (l_quantity < 10)::int + (l_discount < 0.03)::int + (l_tax > 0.04)::int + (l_linenumber > 3)::int >= 2 as low from y")
def r12(spark, d):
    low = R.low_appeal(C("score"), 1 - C("l_tax"), [C("l_quantity") < 10, C("l_discount") < 0.03, C("l_tax") > 0.04, C("l_linenumber") > 3])
    return scored(spark, d).select(*LINE, low.alias("low"))


@query("r13_selection_state", f"{_DECIDE} select l_orderkey, l_linenumber, case when rule = 'weaker copy' then 'reject' when 1 - l_discount < 0.4 then 'review' when rule in ('copy', 'copy for review') then 'alternative' when score >= 40 then 'pick' else 'review' end as state from z")
def r13(spark, d):
    return decided(spark, d).select(*LINE, R.selection_state(C("decision.disposition"), C("score"), F.lit(40.0), 1 - C("l_discount"), C("decision.rule").startswith("copy")).alias("state"))


@query("r14_culling_state", "select l_orderkey, l_linenumber, case when l_linestatus = 'F' and l_tax = 0 then 'keep:protected' when l_discount > 0.08 then 'reject:defect' when l_linenumber > 4 and 1 - l_tax >= 0.92 then 'reject:redundant' else 'keep:default' end as state from lineitem")
def r14(spark, d):
    s = R.culling_state((C("l_linestatus") == "F") & (C("l_tax") == 0), C("l_discount") > 0.08, C("l_linenumber") > 4, 1 - C("l_tax"))
    return read(spark, d, "lineitem").select(*LINE, F.concat_ws(":", s["category"], s["reason"]).alias("state"))


@query("r16_series_quality", "select l_orderkey, l_linenumber, round(((l_quantity * 0.20 + l_discount * 1000 * 0.65 + l_tax * 1000 * 0.10) / (0.20::double + 0.65::double + 0.10::double) + least(greatest(l_linenumber - 4, -8), 8)) / 100, 6) as quality from lineitem")
def r16(spark, d):
    base = X.weighted_mean([(C("l_quantity"), 0.20), (C("l_discount") * 1000, 0.65), (C("l_tax") * 1000, 0.10)])
    return read(spark, d, "lineitem").select(*LINE, r6((base + X.clamp(C("l_linenumber") - 4, -8, 8)) / 100, "quality"))


@query("r18_manual_override", """
with o as (select o_custkey, arg_max(case when o_orderstatus <> 'P' then o_orderstatus end, (o_orderdate, o_orderkey)) as manual from orders where o_orderstatus <> 'P' group by 1)
select c_custkey, coalesce(manual, 'auto') as final from customer left join o on o_custkey = c_custkey""")
def r18(spark, d):
    auto = read(spark, d, "customer").select("c_custkey", F.lit("auto").alias("state"))
    manual = read(spark, d, "orders").select(C("o_custkey").alias("c_custkey"), F.when(C("o_orderstatus") != "P", C("o_orderstatus")).alias("state"), "o_orderdate", "o_orderkey")
    out = R.apply_overrides(auto, manual, key="c_custkey", order=["o_orderdate", "o_orderkey"], fields=["state"])
    return out.select("c_custkey", C("final_state").alias("final"))


@query("r19_mark_flag", "select o_orderkey, case when o_orderkey in (select l_orderkey from lineitem where l_discount > 0.09) then array_to_string(list_sort([o_orderstatus, 'discounted']), ',') else o_orderstatus end as flags from orders")
def r19(spark, d):
    rows = read(spark, d, "orders").withColumn("flags", F.array("o_orderstatus"))
    ids = read(spark, d, "lineitem").where("l_discount > 0.09").select(C("l_orderkey").alias("o_orderkey"))
    return R.mark_flag(rows, ids, key="o_orderkey", flag="discounted").select("o_orderkey", F.array_join("flags", ",").alias("flags"))


@query("p8_effective_category", "select o_orderkey, case when coalesce(case when o_orderkey % 10 = 0 then 'reject' end, case when o_orderkey % 7 = 0 then 'keep' end, case when o_orderstatus = 'F' then 'reject' else 'review' end) = 'reject' then 'reject' else 'keep' end as category from orders")
def p8(spark, d):
    c = R.effective_category(F.when(C("o_orderkey") % 10 == 0, "reject"), F.when(C("o_orderkey") % 7 == 0, "pick"), F.when(C("o_orderstatus") == "F", "reject").otherwise("review"))
    return read(spark, d, "orders").select("o_orderkey", c.alias("category"))


# Evaluation

_TRUTH = "with t as (select a.l_orderkey as src, b.l_orderkey as dst from (select distinct l_partkey, l_orderkey from lineitem where l_linenumber <= 2) a join (select distinct l_partkey, l_orderkey from lineitem where l_linenumber <= 2) b on a.l_partkey = b.l_partkey and a.l_orderkey < b.l_orderkey), p as (select a.l_orderkey as src, b.l_orderkey as dst from (select distinct l_partkey, l_orderkey from lineitem where l_linenumber <> 2) a join (select distinct l_partkey, l_orderkey from lineitem where l_linenumber <> 2) b on a.l_partkey = b.l_partkey and a.l_orderkey < b.l_orderkey)"


def _pairs(spark, d, where):
    from gleaner.operators.pairs import within_group_pairs

    return within_group_pairs(read(spark, d, "lineitem").where(where).select("l_partkey", "l_orderkey").distinct(), key="l_orderkey", by=["l_partkey"])


@query("e2_pair_precision_recall", f"{_TRUTH}, b as (select * from t intersect select * from p) select round((select count(*) from b) / (select count(*) from (select distinct * from p)), 6) as precision, round((select count(*) from b) / (select count(*) from (select distinct * from t)), 6) as recall")
def e2(spark, d):
    out = E.pair_precision_recall(_pairs(spark, d, "l_linenumber <= 2"), _pairs(spark, d, "l_linenumber <> 2"))
    return out.select(r6(C("precision"), "precision"), r6(C("recall"), "recall"))


@query("e3_leader_accuracy", """
with t as (select doc_id, lang as tg, max(doc_id) over (partition by lang) as tl from documents), p as (select doc_id, source as pg, max(doc_id) over (partition by source) as pl from documents),
o as (select tg, tl, pg, pl, count(*) as n from t join p using (doc_id) group by all having count(*) >= 2), b as (select *, rank() over (partition by tg order by n desc) as r from o), u as (select tg, any_value(tl) as tl, any_value(pl) as pl from b where r = 1 group by 1 having count(*) = 1)
select count(*) as groups, count(*) filter (where tl = pl) as "right" from (select distinct tg from t) left join u using (tg)""")
def e3(spark, d):
    docs = read(spark, d, "documents")
    side = lambda c: docs.select("doc_id", C(c).alias("grp"), F.expr(f"max(doc_id) over (partition by {c})").alias("leader"))
    return E.leader_accuracy(side("lang"), side("source"), key="doc_id")


@query("e4_false_exclusion_rate", "select round(avg(case when n_chars < 500 then 1.0 else 0.0 end), 6) as rate from labels join documents using (doc_id) where quality = 1")
def e4(spark, d):
    both = read(spark, d, "labels").where("quality = 1").join(read(spark, d, "documents"), "doc_id")
    return both.agg(r6(F.avg(F.when(C("n_chars") < 500, 1.0).otherwise(0.0)), "rate"))


@query("e5_preference_accuracy", """
with r as (select doc_id, quality, source, least(n_chars // 500, 4) as s from labels join documents using (doc_id))
select round(avg(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0.0 end), 6) as accuracy, count(*) as pairs from r a join r b on a.source = b.source and a.quality = 1 and b.quality = 0""")
def e5(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.least(F.floor(C("n_chars") / 500), F.lit(4)).alias("s"))
    rows = read(spark, d, "labels").join(docs, "doc_id")
    return E.preference_accuracy_within(rows, by=["source"], score="s", label="quality").select(r6(C("accuracy"), "accuracy"), "pairs")


@query("e6_top_k_overlap", "select count(*) / 50.0::double as overlap from (select doc_id from documents order by n_chars desc, doc_id limit 50) where doc_id in (select doc_id from labels where quality = 1)")
def e6(spark, d):
    return E.top_k_overlap(read(spark, d, "labels").where("quality = 1"), read(spark, d, "documents"), key="doc_id", score="n_chars", k=50)


_PROB = "with r as (select (doc_id % 101) / 100.0::double as p, quality = 1 as c from labels)"


@query("e7_calibration_bins", f"{_PROB} select cast(least(floor(p * 10), 9) as integer) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(c::int), 6) as share from r where p <= 1 group by 1")
def e7(spark, d):
    rows = read(spark, d, "labels").select(((C("doc_id") % 101) / 100.0).alias("p"), (C("quality") == 1).cast("int").alias("c"))
    return E.calibration_bins(rows, probability="p", correct="c").select("bin", "n", r6(C("mean_p"), "mean_p"), r6(C("share"), "share"))


@query("e7_brier_ece", f"{_PROB}, b as (select count(*) as n, avg(p) as m, avg(c::int) as s from r group by least(floor(p * 10), 9)) select round((select avg(pow(p - c::int, 2)) from r), 6) as brier, round((select sum(n * abs(m - s)) / sum(n) from b), 6) as ece")
def e7b(spark, d):
    rows = read(spark, d, "labels").select(((C("doc_id") % 101) / 100.0).alias("p"), (C("quality") == 1).cast("int").alias("c"))
    return E.brier_ece(rows, probability="p", correct="c").select(r6(C("brier"), "brier"), r6(C("ece"), "ece"))


@query("e8_selection_reduction", "select o_orderpriority, round(1 - avg((o_orderstatus = 'O')::int), 6) as reduction from orders group by 1")
def e8(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(r6(1 - F.avg((C("o_orderstatus") == "O").cast("int")), "reduction"))


@query("e12_frozen_universe", """with i as (select c_custkey::varchar as id, substr(md5(c_custkey::varchar), 1, 2) as b from customer), e as (select b, count(*) as n, sha256(string_agg(id, ',' order by id)) as g from i group by 1) select cast(sum(n) as bigint) as n, sha256(string_agg(g, ',' order by b)) as digest from e""")
def e12(spark, d):
    return E.frozen_universe(read(spark, d, "customer"), key="c_custkey")


# Checks

@query("v1_check_groups", "with g as (select l_orderkey, count(*) as n, count(*) filter (where l_linenumber = 1) as k from lineitem group by 1) select 'too small' as rule, l_orderkey::varchar as key from g where n < 2 union all select 'leaders', l_orderkey::varchar from g where k <> 1")
def v1(spark, d):
    return E.check_groups(read(spark, d, "lineitem"), group="l_orderkey", leader=C("l_linenumber") == 1)


_PREF = "with p as (select doc_id as l, doc_id % 97 as r, case when doc_id % 5 = 0 then -1 else doc_id end as w from labels)"


@query("v2_v7_check_preferences", f"""{_PREF}, n as (select *, least(l, r)::varchar || '|' || greatest(l, r)::varchar as k from p)
select 'self' as rule, k as key from n where l = r union all select 'foreign', k from n where w <> l and w <> r union all select 'repeated', k from n group by k having count(*) > 1
union all select 'unknown', i::varchar from (select distinct i from (select l as i from p union all select r from p)) where i not in (select doc_id from labels)""")
def v2(spark, d):
    labels = read(spark, d, "labels").select("doc_id")
    pairs = labels.select(C("doc_id").alias("left"), (C("doc_id") % 97).alias("right"), F.when(C("doc_id") % 5 == 0, F.lit(-1)).otherwise(C("doc_id")).cast("bigint").alias("preferred"))
    return E.check_preferences(pairs, labels, key="doc_id")


@query("v3_v8_check_scores", "select 'not requested' as rule, doc_id::varchar as key from documents where doc_id not in (select doc_id from labels) union all select 'duplicate', doc_id::varchar from (select doc_id from documents union all select doc_id from documents where doc_id % 9 = 0) group by doc_id having count(*) > 1")
def v3(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return E.check_output(read(spark, d, "labels").select("doc_id"), docs.union(docs.where("doc_id % 9 = 0")), key="doc_id")


@query("v4_check_labels", "select 'quality' as rule, doc_id::varchar as key from labels where quality not in (0, 1) union all select 'toxic good' as rule, doc_id::varchar from labels where toxic = 1 and quality = 1")
def v4(spark, d):
    return E.violations(read(spark, d, "labels"), [("quality", ~C("quality").isin(0, 1)), ("toxic good", (C("toxic") == 1) & (C("quality") == 1))], key="doc_id")


# Learning expressions

@query("l1_derive_preferences", """
with a as (select least(doc_id, doc_id + 1) as x, greatest(doc_id, doc_id + 1) as y, doc_id as w, 1 as pr from labels where quality = 1 and doc_id + 1 in (select doc_id from labels)
union all select least(doc_id, doc_id + 1), greatest(doc_id, doc_id + 1), doc_id + 1, 2 from labels where toxic = 0 and doc_id + 1 in (select doc_id from labels))
select x, y, w as preferred from (select *, row_number() over (partition by x, y order by pr) as rn from a) where rn = 1""")
def l1(spark, d):
    from gleaner.operators.learning import derive_preferences

    labels = read(spark, d, "labels")
    near = labels.join(labels.select((C("doc_id") - 1).alias("doc_id"), C("doc_id").alias("next")), "doc_id")
    explicit = near.where("quality = 1").select(C("doc_id").alias("preferred"), C("next").alias("other"))
    implied = near.where("toxic = 0").select(C("next").alias("preferred"), C("doc_id").alias("other"))
    return derive_preferences([explicit, implied])


@query("l2_assign_split", "select source, case when row_number() over (order by sha256(source)) % 4 = 0 then 'held_out' else 'calibration' end as split from (select distinct source from documents)")
def l2(spark, d):
    from gleaner.operators.learning import assign_split

    return assign_split(read(spark, d, "documents"), context="source", every=4)


_CONTEXT = "source || '/' || (doc_id % 5)"


@query("l2_balanced_split", f"""
with recursive m as (select {_CONTEXT} as context, count(*) as seen, case when min(doc_id) % 2 = 1 then 'held_out' else 'calibration' end as old from documents where doc_id % 7 = 0 group by 1),
r as (select {_CONTEXT} as context, count(*) as more from documents where doc_id % 7 <> 0 group by 1),
b as (select context, coalesce(seen, 0) + coalesce(more, 0) as examples, old from m full join r using (context)),
n as (select context, examples, row_number() over (order by sha256(context), context) as k from b where old is null),
s(k, c, h, had, split) as (select 0::bigint, (select count(*) from b where old = 'calibration'), (select count(*) from b where old = 'held_out'), (select coalesce(sum(examples), 0)::bigint from b where old = 'calibration'), 'calibration'
 union all select k, c + (split = 'calibration')::int, h + (split = 'held_out')::int, had + case when split = 'calibration' then examples else 0 end, split
 from (select n.k, c, h, had, examples, case when had < 3 or h >= c then 'calibration' else 'held_out' end as split from s join n on n.k = s.k + 1))
select context, examples, split from n join s using (k) union all select context, examples, old from b where old is not null""")
def l2_balanced(spark, d):
    """Contexts of a source and a fifth of the ids; a seventh of the documents is remembered."""
    from gleaner.operators.learning import balanced_split

    docs = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", (C("doc_id") % 5).cast("string")).alias("context"))
    memory = docs.where("doc_id % 7 = 0").groupBy("context").agg(F.count("*").alias("examples"), F.when(F.min("doc_id") % 2 == 1, "held_out").otherwise("calibration").alias("split"))
    return balanced_split(docs.where("doc_id % 7 <> 0"), memory, context="context")


@query("l3_filter_leakage", """
with p as (select doc_id as l, doc_id + 1 as r, case when doc_id % 3 = 0 then 'held_out' else 'calibration' end as split from labels where doc_id % 4 <> 1),
t as (select l as i from p where split = 'calibration' union select r from p where split = 'calibration') select l, r from p where split = 'held_out' and l not in (select i from t) and r not in (select i from t)""")
def l3(spark, d):
    from gleaner.operators.learning import filter_leakage

    pairs = read(spark, d, "labels").where("doc_id % 4 <> 1").select(C("doc_id").alias("l"), (C("doc_id") + 1).alias("r"), F.when(C("doc_id") % 3 == 0, "held_out").otherwise("calibration").alias("split"))
    return filter_leakage(pairs, left="l", right="r").select("l", "r")


@query("l4_l5_fit_ranker")
def l4(spark, d):
    from gleaner.operators.learning import fit_pairwise_ranker, pairwise_accuracy

    pairs = _vector_pairs(spark, d)
    return pairwise_accuracy(pairs, fit_pairwise_ranker(pairs, by="label"), by="label")


def _vector_pairs(spark, d):
    v = read(spark, d, "embeddings")
    both = v.withColumn("other", F.expr("lead(embedding) over (partition by label order by vec_id)")).where("other is not null")
    first = F.get("embedding", 0) > F.get("other", 0)
    return both.select("label", "vec_id", F.when(first, C("embedding")).otherwise(C("other")).alias("preferred"), F.when(first, C("other")).otherwise(C("embedding")).alias("rejected"))


@query("l7_apply_ranker", "select vec_id, round(tanh(2 * (embedding[1]::double * 0.6 - embedding[2]::double * 0.8) / sqrt(list_dot_product(embedding::double[], embedding::double[]))) * 20 * 0.5, 6) as delta from embeddings")
def l7(spark, d):
    from gleaner.operators.learning import apply_ranker

    w = F.concat(F.array(F.lit(0.6), F.lit(-0.8)), F.array_repeat(F.lit(0.0), 62))
    return read(spark, d, "embeddings").select("vec_id", r6(apply_ranker(C("embedding"), w, F.lit(0.5)), "delta"))


@query("l10_fit_platt")
def l10(spark, d):
    from gleaner.operators.learning import fit_platt

    rows = read(spark, d, "labels").select(F.round((C("doc_id") % 101) / 100.0, 3).alias("p"), C("quality").alias("y"))
    return fit_platt(rows, probability="p", correct="y")


@query("l14_lock_context", "select source, count(distinct lang) as splits, cast(coalesce(max(doc_id), 0) + 1 as bigint) as next_round from documents group by 1 having count(distinct lang) <> 1")
def l14(spark, d):
    from gleaner.operators.learning import context_conflicts

    return context_conflicts(read(spark, d, "documents"), context="source", split="lang", number="doc_id")
