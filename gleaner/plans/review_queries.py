"""Queries over evidence, truth, trust and checks of labelled collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import evaluation as E
from gleaner.operators import groups as G
from gleaner.operators import learning as L
from gleaner.operators import pairs as J
from gleaner.operators import rules as R
from gleaner.plans.ordered_queries import r6
from gleaner.plans.registry import ORACLES, query
from gleaner.plans.rule_queries import LINE
from gleaner.sources.inventory import model_versions
from gleaner.sources.tables import read

C = F.col
CELLS = 60


# Evidence of two vectors a and b of 64 cells


def _evidence(dt, burst):
    a, b = C("a"), C("b")
    median = lambda v: X.bits_to_bigint(X.median_bits(F.slice(v, 1, CELLS)))
    step = lambda v: X.bits_to_bigint(X.gradient_bits(v, 8, 8))
    return {
        "same_hash": a == b, "phash": X.hamming(median(a), median(b)), "dhash": X.hamming(step(a), step(b)), "aspect": F.lit(0.05), "hist": X.histogram_similarity(a, b),
        "mae": X.mean_abs_error(a, b), "xmae": X.exposure_invariant_error(a, b), "cos": X.cosine(a, b), "dt": dt, "burst": burst, "sim": X.cosine(a, b),
    }


def _evidence_sql(rows, keep):
    return f"""z as (select *, list_median(a[2:{CELLS}]) as ma, list_median(b[2:{CELLS}]) as mb, list_avg(a) as ea, list_avg(b) as eb, greatest(list_stddev_pop(a), 0.05) as sa, greatest(list_stddev_pop(b), 0.05) as sb,
 list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) as cos from {rows}),
ev as (select {keep}, a = b as same, cos, cos as hist, list_sum(list_transform(range(1, {CELLS + 1}), lambda i: ((a[i] > ma) <> (b[i] > mb))::int)) as ph,
 list_sum(list_transform(range(0, 56), lambda i: ((a[i // 7 * 8 + i % 7 + 2] > a[i // 7 * 8 + i % 7 + 1]) <> (b[i // 7 * 8 + i % 7 + 2] > b[i // 7 * 8 + i % 7 + 1]))::int)) as dh,
 list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) / 64 as mae,
 least(list_sum(list_transform(list_zip(a, b), lambda x: abs(least(greatest((x[1] - ea) / sa, -4), 4) - least(greatest((x[2] - eb) / sb, -4), 4)))) / 64 / 4, 1) as xmae from z)"""


_RULES = {
    "exact": "same", "strict": "(ph <= 4 and dh <= 12 and hist >= 0.72 and mae <= 0.18 and dt <= 120)", "relaxed": "(ph <= 10 and dt <= 120 and hist >= 0.84 and dh <= 18 and mae <= 0.22)",
    "burst": "(burst and dh <= 24 and hist >= 0.60)", "semantic": "(cos >= 0.985 and dt <= 15 and (xmae <= 0.20 or (hist >= 0.78 and dh <= 28)))",
}
_CONFIRM = f"({' or '.join(_RULES.values())})"
_BLEND = """with n as (select vec_id, [0.0, 0.1, 0.3, 0.6][vec_id % 4 + 1]::double as t, embedding::double[] as a, lead(embedding::double[]) over (partition by label order by vec_id) as c from embeddings),
p as (select vec_id, a, list_transform(list_zip(a, c), lambda x: (1 - t) * x[1] + t * x[2]) as b, vec_id % 40 as dt, vec_id % 9 = 0 as burst from n where c is not null)"""


def blended(spark, d):
    """Each vector beside itself, mixed with the next of its label."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    rows = read(spark, d, "embeddings").withColumn("next", F.expr("lead(embedding) over (partition by label order by vec_id)")).where("next is not null")
    t = F.get(F.array(*map(F.lit, (0.0, 0.1, 0.3, 0.6))), (C("vec_id") % 4).cast("int"))
    rows = rows.select("vec_id", double("embedding").alias("a"), double("next").alias("c"), t.alias("t"))
    return rows.select("vec_id", "a", F.zip_with("a", "c", lambda x, y: (1 - C("t")) * x + C("t") * y).alias("b"))


@query("f2_f9_f20_f21_f22_pair_evidence", f"""{_BLEND}, {_evidence_sql('p', 'vec_id, dt, burst')}
select vec_id, round(1 - ph / 64.0::double, 6) as hash_similarity, round(hist, 6) as hist, {_CONFIRM} as confirmed,
 same or (cos >= 0.94 and ((ph <= 18 and dh <= 28 and hist >= 0.72) or (burst and ph <= 24 and hist >= 0.60))) as moment, round(case when vec_id % 3 = 0 then 0.65 * (1 - ph / 64.0::double) + 0.35 * hist else cos end, 6) as similarity from ev""")
def f20(spark, d):
    e = _evidence(C("vec_id") % 40, C("vec_id") % 9 == 0)
    return blended(spark, d).select(
        "vec_id", r6(1 - e["phash"] / 64.0, "hash_similarity"), r6(e["hist"], "hist"), X.confirm_pair(e).alias("confirmed"), X.comparable_moment(e, 0.90).alias("moment"),
        r6(X.visual_semantic_similarity(F.when(C("vec_id") % 3 != 0, e["cos"]), e["phash"], e["hist"]), "similarity"),
    )


@query("f20_pair_confidence", f"{_BLEND}, {_evidence_sql('p', 'vec_id, dt, burst')} select vec_id, round(case when {_CONFIRM} then case when same then 1.0 else greatest(0.75, 1 - ph / 16.0::double, least(0.99, cos)) end end, 6) as confidence from ev")
def f20_confidence(spark, d):
    return blended(spark, d).select("vec_id", r6(X.pair_confidence(_evidence(C("vec_id") % 40, C("vec_id") % 9 == 0)), "confidence"))


@query("u6_explain_pair", f"{_BLEND}, {_evidence_sql('p', 'vec_id, dt, burst')} " + " union all ".join(f"select vec_id, '{name}' as rule from ev where {rule}" for name, rule in _RULES.items()))
def u6(spark, d):
    return blended(spark, d).select("vec_id", X.explain_pair(_evidence(C("vec_id") % 40, C("vec_id") % 9 == 0)).alias("rule"))


@query("f14_time_delta", "select event_id, round(abs(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6, 6) as seconds from events")
def f14(spark, d):
    rows = read(spark, d, "events").withColumn("before", F.expr("lag(ts) over (partition by user_id order by ts, event_id)"))
    return rows.select("event_id", r6(X.time_delta_seconds(C("ts"), C("before")), "seconds"))


@query("f12_location_change", """select l_orderkey, l_linenumber, coalesce(l_quantity >= 2 and (case when l_linenumber > 1 then l_tax * 2000 end is null or l_quantity >= 25 or l_tax * 2000 >= 120), false) as moved from lineitem""")
def f12(spark, d):
    return read(spark, d, "lineitem").select(*LINE, X.location_change(C("l_quantity"), F.when(C("l_linenumber") > 1, C("l_tax") * 2000)).alias("moved"))


@query("f23_marginal_novelty", """with n as (select vec_id, embedding::double[] as a, lead(embedding::double[]) over (partition by label order by vec_id) as b from embeddings)
select vec_id, round(case when vec_id % 5 = 0 or b is null then 1.0 when vec_id % 7 = 0 then case when vec_id % 2 = 0 then 0.15 else 0.65 end
 else greatest(0.0, 1 - list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))) end, 6) as novelty from n""")
def f23(spark, d):
    rows = read(spark, d, "embeddings").withColumn("next", F.expr("lead(embedding) over (partition by label order by vec_id)"))
    chosen = F.when((C("vec_id") % 5 == 0) | C("next").isNull(), F.array().cast("array<array<float>>")).otherwise(F.array("next"))
    return rows.select("vec_id", r6(X.marginal_novelty(F.when(C("vec_id") % 7 != 0, C("embedding")), chosen, C("vec_id") % 2 == 0), "novelty"))


_SCENE = """with n as (select vec_id, label, row_number() over (partition by label order by vec_id) as rn, [0.0, 0.1, 0.2, 0.6][vec_id % 4 + 1]::double as t, embedding::double[] as e, first_value(embedding::double[]) over (partition by label, vec_id // 40 order by vec_id) as f from embeddings),
m as (select vec_id, label, rn, list_transform(list_zip(f, e), lambda x: (1 - t) * x[1] + t * x[2]) as v from n),
p as (select x.label, x.vec_id as src, y.vec_id as dst, x.v as a, y.v as b, y.vec_id - x.vec_id as dt, false as burst from m x join m y on x.label = y.label and y.rn between x.rn + 1 and x.rn + 12 and y.vec_id - x.vec_id <= 120)"""


@query("j18_scene_pairs", f"{_SCENE}, {_evidence_sql('p', 'label, src, dst, dt, burst')} select label, src, dst, round(cos, 6) as similarity from ev where {_CONFIRM} and not same and cos >= 0.96 and mae <= 0.18 and hist >= 0.80 and ph <= 16 and dh <= 18")
def j18(spark, d):
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    rows = read(spark, d, "embeddings").withColumn("f", F.expr("first(embedding) over (partition by label, floor(vec_id / 40) order by vec_id)"))
    t = F.get(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.6))), (C("vec_id") % 4).cast("int"))
    rows = rows.withColumns({"t": t, "e": double("embedding"), "g": double("f")}).select("label", "vec_id", F.zip_with("g", "e", lambda x, y: (1 - C("t")) * x + C("t") * y).alias("v"))
    near = J.k_next_pairs(rows, key="vec_id", micros=C("vec_id") * 1_000_000, within=120, by=["label"])
    for side, name in (("src", "a"), ("dst", "b")):
        near = near.join(rows.select("label", C("vec_id").alias(side), C("v").alias(name)), ["label", side])
    e = _evidence(C("seconds"), F.lit(False))
    return J.scene_pairs(near, e).select("label", "src", "dst", r6(e["cos"], "similarity"))


# Decisions


@query("r15_apply_diversity", """select l_orderkey, l_linenumber, round(100 * l_discount * 10, 6) as value,
 concat_ws(',', case when l_quantity > 40 then 'sharp' end, case when l_discount > 0.08 then 'too_similar' when l_returnflag in ('A', 'N') and 100 * l_discount * 10 >= 65 then 'adds_variety' end) as reasons,
 case when l_tax > 0.02 then 'diversity=v1,' else '' end || 'score=s1' as versions from lineitem""")
def r15(spark, d):
    out = R.apply_diversity(
        F.create_map(F.lit("diversity_value"), F.lit(-1.0), F.lit("content"), C("l_tax")), F.when(C("l_quantity") > 40, F.array(F.lit("sharp"))).otherwise(F.array().cast("array<string>")), F.create_map(F.lit("score"), F.lit("s1")),
        value=100 * C("l_discount") * 10, demoted=C("l_discount") > 0.08, method=F.when(C("l_returnflag") == "A", "semantic_anchor").when(C("l_returnflag") == "N", "semantic_distance"), version=F.when(C("l_tax") > 0.02, F.lit("v1")),
    )
    versions = F.array_join(F.transform(F.array_sort(F.map_entries(out["versions"])), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return read(spark, d, "lineitem").select(*LINE, r6(F.element_at(out["components"], "diversity_value"), "value"), F.array_join(out["reasons"], ",").alias("reasons"), versions.alias("versions"))


@query("r17_series_role", """with s as (select label, vec_id // 64 as scene, max(vec_id) as best from embeddings group by 1, 2)
select vec_id, case when vec_id % 11 = 0 then 'protected' when vec_id = best then 'best_in_stack' when vec_id % 3 = 0 then 'alternative' else 'redundant_but_good' end as role from embeddings e join s on s.label = e.label and s.scene = e.vec_id // 64""")
def r17(spark, d):
    rows = read(spark, d, "embeddings").select("label", "vec_id", F.floor(C("vec_id") / 64).alias("scene"))
    lead = rows.groupBy("label", "scene").agg(F.max("vec_id").alias("best"))
    return rows.join(lead, ["label", "scene"]).select("vec_id", R.series_role(protected=C("vec_id") % 11 == 0, best=C("vec_id") == C("best"), selected=C("vec_id") % 3 == 0).alias("role"))


@query("f19_model_versions", """with s as (select user_id, event_type as kind, arg_max(event_id, (ts, event_id)) as id from events group by 1, 2),
n as (select user_id, kind, case when kind <> 'error' then 'm' || (id % 3) || '@' || (id % 4) || case when id % 5 <> 0 then '/revision-' || (id % 5) else '' end end as v from s)
select user_id, coalesce(string_agg(kind || '=' || v, ',' order by kind), '') as versions from n group by 1""")
def f19(spark, d):
    newest = read(spark, d, "events").groupBy("user_id", C("event_type").alias("signal_kind")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("id"))
    engine = F.when(C("signal_kind") != "error", F.concat(F.lit("m"), (C("id") % 3).cast("string")))
    rows = newest.select("user_id", "signal_kind", engine.alias("engine_name"), (C("id") % 4).cast("string").alias("engine_version"), F.when(C("id") % 5 != 0, C("id") % 5).alias("request_revision"))
    told = F.transform(F.map_entries("versions"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return model_versions(rows, key="user_id").select("user_id", F.array_join(told, ",").alias("versions"))


@query("g7_rerank_groups", """with o as (select o_orderkey as k, o_custkey as g, o_totalprice as p, o_orderdate as dt from orders), e as (select a.k as a, b.k as b from o a join o b on a.g = b.g and a.k <> b.k and abs(date_diff('day', a.dt::date, b.dt::date)) <= 900),
deg as (select a as k, count(*) as links from e group by 1), b as (select g, substr(md5(k::varchar), 1, 2) as bu, string_agg(k::varchar, ',' order by k::varchar) as ids, count(*) as n from o group by 1, 2),
s as (select g, sum(n)::bigint as n, sha256(string_agg(sha256(ids), ',' order by bu)) as digest from b group by 1),
t as (select o.*, n, coalesce(links, 0) = n - 1 as whole from o join s using (g) left join deg using (k)), l as (select g, coalesce(arg_min(k, (-p, k)) filter (where whole), min(k)) as leader from t group by 1),
old as (select g from o group by 1 having count(*) filter (where k % 10 = 0) = 0)
select case when old.g is not null then 'old-' || o.g else 'series-' || substr(digest, 1, 12) end as group_id, k as o_orderkey, leader, n from o join s using (g) join l using (g) left join old using (g)""")
def g7(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", C("o_custkey").alias("grp"), "o_totalprice", C("o_orderdate").cast("date").alias("day"))
    lead = rows.groupBy("grp").agg(F.min("o_orderkey").alias("leader"))
    ends = lambda side: rows.select("grp", C("o_orderkey").alias(side), C("day").alias(f"{side}_day"))
    edges = ends("src").join(ends("dst"), "grp").where("src < dst and abs(datediff(src_day, dst_day)) <= 900").select("src", "dst")
    before = rows.where("o_orderkey % 10 <> 0").select("o_orderkey", F.concat(F.lit("old-"), C("grp").cast("string")).alias("group_id"))
    return G.rerank_groups(rows.join(lead, "grp"), edges, before, key="o_orderkey", score="o_totalprice")


# Trust, truth and reports

_TRUST = """with r as (select source, doc_id, lang, doc_id % 3 = 0 as held, quality = 1 as ok from labels join documents using (doc_id)),
e as (select source, count(*) filter (where held) as hp, avg(ok::int) filter (where held) as ha, count(distinct lang) filter (where held) as hc, count(*) filter (where not held) as op, avg(ok::int) filter (where not held) as oa, count(distinct lang) filter (where not held) as oc from r group by 1)"""


@query("l6_ranker_reliability", f"""{_TRUST}, x as (select *, case when hp >= 3 and ha is not null then ha else oa end as acc, case when hp >= 3 and ha is not null then least(1.0, hp / 24, hc / 3) else least(0.5, op / 60) end as shown from e)
select source, coalesce(round(least(least(1.0, op / 24, oc / 3), shown) * least(greatest((acc - 0.5) / 0.5, 0), 1), 3), 0.0)::double as reliability from x""")
def l6(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select("source", "lang", (C("doc_id") % 3 == 0).alias("held"), (C("quality") == 1).cast("double").alias("ok"))
    parts = {}
    for name, when in (("held", C("held")), ("own", ~C("held"))):
        parts |= {f"{name}_pairs": F.count_if(when), f"{name}_accuracy": F.avg(F.when(when, C("ok"))), f"{name}_items": F.count_if(when), f"{name}_contexts": F.count_distinct(F.when(when, C("lang")))}
    e = rows.groupBy("source").agg(*[v.alias(k) for k, v in parts.items()])
    return e.select("source", X.ranker_reliability({k: C(k) for k in parts}).alias("reliability"))


@query("l8_compatible_models", """with f as (select source, case when n_chars > 40 then case when source in (select min(source) from documents) and n_chars > 15000 then 'v2' else 'v1' end end as s from documents),
o as (select source, min(s) as lo, max(s) as hi from f where s is not null group by 1), m as (select distinct source, case when substr(md5(source), 1, 1) < '4' then 'paused' else 'ready' end as st, case when substr(md5(source), 2, 1) < '8' then 'm1' when substr(md5(source), 2, 1) < 'c' then 'm0' end as mv from documents)
select source from m join o using (source) where lo = hi and lo = 'v1' and st <> 'paused' and coalesce(mv = 'm1', true)""")
def l8(spark, d):
    docs, digit = read(spark, d, "documents"), lambda k: F.substring(F.md5(C("source")), k, 1)
    first = docs.agg(F.min("source").alias("least"))
    schema = F.when(C("n_chars") > 40, F.when((C("source") == C("least")) & (C("n_chars") > 15000), "v2").otherwise("v1"))
    features = docs.crossJoin(F.broadcast(first)).select("source", schema.alias("feature_schema"))  # a table of one row
    models = docs.select("source").distinct().where("source is not null").withColumns({
        "feature_schema": F.lit("v1"), "status": F.when(digit(1) < "4", "paused").otherwise("ready"), "model_version": F.when(digit(2) < "8", "m1").when(digit(2) < "c", "m0"),
    })
    return L.compatible_models(models, features, by="source", version="m1").select("source")


def ensemble_pairs(spark, d):
    """First and second line of every order: preferred is the one of more value for its discount; three engines score both."""
    line = lambda n: read(spark, d, "lineitem").where(C("l_linenumber") == n).groupBy("l_orderkey").agg(*(F.min(c).cast("double").alias(f"{c}_{n}") for c in ("l_quantity", "l_extendedprice", "l_discount")), F.min("l_suppkey").alias(f"l_suppkey_{n}"))
    rows = line(1).join(line(2), "l_orderkey")
    value = lambda n: C(f"l_extendedprice_{n}") - 300000 * C(f"l_discount_{n}")
    first = value(1) > value(2)
    engines = {"quantity": lambda n: C(f"l_quantity_{n}"), "price": lambda n: C(f"l_extendedprice_{n}"), "full": lambda n: -C(f"l_discount_{n}")}
    sides = [F.when(first == won, f(1)).otherwise(f(2)).alias(f"{e}_{s}") for e, f in engines.items() for s, won in (("preferred", True), ("other", False))]
    split = F.when(C("l_suppkey_1") % 4 == 0, "held_out").otherwise("calibration").alias("split")
    return rows.where(value(1) != value(2)).select("l_orderkey", C("l_suppkey_1").alias("context"), split, *sides), list(engines)


@query("l9_ensemble_weights")
def l9(spark, d):
    pairs, engines = ensemble_pairs(spark, d)
    return L.fit_ensemble_weights(pairs, key="l_orderkey", context="context", engines=engines)


@query("l12_project_corpus", """with e as (select label as round, sha256(vec_id::varchar) as asset_key, array_to_string(list_transform(embedding[1:8], lambda v: round(v::double * 1000000)::bigint), ',') as feature, 'v1' as feature_schema, vec_id from embeddings),
o as (select round, asset_key, case when vec_id % 30 = 0 and round < 3 then feature || ',0' else feature end as feature, feature_schema from e where vec_id % 3 = 0), n as (select round, asset_key, feature, feature_schema from e where round <> 9 and vec_id % 5 <> 1),
c as (select n.round, count(*) as m from n join o using (round, asset_key) where n.feature <> o.feature group by 1),
a as (select round, sha256(count(*)::varchar || '|' || sum(('0x' || substr(md5(asset_key || chr(31) || '=' || feature || chr(31) || '=' || feature_schema), 1, 15))::bigint)::varchar) as input_hash, count(*) as n_rows, coalesce(any_value(m), 0) as n_changed, case when coalesce(any_value(m), 0) > 0 then 'failed' else 'completed' end as status from n left join c using (round) group by 1),
r as (select n.* from n join a using (round) where status = 'completed' union all select * from o where round not in (select round from a where status = 'completed'))
select r.round, asset_key, feature, input_hash, n_rows, n_changed, status from r left join a on a.round = r.round""")
def l12(spark, d):
    feature = F.array_join(F.transform(F.slice("embedding", 1, 8), lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ",")
    rows = read(spark, d, "embeddings").select(C("label").alias("round"), F.sha2(C("vec_id").cast("string"), 256).alias("asset_key"), feature.alias("feature"), F.lit("v1").alias("feature_schema"), "vec_id")
    old = rows.where("vec_id % 3 = 0").withColumn("feature", F.when(F.expr("vec_id % 30 = 0 and round < 3"), F.concat("feature", F.lit(",0"))).otherwise(C("feature")))
    corpus, audit = L.project_corpus(old, rows.where("round <> 9 and vec_id % 5 <> 1"), context="round", key="asset_key", frozen=["feature", "feature_schema"])
    return corpus.join(audit, "round", "left").select("round", "asset_key", "feature", "input_hash", "n_rows", "n_changed", "status")


@query("l13_sync_training_examples", """with p as (select vec_id as pair_id, vec_id as preferred, vec_id + 1 as rejected, case when vec_id % 4 = 0 then 'held_out' else 'training' end as split from embeddings),
x as (select vec_id + 1 as a, vec_id as b from embeddings where vec_id % 6 = 1)
select pair_id, preferred, rejected, round(list_dot_product(v.embedding::double[], w.embedding::double[]), 6) as product from p join embeddings v on v.vec_id = preferred join embeddings w on w.vec_id = rejected
where split = 'training' and pair_id % 10 <> 3 and not exists (select 1 from x where least(a, b) = least(preferred, rejected) and greatest(a, b) = greatest(preferred, rejected))""")
def l13(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    pairs = v.select(C("vec_id").alias("pair_id"), C("vec_id").alias("preferred"), (C("vec_id") + 1).alias("rejected"), F.when(C("vec_id") % 4 == 0, "held_out").otherwise("training").alias("split"))
    gone = v.where("vec_id % 6 = 1").select((C("vec_id") + 1).alias("preferred"), C("vec_id").alias("rejected"))
    out = L.sync_training_examples(pairs, v, exclusions=gone, existing=pairs.where("pair_id % 10 = 3"), key="vec_id", vector="embedding")
    return out.select("pair_id", "preferred", "rejected", r6(X.dot(C("preferred_vector"), C("rejected_vector")), "product"))


_SIDES = """with r as (select l.doc_id, quality, n_chars from labels l join documents using (doc_id)), p as (select case when a.quality = 1 then a.doc_id else b.doc_id end as w, case when a.quality = 1 then b.doc_id else a.doc_id end as l from r a join r b on b.doc_id = a.doc_id + 1 and a.quality <> b.quality)"""


def _sides(spark, d):
    """(preferred, other) of neighbours of which one is good."""
    r = read(spark, d, "labels").select("doc_id", "quality")
    both = r.join(r.select((C("doc_id") - 1).alias("doc_id"), C("quality").alias("q2")), "doc_id").where("quality <> q2")
    good = C("quality") == 1
    return both.select(F.when(good, C("doc_id")).otherwise(C("doc_id") + 1).alias("preferred"), F.when(good, C("doc_id") + 1).otherwise(C("doc_id")).alias("other"))


def _won(score, name):
    return f"(select avg(case when {score('a')} > {score('b')} then 1.0 when {score('a')} = {score('b')} then 0.5 else 0.0 end) from p join documents a on a.doc_id = w join documents b on b.doc_id = l) as {name}"


def _hit(score, name):
    return f"(select count(*) / 40.0::double from (select doc_id from documents d order by {score('d')} desc, doc_id limit 40) where doc_id in (select doc_id from labels where quality = 1)) as {name}"


_SIZE, _LANG = (lambda t: f"{t}.n_chars"), (lambda t: f"{t}.doc_id % 7")


@query("e10_compare_scores", f"""{_SIDES}, m as (select {_won(_SIZE, 'ca')}, {_hit(_SIZE, 'co')}, {_won(_LANG, 'ba')}, {_hit(_LANG, 'bo')})
select round(ca, 6) as candidate_accuracy, round(co, 6) as candidate_overlap, round(ba, 6) as baseline_accuracy, round(bo, 6) as baseline_overlap, round(ca - ba, 6) as pair_uplift, round(co - bo, 6) as top_uplift, ca - ba >= 0.05 and co - bo >= 0.10 as passed from m""")
def e10(spark, d):
    docs = read(spark, d, "documents")
    scores = docs.select("doc_id", F.lit("size").alias("engine"), C("n_chars").cast("double").alias("s")).unionByName(docs.select("doc_id", F.lit("turn").alias("engine"), (C("doc_id") % 7).cast("double").alias("s")))
    out = E.compare_scores(_sides(spark, d), read(spark, d, "labels").where("quality = 1"), scores, key="doc_id", engine="engine", score="s", k=40, candidate="size", baseline="turn")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "passed"], "passed")


@query("e9_evaluate", f"""{_SIDES}, m as (select (select precision from ({ORACLES['e2_pair_precision_recall']})) as precision, (select recall from ({ORACLES['e2_pair_precision_recall']})) as recall, (select "right" / groups from ({ORACLES['e3_leader_accuracy']})) as leaders,
 (select rate from ({ORACLES['e4_false_exclusion_rate']})) as false_exclusion, {_won(_SIZE, 'preference')}, {_hit(_SIZE, 'top_k')}, (select count(*) from labels) as labels, (select count(*) from labels where quality = 1) as expected, (select count(*) from p) as held_pairs)
select round(precision, 6) as precision, round(recall, 6) as recall, round(leaders, 6) as leaders, round(false_exclusion, 6) as false_exclusion, round(preference, 6) as preference, round(top_k, 6) as top_k,
 concat_ws(',', case when precision < 0.999 then 'precision' end, case when recall < 0.95 then 'recall' end, case when leaders < 0.85 then 'leaders' end, case when false_exclusion > 0.005 then 'false_exclusion' end, case when preference < 0.65 then 'preference' end, case when top_k < 0.60 then 'top_k' end) as missed,
 labels between 50 and 100 and held_pairs >= 10 and expected >= 5 as eligible from m""")
def e9(spark, d):
    from gleaner.plans.registry import QUERIES

    known = lambda name: QUERIES[name](spark, d)
    lead = known("e3_leader_accuracy").select((C("right") / C("groups")).alias("leaders"), C("groups").alias("truth_groups"))
    labels = read(spark, d, "labels").agg(F.count("*").alias("labels"), F.count_if(C("quality") == 1).alias("expected"))
    size = read(spark, d, "documents").select("doc_id", C("n_chars").alias("s"))
    won = E.preference_accuracy(_sides(spark, d), size, key="doc_id", score="s").select(C("accuracy").alias("preference"), C("pairs").alias("held_pairs"))
    top = E.top_k_overlap(read(spark, d, "labels").where("quality = 1"), size, key="doc_id", score="s", k=40).withColumnRenamed("overlap", "top_k")
    row = known("e2_pair_precision_recall").withColumn("truth_pairs", F.lit(1))
    for one in (lead, known("e4_false_exclusion_rate").withColumnRenamed("rate", "false_exclusion"), won, top, labels):
        row = row.crossJoin(one)  # tables of one row
    out = E.evaluate(row)
    return out.select(*[r6(C(c), c) for c in E.GATES], F.array_join("missed", ",").alias("missed"), "eligible")


@query("e11_build_truth", """with g as (select l_orderkey from lineitem group by 1 having count(*) >= 2 and count(*) filter (where l_linenumber = 1) = 1 and bool_and(l_quantity >= 3) and bool_and(l_tax < 0.08) and count(distinct l_linestatus) = 1)
select l_orderkey, l_linenumber from lineitem join g using (l_orderkey)""")
def e11(spark, d):
    rows = read(spark, d, "lineitem")
    return E.build_truth(rows, group="l_orderkey", leader=C("l_linenumber") == 1, labelled=C("l_quantity") >= 3, provenance="l_linestatus", unchanged=C("l_tax") < 0.08).select(*LINE)


_SERIES = """with s as (select l_orderkey, list(distinct l_linenumber) as m, case when l_orderkey % 3 > 0 then l_orderkey % 5 end as budget, coalesce(list(distinct case when l_discount > 0.04 then l_linenumber + (l_orderkey % 17 = 0)::int * 50 end) filter (where l_discount > 0.04), []) as ess,
 coalesce(list(distinct l_linenumber) filter (where l_discount > 0.08), []) as red, coalesce(list(distinct case when l_tax > 0.07 then 'odd' else 'sharp' end) filter (where l_tax > 0.03), []) as why, case when l_orderkey % 19 = 0 then 99 else 1 end as lead from lineitem group by l_orderkey)"""


@query("v5_check_series", _SERIES + " " + " union all ".join(f"select '{n}' as rule, l_orderkey::varchar as key from s where {c}" for n, c in [
    ("too small", "len(m) < 2"), ("leader", "not list_contains(m, lead)"), ("budget", "budget is not null and not budget between 1 and len(m)"), ("leader not essential", "budget is not null and not list_contains(ess, lead)"),
    ("foreign", "budget is not null and len(list_filter(list_concat(ess, red), lambda x: not list_contains(m, x))) > 0"), ("both", "budget is not null and len(list_intersect(ess, red)) > 0"), ("over budget", "budget is not null and len(ess) > budget"),
    ("no reason", "budget is not null and len(why) = 0"), ("unknown reason", "budget is not null and list_contains(why, 'odd')"), ("no budget", "budget is null and len(ess) + len(red) + len(why) > 0")]))
def v5(spark, d):
    c = C("l_linenumber")
    series = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(c).alias("members"), F.collect_set(F.when(C("l_discount") > 0.04, c + F.when(C("l_orderkey") % 17 == 0, 50).otherwise(0))).alias("essential"), F.collect_set(F.when(C("l_discount") > 0.08, c)).alias("redundant"),
        F.collect_set(F.when(C("l_tax") > 0.07, "odd").when(C("l_tax") > 0.03, "sharp")).alias("reasons"),
    )
    kind = series.schema["members"].dataType.elementType
    series = series.withColumns({"budget": F.when(C("l_orderkey") % 3 > 0, C("l_orderkey") % 5), "leader": F.when(C("l_orderkey") % 19 == 0, 99).otherwise(1).cast(kind)})
    fit = lambda x: F.transform(x, lambda v: v.cast(kind))
    return E.check_series(series.withColumn("essential", fit("essential")), key="l_orderkey", codes=["sharp"])


@query("v6_check_corpus", """select 'origin' as rule, doc_id::varchar as key from documents where doc_id % 50 = 0 union all select 'vector', doc_id::varchar from documents where strlen(text) % 4 <> 0 union all select 'context', source from documents group by source having count(distinct lang) > 1 union all select 'column', 'n_chars'""")
def v6(spark, d):
    rows = read(spark, d, "documents").withColumns({"human_origin": (C("doc_id") % 50 != 0).cast("int"), "vector": C("text").cast("binary")}).drop("text")
    return E.check_corpus(rows, key="doc_id", columns=["doc_id", "lang", "source", "human_origin", "vector"], context="source", split="lang")
