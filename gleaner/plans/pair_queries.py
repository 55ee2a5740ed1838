"""Queries over the pair, group and expression operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import groups as G
from gleaner.operators import pairs as J
from gleaner.operators import scenes as S
from gleaner.plans.ordered_queries import micros, r6
from gleaner.plans.registry import query
from gleaner.sources.tables import materialize, read

_VOTES = ", ".join(f"sum(case when (h >> {b}) & 1 = 1 then 1 else -1 end) as v{b}" for b in range(60))
_BITS = " + ".join(f"(case when v{b} > 0 then {1 << b}::bigint else 0::bigint end)" for b in range(60))
_SIG = f"""tok as (select doc_id, unnest(string_split(text, ' ')) as token from documents), tk as (select doc_id, ('0x' || substr(md5(token), 1, 15))::bigint as h from tok where token <> ''),
vt as (select doc_id, {_VOTES} from tk group by 1), sig as (select doc_id, {_BITS} as s from vt)"""
_NEAR = _SIG + ", ds as (select distinct s from sig), near as (select a.s as p, b.s as q from ds a join ds b on a.s < b.s and bit_count(xor(a.s, b.s)) <= 10)"


def signatures(spark: SparkSession, d: str) -> DataFrame:
    return J.text_signatures(read(spark, d, "documents"), key="doc_id", text="text")


@query("f0_text_signatures", f"with {_SIG} select doc_id, s as signature from sig")
def f0(spark, d):
    return signatures(spark, d)


@query("j7_interval_pairs", """
select a.event_type, least(a.event_id, b.event_id) as src, greatest(a.event_id, b.event_id) as dst, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 6) as seconds from events a join events b on a.event_type = b.event_type
 and epoch_us(b.ts) between epoch_us(a.ts) and epoch_us(a.ts) + 120000000 and (b.ts > a.ts or a.event_id < b.event_id)""")
def j7(spark, d):
    return J.interval_pairs(read(spark, d, "events"), key="event_id", micros=micros(), within=120, by=["event_type"]).withColumn("seconds", F.round("seconds", 6))


@query("j8_k_next_pairs", """
with r as (select event_id, event_type, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as rn from events)
select a.event_type, least(a.event_id, b.event_id) as src, greatest(a.event_id, b.event_id) as dst, round((b.t - a.t) / 1e6, 6) as seconds
from r a join r b on a.event_type = b.event_type and b.rn between a.rn + 1 and a.rn + 12 and b.t - a.t <= 3600000000""")
def j8(spark, d):
    return J.k_next_pairs(read(spark, d, "events"), key="event_id", micros=micros(), within=3600, by=["event_type"]).withColumn("seconds", F.round("seconds", 6))


@query("j8_zoned_pairs", """
with r as (select event_id, event_type, epoch_us(ts) as t, user_id % 3 > 0 as z, row_number() over (partition by event_type order by ts, event_id) as rn from events),
c as (select *, case when z is not distinct from lag(z) over (partition by event_type order by rn) and rn > 1 then 0 else 1 end as change from r), q as (select *, sum(change) over (partition by event_type order by rn) as run from c)
select a.event_type, least(a.event_id, b.event_id) as src, greatest(a.event_id, b.event_id) as dst, round((b.t - a.t) / 1e6, 6) as seconds
from q a join q b on a.event_type = b.event_type and a.run = b.run and b.rn between a.rn + 1 and a.rn + 12 and b.t - a.t <= 3600000000""")
def j8_zoned(spark, d):
    """As j8, where two thirds of the users' times count as zoned."""
    out = J.k_next_pairs(read(spark, d, "events"), key="event_id", micros=micros(), within=3600, by=["event_type"], zoned=F.col("user_id") % 3 > 0)
    return out.withColumn("seconds", F.round("seconds", 6))


@query("j9_signature_pairs", f"with {_NEAR} select p as src, q as dst, cast(bit_count(xor(p, q)) as integer) as distance from near")
def j9(spark, d):
    return J.signature_pairs(signatures(spark, d), signature="signature", bands=J.BANDS_60)


@query("j11_equal_content_star", """
with f as (select *, sha256(text) as h, first_value(doc_id) over (partition by sha256(text) order by n_chars, doc_id) as f from documents)
select least(f, doc_id) as src, greatest(f, doc_id) as dst from f where doc_id <> f""")
def j11(spark, d):
    docs = read(spark, d, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    return J.equal_key_star(docs, key="doc_id", on="h", order=["n_chars"])


def described(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their content digest, signature (null without words), letter histogram and size, written once."""
    docs = read(spark, d, "documents")
    letters = F.array(*[(F.length("text") - F.length(F.replace("text", F.lit(x), F.lit("")))).alias(x) for x in LETTERS])
    own = docs.select("doc_id", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"), letters.alias("letters"))
    return materialize(own.join(signatures(spark, d), "doc_id", "left"))


LETTERS = "aeinorst"


def _stars(docs: DataFrame) -> DataFrame:
    """Rows near in time and stars of equal content and of equal signatures. Documents arrive one a second, by id."""
    star = J.equal_key_star(docs.where("signature is not null"), key="doc_id", on="signature", order=["n_chars"])
    soon = J.interval_pairs(docs, key="doc_id", micros=F.col("doc_id") * 1_000_000, within=WINDOW, by=["source"]).select("src", "dst")
    return soon.union(star).union(J.equal_key_star(docs, key="doc_id", on="h", order=["n_chars"]))


def candidates(docs: DataFrame) -> DataFrame:
    """All candidates: rows near in time, stars, and pairs across near signatures, whatever the time between them.

    The last are the most by far, and each is made once: so only the others are made distinct, and those of them that are
    pairs across near signatures leave."""
    sig = docs.where("signature is not null")
    own = materialize(J.leading(sig, key="doc_id", signature="signature", order=["n_chars"]))
    a, b = own.toDF("src", "s", "lead"), own.toDF("dst", "s2", "lead2")
    across = (F.col("s") != F.col("s2")) & (X.hamming(F.col("s"), F.col("s2")) <= 10) & (F.col("lead") | F.col("lead2"))
    rest = _stars(docs).distinct().join(a, "src", "left").join(b, "dst", "left").where(~F.coalesce(across, F.lit(False))).select("src", "dst")
    return rest.union(J.representative_pairs(sig, key="doc_id", signature="signature", order=["n_chars"]))


def timely_candidates(docs: DataFrame) -> DataFrame:
    """The candidates that evidence can confirm: across near signatures only those within the time window, as different
    content further apart never is."""
    across = J.representative_pairs_within(docs, key="doc_id", signature="signature", order=["n_chars"], micros=F.col("doc_id") * 1_000_000, within=WINDOW)
    return _stars(docs).union(across).distinct()


WINDOW = 120

_CAND = _NEAR + f""", sd as (select sig.doc_id, s, n_chars, first_value(sig.doc_id) over (partition by s order by n_chars, sig.doc_id) as f from sig join documents d using (doc_id)),
bp as (select p, q from near union all select q, p from near), cand as (
select least(f, doc_id) as src, greatest(f, doc_id) as dst from sd where doc_id <> f
union select least(x.f, y.doc_id), greatest(x.f, y.doc_id) from bp join (select distinct s, f from sd) x on x.s = bp.p join sd y on y.s = bp.q
union select least(f, doc_id), greatest(f, doc_id) from (select doc_id, first_value(doc_id) over (partition by sha256(text) order by n_chars, doc_id) as f from documents) where doc_id <> f
union select a.doc_id, b.doc_id from documents a join documents b on a.source = b.source and b.doc_id - a.doc_id between 1 and {WINDOW})"""
_HIST = ", ".join(f"length(text) - length(replace(text, '{x}', ''))" for x in LETTERS)
_OK = f""", ds2 as (select doc_id, source, n_chars, text, s, [{_HIST}]::double[] as v from documents left join sig using (doc_id)),
ev as (select src, dst, x.text = y.text as same, bit_count(xor(x.s, y.s)) as ph, abs(x.n_chars - y.n_chars) / greatest(x.n_chars, y.n_chars, 0.001) as aspect, dst - src as dt, x.source = y.source and dst - src <= 8 as burst,
 coalesce(list_dot_product(x.v, y.v) / nullif(sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)), 0), 0) as hist from cand join ds2 x on x.doc_id = src join ds2 y on y.doc_id = dst),
ok as (select src, dst from ev where same or (ph <= 4 and aspect <= 0.08 and hist >= 0.72 and dt <= {WINDOW}) or (ph <= 10 and dt <= {WINDOW} and aspect <= 0.08 and hist >= 0.84) or (burst and ph <= 24 and hist >= 0.60))"""


@query("j12_candidate_pairs", f"with {_CAND} select src, dst from cand")
def j12(spark, d):
    return candidates(described(spark, d))


def confirmed(own: DataFrame) -> DataFrame:
    """Candidates that the evidence at hand confirms: content, signature, size, letters, distance in time and bursts.

    Texts have one signature, no pixels and no vectors: both distances are the same, the rest is unknown."""
    a, b = own.toDF("src", "o1", "n1", "h1", "l1", "s1"), own.toDF("dst", "o2", "n2", "h2", "l2", "s2")
    c, none = F.col, F.lit(None).cast("double")
    gap, seconds = X.hamming(c("s1"), c("s2")), c("dst") - c("src")
    cheap = timely_candidates(own).join(a, "src").join(b, "dst").where((c("h1") == c("h2")) | (seconds <= WINDOW))
    evidence = {
        "same_hash": c("h1") == c("h2"), "phash": gap, "dhash": gap, "aspect": X.aspect_delta(c("n1"), F.lit(1), c("n2"), F.lit(1)), "hist": X.histogram_similarity(c("l1"), c("l2")),
        "mae": none, "xmae": none, "cos": none, "dt": seconds, "burst": (c("o1") == c("o2")) & (seconds <= 8),
    }
    return cheap.where(X.confirm_pair(evidence)).select("src", "dst")


@query("j15_confirmed_pairs", f"with {_CAND} {_OK} select src, dst from ok")
def j15(spark, d):
    return confirmed(described(spark, d))


@query("g1_connected_components", f"""with recursive {_CAND} {_OK}, e as (select src as a, dst as b from ok union select dst, src from ok),
w(n, m) as (select a, a from e union select w.n, e.b from w join e on e.a = w.m) select n as node, min(m) as component from w group by 1""")
def g1(spark, d):
    return G.connected_components(materialize(confirmed(described(spark, d))))


_EDGES = "e as (select src as a, dst as b from ok union select dst, src from ok)"


@query("g2_leader_split", f"""with recursive {_CAND} {_OK}, {_EDGES}, x as (select sha256(text) as h, min(doc_id) as leader from documents group by 1 having count(*) > 1),
peeled as (select doc_id, leader from documents join x on sha256(text) = h), f as (select a, b from e where a not in (select doc_id from peeled) and b not in (select doc_id from peeled)),
n as (select a, list(b) as near, row_number() over (order by a) as k from f group by a),
s(k, led) as (select 0::bigint, []::bigint[] union all select n.k, case when len(list_intersect(n.near, s.led)) = 0 then list_append(s.led, n.a) else s.led end from s join n on n.k = s.k + 1),
l as (select led from s order by k desc limit 1), m as (select a as doc_id, list_min(list_intersect(near, led)) as leader from n, l where not list_contains(led, a))
select doc_id, leader from m union all select distinct leader, leader from m union all select doc_id, leader from peeled""")
def g2(spark, d):
    own = described(spark, d)
    return G.leader_split(own, confirmed(own), key="doc_id", rank="doc_id", exact="h")


@query("g3_exact_groups", """
select sha256(text) as content, max(doc_id) as leader, count(*) as n, string_agg(doc_id::varchar, ',' order by doc_id) as members from documents group by 1 having count(*) >= 2""")
def g3(spark, d):
    out = G.exact_groups(read(spark, d, "documents"), key="doc_id", content=F.sha2(F.col("text").cast("binary"), 256), order=F.struct("doc_id"))
    return out.select("content", "leader", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("g3_exact_members", """
with x as (select sha256(text) as content, max(doc_id) as leader, count(*) as n from documents group by 1 having count(*) >= 2) select content, doc_id, leader, n from documents join x on sha256(text) = content""")
def g3_members(spark, d):
    return G.exact_members(read(spark, d, "documents"), key="doc_id", content=F.sha2(F.col("text").cast("binary"), 256), order=F.struct("doc_id"))


@query("g4_choose_leader", "select l_orderkey, arg_max(l_linenumber, (l_quantity, l_extendedprice, -l_linenumber)) as leader from lineitem group by 1")
def g4(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", "l_extendedprice", -F.col("l_linenumber"))).alias("leader"))


@query("g5_describe_groups", """
select l_orderkey, case when count(distinct l_partkey) = 1 then 'exact' else 'near' end as kind, round(min(1 - l_discount), 6) as confidence, count(*) as n,
 max(case when l_linenumber = 1 then l_quantity end) < 0.75 * max(l_quantity) as leader_lower_resolution from lineitem group by 1""")
def g5(spark, d):
    rows = read(spark, d, "lineitem").withColumns({"conf": 1 - F.col("l_discount"), "leads": F.col("l_linenumber") == 1})
    return G.describe_groups(rows, by=["l_orderkey"], content="l_partkey", confidence="conf", size="l_quantity", leader="leads").withColumn("confidence", F.round("confidence", 6))


@query("g6_series_picks")
def g6(spark, d):
    rows = read(spark, d, "embeddings").withColumn("quality", 1 - (F.col("vec_id") % 17) / 200.0)
    return G.series_picks(rows, by=["label"], key="vec_id", vector="embedding", quality="quality", alike=0.3)


_SCENE = """v as (select vec_id, vec_id // 64 as scene, row_number() over (partition by vec_id // 64 order by vec_id) as p, embedding::double[] as v from embeddings),
m as (select a.scene, a.p, a.vec_id, list(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) order by b.p) as sim from v a join v b using (scene) group by 1, 2, 3)"""


@query("g8_complete_link_stacks", f"""with recursive {_SCENE}, n as (select scene, p, vec_id, list_filter(range(1, p), lambda q: sim[q] >= 0) as near from m),
s(scene, p, vec_id, stacks, stack) as (select scene, p, vec_id, [[p]], 0::bigint from n where p = 1 union all
 select scene, p, vec_id, case when spot is null then list_append(stacks, [p]) else list_concat(list_concat(stacks[:spot - 1], [list_append(stacks[spot], p)]), stacks[spot + 1:]) end, coalesce(spot - 1, len(stacks))
 from (select n.scene, n.p, n.vec_id, s.stacks, nullif(list_position(list_transform(s.stacks, lambda x: len(list_intersect(x, n.near)) = len(x)), true), 0) as spot from s join n on n.scene = s.scene and n.p = s.p + 1))
select scene, vec_id, stack::integer as stack from s""")
def g8(spark, d):
    rows = read(spark, d, "embeddings").withColumn("scene", F.floor(F.col("vec_id") / 64))
    return S.complete_link_stacks(rows, by=["scene"], key="vec_id", vector="embedding", threshold=0.0)


@query("g9_group_batches", """
with recursive s as (select l_suppkey, year(l_shipdate) * 4 + quarter(l_shipdate) as season, count(*) as m from lineitem group by 1, 2),
u as (select l_suppkey, season, p.i as piece, least(16, m - p.i * 16) as n from s, (select unnest(generate_series(0, 1000)) as i) p where p.i * 16 < m),
k as (select *, row_number() over (partition by l_suppkey order by season, piece) as r from u),
g as (select l_suppkey, season, piece, n, r, n as fill, 0::bigint as batch from k where r = 1
 union all select k.l_suppkey, k.season, k.piece, k.n, k.r, case when fill + k.n > 16 then k.n else fill + k.n end, batch + (fill + k.n > 16)::int from g join k on k.l_suppkey = g.l_suppkey and k.r = g.r + 1)
select l_suppkey, season, piece, n, batch from g""")
def g9(spark, d):
    lines = read(spark, d, "lineitem").withColumn("season", F.year("l_shipdate") * 4 + F.quarter("l_shipdate"))
    return G.group_batches(lines, group="season", limit=16, by=["l_suppkey"]).select("l_suppkey", "season", "piece", "n", "batch")


@query("g10_node_id", "select l_orderkey, 'scene-' || substr(sha256(string_agg(l_linenumber::varchar, '|' order by l_linenumber)), 1, 16) as node from lineitem group by 1")
def g10(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string"))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(X.node_id("scene", ids).alias("node"))


@query("g11_external_leaders", """
select l_orderkey, min(case when l_linenumber % 3 = 1 and l_discount >= 0.05 then l_linenumber end) as leader from lineitem group by 1 having count(*) filter (where l_linenumber % 3 = 1 and l_discount >= 0.05) = 1""")
def g11(spark, d):
    rows = read(spark, d, "lineitem").withColumn("rk", F.col("l_linenumber") % 3)
    return G.external_leaders(rows, by=["l_orderkey"], key="l_linenumber", rank="rk", confidence="l_discount", least=0.05)


@query("j3_group_context", """
with s as (select l_orderkey, any_value(l_linenumber) filter (where l_linenumber = 1) as leader_id, min(l_quantity) filter (where l_linenumber = 1) as lq, count(*) as n from lineitem group by 1)
select l_orderkey, l_linenumber, leader_id, n as group_size, round(lq - l_quantity, 6) as quality_margin, l_quantity < 0.75 * lq as lower_copy from lineitem join s using (l_orderkey)""")
def j3(spark, d):
    rows = read(spark, d, "lineitem").withColumn("leads", F.col("l_linenumber") == 1)
    out = G.group_context(rows, key="l_linenumber", by=["l_orderkey"], quality="l_quantity", leader="leads")
    return out.select("l_orderkey", "l_linenumber", "leader_id", "group_size", r6(F.col("quality_margin"), "quality_margin"), "lower_copy")


@query("j13_drift", """
with c as (select c_custkey, case when c_custkey % 11 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, case when c_custkey % 13 = 0 then 'X' else c_mktsegment end as c_mktsegment from customer where c_custkey % 7 <> 0),
p as (select c_custkey, c_acctbal, c_mktsegment from customer where c_custkey % 5 <> 0)
select coalesce(p.c_custkey, c.c_custkey) as c_custkey, case when c.c_custkey is null then 'missing' when p.c_custkey is null then 'extra' else concat_ws(',', case when p.c_acctbal is distinct from c.c_acctbal then 'changed:c_acctbal' end, case when p.c_mktsegment is distinct from c.c_mktsegment then 'changed:c_mktsegment' end) end as reasons
from p full join c on p.c_custkey = c.c_custkey where c.c_custkey is null or p.c_custkey is null or p.c_acctbal is distinct from c.c_acctbal or p.c_mktsegment is distinct from c.c_mktsegment""")
def j13(spark, d):
    base = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    now = base.where("c_custkey % 7 <> 0").withColumns({"c_acctbal": F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")), "c_mktsegment": F.when(F.col("c_custkey") % 13 == 0, "X").otherwise(F.col("c_mktsegment"))})
    out = J.drift(base.where("c_custkey % 5 <> 0"), now, key="c_custkey", fields=["c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@query("j14_pair_provenance", """
with p as (select a.o_orderkey as src, b.o_orderkey as dst from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey), m as (select o_orderkey, o_orderpriority as g from orders where o_orderstatus <> 'F')
select src, dst, case when x.g is not null and y.g is not null then least(x.g, y.g) || '|' || greatest(x.g, y.g) end as episode_pair from p left join m x on x.o_orderkey = src left join m y on y.o_orderkey = dst""")
def j14(spark, d):
    orders = read(spark, d, "orders")
    return J.pair_provenance(J.within_group_pairs(orders, key="o_orderkey", by=["o_custkey"]).drop("o_custkey"), orders.where("o_orderstatus <> 'F'"), key="o_orderkey", group="o_orderpriority")


@query("j16_within_group_pairs", "select a.l_orderkey, a.l_linenumber as src, b.l_linenumber as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber")
def j16(spark, d):
    return J.within_group_pairs(read(spark, d, "lineitem"), key="l_linenumber", by=["l_orderkey"])


@query("j17_cosine_pairs", """
with n as (select vec_id, label, embedding::double[] as v from embeddings)
select a.label, a.vec_id as src, b.vec_id as dst, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) as cosine from n a join n b on a.label = b.label and a.vec_id < b.vec_id
where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.25""")
def j17(spark, d):
    return J.cosine_pairs(read(spark, d, "embeddings"), key="vec_id", vector="embedding", threshold=0.25, by=["label"]).withColumn("cosine", F.round("cosine", 6))


@query("j20_preference_products", """
with r as (select l.doc_id, quality, source from labels l join documents using (doc_id) where l.doc_id is not null) select a.source, a.doc_id as preferred, b.doc_id as other from r a join r b on a.source = b.source and a.quality = 1 and b.quality = 0""")
def j20(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return J.preference_products(rows, by=["source"], key="doc_id", label="quality")


@query("j20_round_preferences", """
with r as (select l.doc_id, quality, source, l.doc_id // 100 as round from labels l join documents using (doc_id)) select a.source, a.round, a.doc_id as preferred, b.doc_id as other from r a join r b on a.source = b.source and a.round = b.round and a.quality = 1 and b.quality = 0""")
def j20_rounds(spark, d):
    """The chosen and the rejected of a round of a hundred documents, as reviewers see them."""
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("round", F.floor(F.col("doc_id") / 100))
    return J.preference_products(rows, by=["source", "round"], key="doc_id", label="quality")


@query("w20_ranked_subset", f"""with recursive {_SCENE}, c as (select scene, count(*) as n, ceil(sqrt(count(*)))::bigint as budget, list(vec_id order by p) as ids, list((vec_id % 11) / 10.0::double order by p) as rk, list(sim order by p) as sim from m group by 1),
f as (select *, list_max(list_transform(range(1, n + 1), lambda i: {{'r': rk[i], 'k': i}})).k as first from c),
s(scene, place, chosen, most) as (select scene, 1::bigint, [first], sim[first] from f union all
 select scene, place + 1, list_append(chosen, best), list_transform(range(1, n + 1), lambda i: greatest(most[i], sim[best][i])) from (select s.*, f.n, f.sim, list_max(list_transform(list_filter(range(1, f.n + 1), lambda i: not list_contains(s.chosen, i)),
  lambda i: {{'v': round(0.7 * f.rk[i] + 0.3 * greatest(0, 1 - s.most[i]), 12), 'r': f.rk[i], 'k': i}})).k as best from s join f using (scene) where s.place < f.budget))
select scene, ids[chosen[place]] as vec_id, place::integer as place from s join c using (scene)""")
def w20(spark, d):
    rows = read(spark, d, "embeddings").withColumns({"scene": F.floor(F.col("vec_id") / 64), "rank": (F.col("vec_id") % 11) / 10.0})
    return S.ranked_subset(rows, by=["scene"], key="vec_id", vector="embedding", rank="rank")


_ALIKE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_KEPT = """s(label, k, kept, keep) as (select label, 0::bigint, []::bigint[], null::boolean from n group by 1 union all
 select n.label, n.k, case when len(list_intersect(n.near, s.kept)) < {cap} then list_append(s.kept, n.vec_id) else s.kept end, len(list_intersect(n.near, s.kept)) < {cap} from s join n on n.label = s.label and n.k = s.k + 1)"""


@query("w21_diversity_demotions", f"""with recursive v as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label order by vec_id) as k from embeddings),
n as (select a.label, a.k, a.vec_id, coalesce(list(b.vec_id) filter (where b.k < a.k and {_ALIKE} >= 0.2), []) as near from v a join v b using (label) group by 1, 2, 3), {_KEPT.format(cap=2)}
select vec_id, keep as kept from s join n using (label, k)""")
def w21(spark, d):
    vectors = read(spark, d, "embeddings")
    return G.diverse(vectors, by=["label"], key="vec_id", vector="embedding", rank="vec_id", alike=0.2, cap=2)


@query("w21_diversity_rerank", f"""with recursive v as (select vec_id, label, embedding::double[] as v, row_number() over (partition by label order by vec_id % 7 desc, vec_id desc) as k from embeddings where vec_id % 5 <> 0 and vec_id % 11 <> 0),
p as (select a.label, a.k, a.vec_id, b.vec_id as other, b.k as ok, {_ALIKE} as sim from v a join v b using (label)),
n as (select label, k, vec_id, coalesce(list(other) filter (where ok < k and sim >= 0.2), []) as near from p group by 1, 2, 3), {_KEPT.format(cap=2)},
t as (select s.*, n.vec_id from s join n using (label, k)), near as (select p.vec_id, max(p.sim) as sim, arg_max(p.other, p.sim) as nearest from p join t on t.vec_id = p.other and t.keep where p.ok < p.k and p.sim >= 0.1 group by 1)
select t.vec_id, round(case when sim is null then 100 else least(greatest((1 - sim) / 0.9 * 100, 0), 100) end, 2) as value, nearest, round(sim, 4) as similarity, not keep as demoted,
 case when t.k = 1 then 'semantic_anchor' when not keep then 'semantic_scene_limit' else 'semantic_distance' end as reason from t left join near using (vec_id)
union all select vec_id, case when vec_id % 5 = 0 then 50.0 else 100.0 end, null, null, false, case when vec_id % 5 <> 0 then 'protected' end from embeddings where vec_id % 5 = 0 or vec_id % 11 = 0""")
def w21_rerank(spark, d):
    rows = read(spark, d, "embeddings").withColumn("score", F.col("vec_id") % 7)
    out = G.diversity_rerank(rows, by=["label"], key="vec_id", vector="embedding", order=["score"], keep=F.col("vec_id") % 5 != 0, protected=F.col("vec_id") % 11 == 0, alike=0.2, distinct=0.1, cap=2)
    return out.drop("label")


@query("w18_round_robin_pairs", f"""with recursive {_CAND} {_OK}, {_EDGES}, w(n, m) as (select a, a from e union select w.n, e.b from w join e on e.a = w.m), g as (select n as src, min(m) as component from w group by 1),
q as (select src, dst, component, sha256(src || '|' || dst) as digest, row_number() over (order by sha256(src || '|' || dst)) as k from ok join g using (src)),
s(k, used, keep) as (select 0::bigint, []::bigint[], false union all select q.k, case when list_contains(s.used, src) or list_contains(s.used, dst) then s.used else list_concat(s.used, [src, dst]) end, not (list_contains(s.used, src) or list_contains(s.used, dst)) from s join q on q.k = s.k + 1),
t as (select q.*, row_number() over (partition by component order by digest) as turn from q join s using (k) where keep)
select component, turn::integer as turn, case when digest[1] < '8' then src else dst end as "left", case when digest[1] < '8' then dst else src end as "right" from (select * from t order by turn, digest limit 12)""")
def w18(spark, d):
    edges = materialize(confirmed(described(spark, d)))
    parts = G.connected_components(edges).withColumnRenamed("node", "src")
    return G.disjoint_pairs(edges.join(parts, "src"), most=12)


_NBR = "select vec_id, embedding::double[] as a, lead(embedding::double[]) over (order by vec_id) as b from embeddings"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector beside the next of its label."""
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.expr("transform(lead(embedding) over (partition by label order by vec_id), x -> cast(x as double))").alias("b")).where("b is not null")


_NB = "with n as (select vec_id, embedding::double[] as a, lead(embedding::double[]) over (partition by label order by vec_id) as b from embeddings), p as (select * from n where b is not null)"


@query("f8_f9_f10_vector_similarities", f"""{_NB} select vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as cos,
 round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))) / 64, 6) as mae from p""")
def f8(spark, d):
    return neighbours(spark, d).select("vec_id", r6(X.cosine(F.col("a"), F.col("b")), "cos"), r6(X.mean_abs_error(F.col("a"), F.col("b")), "mae"))


@query("f11_exposure_invariant_error", f"""{_NB}, z as (select vec_id, a, b, list_avg(a) as ma, list_avg(b) as mb, greatest(list_stddev_pop(a), 0.05) as sa, greatest(list_stddev_pop(b), 0.05) as sb from p)
select vec_id, round(least(list_sum(list_transform(list_zip(a, b), lambda x: abs(least(greatest((x[1] - ma) / sa, -4), 4) - least(greatest((x[2] - mb) / sb, -4), 4)))) / 64 / 4, 1), 6) as xmae from z""")
def f11(spark, d):
    return neighbours(spark, d).select("vec_id", r6(X.exposure_invariant_error(F.col("a"), F.col("b")), "xmae"))


@query("f3_gradient_signature", """
with c as (select vec_id, i, embedding[i + 1] as v, embedding[i + 2] as w from embeddings, (select unnest(generate_series(0, 62)) as i)) select vec_id, cast(sum(case when w > v then 1::bigint << (55 - (i // 8 * 7 + i % 8)) else 0 end) as bigint) as bits from c where i % 8 < 7 group by 1""")
def f3(spark, d):
    return read(spark, d, "embeddings").select("vec_id", X.bits_to_bigint(X.gradient_bits(F.col("embedding"), 8, 8)).alias("bits"))


_SIGNED = "sum(case when v > m then case when i = 0 then -9223372036854775808::hugeint else 1::hugeint << (63 - i)::integer end else 0 end)::bigint as bits"


@query("f4_median_signature", f"""
with m as (select vec_id, embedding as e, list_median(embedding[2:]::double[]) as m from embeddings), c as (select vec_id, i, e[i + 1]::double as v, m from m, (select unnest(generate_series(0, 63)) as i))
select vec_id, {_SIGNED} from c group by 1""")
def f4_median(spark, d):
    own = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, d, "embeddings").select("vec_id", X.bits_to_bigint(X.median_bits(own)).alias("bits"))


@query("f4_cosine_signature", f"""
with b as (select k, i, (case when k = 0 then sqrt(1 / 8.0) else sqrt(2 / 8.0) end) * cos((2 * i + 1) * k * pi() / 16) as f from (select unnest(generate_series(0, 7)) as k), (select unnest(generate_series(0, 7)) as i)),
c as (select vec_id, j // 8 as y, j % 8 as x, embedding[j + 1]::double as v from embeddings, (select unnest(generate_series(0, 63)) as j)),
t as (select vec_id, b.k as p, x, sum(f * v) as v from c join b on b.i = c.y group by 1, 2, 3), d as (select vec_id, p * 8 + b.k as i, sum(f * v) as v from t join b on b.i = t.x group by 1, 2),
m as (select vec_id, median(v) as m from d where i > 0 group by 1)
select vec_id, {_SIGNED} from d join m using (vec_id) group by 1""")
def f4(spark, d):
    """All 64 components as an 8 by 8 grid."""
    return read(spark, d, "embeddings").select("vec_id", X.bits_to_bigint(X.cosine_bits(F.col("embedding"), 8)).alias("bits"))


@query("f12_haversine", """
with c as (select c_custkey, (c_custkey % 180) - 90.0::double as lat, (c_custkey * 7 % 360) - 180.0::double as lon from customer),
h as (select a.c_custkey, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) as h from c a join c b on b.c_custkey = a.c_custkey + 1)
select c_custkey, round(2 * 6371.0088 * asin(sqrt(least(h, 1.0))), 4) as km from h""")
def f12(spark, d):
    c = read(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") % 180) - 90.0).alias("lat"), ((F.col("c_custkey") * 7 % 360) - 180.0).alias("lon"))
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return c.join(b, "c_custkey").select("c_custkey", F.round(X.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@query("f13_aspect", "select p_partkey, round(abs(p_size::double / greatest(p_retailprice, 1) - p_size::double / 50) / greatest(p_size::double / greatest(p_retailprice, 1), p_size::double / 50, 0.001), 6) as delta from part")
def f13(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(X.aspect_delta(F.col("p_size"), F.col("p_retailprice"), F.col("p_size"), F.lit(50.0)), "delta"))


@query("f16_l11_platt", "select l.doc_id, round(1 / (1 + exp(-least(greatest(0.1 + 1.2 * ln(p / (1 - p)), -20), 20))), 6) as calibrated from (select doc_id, least(greatest((doc_id % 1000) / 1000.0::double, 0.001), 0.999) as p from labels) l")
def f16(spark, d):
    return read(spark, d, "labels").select("doc_id", r6(X.apply_platt((F.col("doc_id") % 1000) / 1000.0, 0.1, 1.2), "calibrated"))


@query("f17_scale_affine", "select l_orderkey, l_linenumber, round_even(least(greatest((l_discount * 10 + 1) / 2, 0), 1) * 100, 0) as score from lineitem")
def f17(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.scale_affine(F.col("l_discount") * 10).alias("score"))


@query("f18_series_score", """select l_orderkey, l_linenumber, round(case when l_linestatus = 'O' then 70.0 when l_linenumber = 1 then 100.0 else least(greatest(65 - 25 * (1 - l_discount) - 100 * l_tax, 0), 100) end, 6) as score from lineitem""")
def f18(spark, d):
    s = X.series_score(F.col("l_linestatus") != "O", F.col("l_linenumber") == 1, 1 - F.col("l_discount"), F.col("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(s, "score"))


@query("a12_disagreement", """
with v as (select l_orderkey, l_linenumber, list_filter([l_quantity, case when l_discount > 0.02 then l_discount * 1000 end, l_tax * 1000], lambda x: x is not null) as v from lineitem)
select l_orderkey, l_linenumber, round(case when len(v) >= 2 then least(list_avg(list_transform(v, lambda x: abs(x - list_median(v)))) / 50, 1.0) end, 6) as disagreement from v""")
def a12(spark, d):
    v = [F.col("l_quantity"), F.when(F.col("l_discount") > 0.02, F.col("l_discount") * 1000), F.col("l_tax") * 1000]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(X.disagreement(v), "disagreement"))
