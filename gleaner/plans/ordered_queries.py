"""Queries over the window, page and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import cells as G
from gleaner.operators import ordered as W
from gleaner.plans.registry import query
from gleaner.sources.tables import read


def micros():
    """Event time as microseconds."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("w1_percentile_rank", """
select o_orderkey, round(case when n = 1 then 0.5 else (le - 1) / (n - 1) end, 6) as pct
from (select o_orderkey, count(o_totalprice) over (partition by o_orderpriority order by o_totalprice range between unbounded preceding and current row) as le,
      count(o_totalprice) over (partition by o_orderpriority) as n from orders)""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return W.percentile_rank(read(spark, d, "orders"), "o_totalprice", by=["o_orderpriority"], out="p").select("o_orderkey", r6(F.col("p"), "pct"))


@query("w2_midrank_percentile", """
select l_orderkey, l_linenumber, round(case when n <= 1 then 50.0 else (below + (equal - 1) / 2.0) / (n - 1) * 100 end, 6) as mid
from (select l_orderkey, l_linenumber, rank() over (partition by l_returnflag order by l_quantity) - 1 as below,
      count(*) over (partition by l_returnflag, l_quantity) as equal, count(*) over (partition by l_returnflag) as n from lineitem)""")
def w2(spark, d):
    return W.midrank_percentile(read(spark, d, "lineitem"), "l_quantity", by=["l_returnflag"], out="m").select("l_orderkey", "l_linenumber", r6(F.col("m"), "mid"))


_RANK = "case when count({c}) over (partition by l_orderkey) = 1 then 0.5 else (count({c}) over (partition by l_orderkey order by {c} range between unbounded preceding and current row) - 1) / (count({c}) over (partition by l_orderkey) - 1) end"


@query("w3_normalize_metrics", f"""
select l_orderkey, l_linenumber, round((a + b + c) / 3, 6) as quality, round(e, 6) as discount_rank from (
select l_orderkey, l_linenumber, {_RANK.format(c='l_quantity')} as a, {_RANK.format(c='l_extendedprice')} as b, {_RANK.format(c='l_tax')} as c, {_RANK.format(c='l_discount')} as e from lineitem)""")
def w3(spark, d):
    out = W.normalize_metrics(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_discount"], by=["l_orderkey"], quality_of=["l_quantity", "l_extendedprice", "l_tax"], bounded=True)
    return out.select("l_orderkey", "l_linenumber", r6(F.col("quality"), "quality"), r6(F.col("l_discount_rank"), "discount_rank"))


@query("w4_named_score_ranks", """
with u as (select p_partkey, p_brand, 'p_retailprice' as name, nullif(p_retailprice, 0) as s from part union all select p_partkey, p_brand, 'p_size', nullif(p_size % 7, 0)::double from part),
r as (select *, case when count(s) over (partition by p_brand, name) = 1 then 0.5 else
 (count(s) over (partition by p_brand, name order by s range between unbounded preceding and current row) - 1) / (count(s) over (partition by p_brand, name) - 1) end as rk from u where s is not null)
select p_partkey, round(max(case when name = 'p_retailprice' then rk end), 6) as price_rank, round(max(case when name = 'p_size' then rk end), 6) as size_rank from r group by 1""")
def w4(spark, d):
    rows = read(spark, d, "part").withColumn("p_size", F.col("p_size") % 7)
    out = W.named_score_ranks(rows, ["p_retailprice", "p_size"], key=["p_partkey"], by=["p_brand"])
    return out.select("p_partkey", r6(F.element_at("ranks", "p_retailprice"), "price_rank"), r6(F.element_at("ranks", "p_size"), "size_rank"))


@query("w5_adaptive_episodes", """
with g as (select event_id, event_type, epoch_us(ts) as t, greatest(epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type order by ts, event_id), 0) / 1e6 as gap from events),
m as (select event_type, median(gap) as med from g where gap > 0 group by 1),
a as (select g.event_type, any_value(med) as med, median(abs(gap - med)) as mad from g join m using (event_type) where gap > 0 group by 1),
l as (select event_type, least(greatest(greatest(300.0, med + greatest(90.0, 6 * mad)), 300.0), 1800.0) as lim from a)
select g.event_id, cast(sum(case when gap > lim then 1 else 0 end) over (partition by g.event_type order by t, g.event_id rows unbounded preceding) as bigint) as episode
from g left join l using (event_type)""")
def w5(spark, d):
    return W.adaptive_episodes(read(spark, d, "events"), micros=micros(), by=["event_type"], order=["t", "event_id"]).select("event_id", "episode")


@query("w6_semantic_scenes", """
with e as (select vec_id, label, embedding::double[] as v, lag(embedding::double[]) over (partition by label order by vec_id) as b from embeddings),
s as (select vec_id, label, case when b is not null then least(greatest(list_dot_product(v, b) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(b, b))), -1.0), 1.0) end as sim from e),
m as (select label, median(sim) as med from s where sim is not null group by 1),
a as (select s.label, any_value(med) as med, median(abs(sim - med)) as mad from s join m using (label) where sim is not null group by 1),
l as (select label, least(greatest(med - greatest(0.025, 1.0 * mad), -1.0), 0.93) as lim from a)
select vec_id, cast(sum(case when sim < lim then 1 else 0 end) over (partition by s.label order by vec_id rows unbounded preceding) as bigint) as scene from s left join l using (label)""")
def w6(spark, d):
    return W.semantic_scenes(read(spark, d, "embeddings"), vector="embedding", by=["label"], order=["vec_id"], low=-1.0, spread=1.0).select("vec_id", "scene")


@query("w7_keyset_page", """
select o_orderkey, o_totalprice from orders where o_totalprice < 300000 or (o_totalprice = 300000 and o_orderkey > 0) order by coalesce(o_totalprice, -1) desc, o_orderkey limit 48""")
def w7(spark, d):
    return W.keyset_page(read(spark, d, "orders"), score="o_totalprice", key="o_orderkey", limit=48, cursor=(300000.0, 0)).select("o_orderkey", "o_totalprice")


@query("w8_next_cursor", """
select o_totalprice as order_score, o_orderkey from (select * from orders order by o_totalprice desc, o_orderkey limit 48) order by o_totalprice, o_orderkey desc limit 1""")
def w8(spark, d):
    page = W.keyset_page(read(spark, d, "orders"), score="o_totalprice", key="o_orderkey", limit=48)
    return W.next_cursor(page, key="o_orderkey", limit=48)


@query("w9_top_k_per_group", """
select l_orderkey, l_linenumber, place, group_size from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as place,
 count(*) over (partition by l_orderkey) as group_size from lineitem) where place <= 3""")
def w9(spark, d):
    return W.top_k(read(spark, d, "lineitem"), by=["l_orderkey"], order="l_extendedprice desc, l_linenumber", k=3).select("l_orderkey", "l_linenumber", F.col("place").cast("bigint").alias("place"), "group_size")


@query("w10_within_group_quality", """
select l_orderkey, l_linenumber, round(75 * r + 25 * coalesce(l_discount * 10, r), 6) as quality, round(1 - r, 6) as blur from (
select l_orderkey, l_linenumber, l_discount, case when count(*) over (partition by l_orderkey) = 1 then 0.5 else
 (count(*) over (partition by l_orderkey order by ln(1 + l_extendedprice) range between unbounded preceding and current row) - 1) / (count(*) over (partition by l_orderkey) - 1) end as r from lineitem)""")
def w10(spark, d):
    rows = read(spark, d, "lineitem").withColumn("m", F.log1p("l_extendedprice"))
    ranked = W.percentile_rank(rows, "m", by=["l_orderkey"], out="r", bounded=True)
    return ranked.select("l_orderkey", "l_linenumber", r6(75 * F.col("r") + 25 * F.coalesce(F.col("l_discount") * 10, F.col("r")), "quality"), r6(1 - F.col("r"), "blur"))


@query("w11_selection_threshold", """
with s as (select o_orderpriority, least(greatest(o_totalprice / 5000, 0.0), 100.0) as s from orders),
n as (select *, row_number() over (partition by o_orderpriority order by s desc) as rn, count(*) over (partition by o_orderpriority) as n from s)
select o_orderpriority, round(s, 6) as threshold from n where rn = greatest(ceil(n * 0.45), 1)""")
def w11(spark, d):
    rows = read(spark, d, "orders").withColumn("s", F.col("o_totalprice") / 5000)
    return W.selection_threshold(rows, by=["o_orderpriority"], score="s", ratio=0.45, default=60.0).select("o_orderpriority", r6(F.col("threshold"), "threshold"))


@query("w12_center_deltas", """
with m as (select l_returnflag, median(l_quantity) as m from lineitem where l_linestatus = 'F' group by 1)
select l_orderkey, l_linenumber, round(case when l_linestatus = 'F' then least(greatest(l_quantity - m, -12.0), 12.0) else 0.0 end, 6) as centered from lineitem left join m using (l_returnflag)""")
def w12(spark, d):
    out = W.center_deltas(read(spark, d, "lineitem"), by=["l_returnflag"], delta="l_quantity", ready=F.col("l_linestatus") == "F")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("centered"), "centered"))


@query("w13_next_attempt", "select c_custkey, cast(coalesce(max(o_orderkey), 0) + 1 as bigint) as next_attempt from customer left join orders on o_custkey = c_custkey group by 1")
def w13(spark, d):
    both = read(spark, d, "customer").join(read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.groupBy("c_custkey").agg((F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).cast("bigint").alias("next_attempt"))


@query("w14_latest_per_key", """
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1""")
def w14(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return W.latest(rows, by=["user_id", "event_type"], order=["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("w15_renumber_top_k", """
select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from (select * from orders where o_orderstatus <> 'P' order by o_totalprice desc, o_orderkey limit 100)""")
def w15(spark, d):
    top = read(spark, d, "orders").where("o_orderstatus <> 'P'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.expr("row_number() over (order by o_totalprice desc, o_orderkey)").cast("bigint").alias("place"))


@query("w16_hash_sample", "select doc_id from documents order by case when n_chars > 20000 then 0 else 1 end, sha256('seed|' || doc_id::varchar) limit 50")
def w16(spark, d):
    return W.hash_sample(read(spark, d, "documents"), key="doc_id", n=50, seed="seed", reserved=F.col("n_chars") > 20000).select("doc_id")


@query("w17_best_sized_group", """
select l_orderkey, n from (select l_orderkey, count(*) as n from lineitem group by 1) where n between 2 and 12 order by abs(n - 6), sha256(l_orderkey::varchar) limit 1""")
def w17(spark, d):
    return W.best_sized_group(read(spark, d, "lineitem"), group="l_orderkey")


@query("w19_recent_sample", """
select event_id from events where event_id not in (select event_id from events where event_type = 'error') order by ts desc, event_id limit 16""")
def w19(spark, d):
    events = read(spark, d, "events")
    out = events.join(events.where("event_type = 'error'").select("event_id"), "event_id", "left_anti")
    return out.orderBy(F.desc("ts"), "event_id").limit(16).select("event_id")


@query("w22_adjacent_pairs", """
select o_custkey, preferred, other from (select o_custkey, o_orderkey as preferred, lead(o_orderkey) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as other from orders) where other is not null""")
def w22(spark, d):
    return W.adjacent_pairs(read(spark, d, "orders"), by=["o_custkey"], key="o_orderkey", order="o_totalprice desc, o_orderkey")


@query("w23_position_coherence", """
with s as (select l_partkey, l_orderkey, l_orderkey - lag(l_orderkey) over (partition by l_partkey order by l_orderkey) as step from lineitem)
select l_partkey, count(*) as n, coalesce(max(step), 0) <= 25 and max(l_orderkey) - min(l_orderkey) <= greatest(50, 5 * count(*)) as coherent from s group by 1""")
def w23(spark, d):
    return W.position_coherence(read(spark, d, "lineitem"), by=["l_partkey"], position="l_orderkey").select("l_partkey", "n", "coherent")


@query("a4_robust_stats", """
with m as (select o_orderpriority, median(o_totalprice) as med from orders group by 1)
select o_orderpriority, round(any_value(med), 6) as med, round(median(abs(o_totalprice - med)), 6) as mad, round(quantile_cont(o_totalprice, 0.05), 6) as p05, round(quantile_cont(o_totalprice, 0.95), 6) as p95
from orders join m using (o_orderpriority) group by 1""")
def a4(spark, d):
    orders, by = read(spark, d, "orders"), ["o_orderpriority"]
    out = W.median_and_deviation(orders, "o_totalprice", by=by).join(W.quantiles(orders, "o_totalprice", by=by, shares=[0.05, 0.95]), by)
    return out.select("o_orderpriority", r6(F.col("med"), "med"), r6(F.col("mad"), "mad"), r6(F.col("q")[0], "p05"), r6(F.col("q")[1], "p95"))


@query("a5_null_aware_weighted_mean", """
select l_orderkey, l_linenumber, round(case when w > 0 then s / w else 0 end, 6) as score from (select l_orderkey, l_linenumber,
 (case when l_discount > 0 then l_discount * 0.5 else 0 end) + (case when l_tax > 0 then l_tax * 0.3 else 0 end) + (case when l_quantity > 10 then l_quantity * 0.2 else 0 end) as s,
 (case when l_discount > 0 then 0.5::double else 0 end) + (case when l_tax > 0 then 0.3::double else 0 end) + (case when l_quantity > 10 then 0.2::double else 0 end) as w from lineitem)""")
def a5(spark, d):
    held = [(F.when(F.col("l_discount") > 0, F.col("l_discount")), 0.5), (F.when(F.col("l_tax") > 0, F.col("l_tax")), 0.3), (F.when(F.col("l_quantity") > 10, F.col("l_quantity")), 0.2)]
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(X.weighted_mean(held), "score"))


@query("a7_value_histogram", """
with b as (select vec_id, least(greatest(cast(floor((unnest(embedding)::double + 1) / 2 * 8) as integer), 0), 7) as bin from embeddings)
select vec_id, bin, round(count(*) / 64.0, 6) as share from b group by 1, 2""")
def a7(spark, d):
    cells = read(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.explode("embedding").alias("x"))
    bins = cells.withColumn("bin", F.least(F.greatest(F.floor((F.col("x").cast("double") + 1) / 2 * 8).cast("int"), F.lit(0)), F.lit(7)))
    return bins.groupBy("vec_id", "bin").agg(r6(F.count("*") / F.first("n"), "share"))


def grids(spark, d):
    """The vectors as grids of 8 by 8 cells: vec_id, x, y, v."""
    cells = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    return cells.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), F.col("f").cast("double").alias("v"))


_GX, _GY = "case when dn is not null then rt - v end", "case when rt is not null then dn - v end"
#: The figures of a grid in SQL, over cells with their neighbours.
_FIGURES = {
    "laplacian_variance": "var_pop(rt + lt + dn + up - 4 * v)", "gradient_energy": "avg((rt - v) * (rt - v) + (dn - v) * (dn - v))", "mean": "avg(v)", "spread": "stddev_pop(v)",
    "dynamic_range": "quantile_cont(v, 0.99) - quantile_cont(v, 0.01)", "edge_density": "avg((sqrt((rt - v) * (rt - v) + (dn - v) * (dn - v)) > 0.08)::int)",
    "coherence": f"case when avg(pow({_GX}, 2)) + avg(pow({_GY}, 2)) > 1e-12 then sqrt(pow(avg(pow({_GX}, 2)) - avg(pow({_GY}, 2)), 2) + 4 * pow(avg(({_GX}) * ({_GY})), 2)) / (avg(pow({_GX}, 2)) + avg(pow({_GY}, 2))) when avg({_GX}) is not null then 0.0 end",
    **{f"p{p:02d}": f"quantile_cont(v, {p / 100})" for p in (1, 5, 50, 95, 99)}, "dark_ratio": "avg((v <= 0.01)::int)", "bright_ratio": "avg((v >= 0.99)::int)",
}
_FIGURES["entropy"] = """coalesce(list_sum(list_transform(map_values(histogram(least(floor(v * 256), 255)) filter (where v between 0 and 1)), lambda c: -(c::double) * log2(c::double))) / nullif(count(*) filter (where v between 0 and 1), 0)
 + log2(nullif(count(*) filter (where v between 0 and 1), 0)), 0)"""


@query("a8_grid_quality", f"""
with c as (select vec_id, u.i - 1 as i, embedding[u.i]::double as v from embeddings, (select unnest(generate_series(1, 64)) as i) u),
n as (select vec_id, v, (i % 8) as x, i // 8 as y, lead(v) over (partition by vec_id, i // 8 order by i % 8) as rt, lag(v) over (partition by vec_id, i // 8 order by i % 8) as lt,
 lead(v) over (partition by vec_id, i % 8 order by i // 8) as dn, lag(v) over (partition by vec_id, i % 8 order by i // 8) as up from c)
select vec_id, {", ".join(f"round({f}, 6) as {c}" for c, f in _FIGURES.items())} from n group by 1""")
def a8(spark, d):
    return G.cell_metrics(grids(spark, d), by=["vec_id"]).select("vec_id", *(r6(F.col(c), c) for c in G.METRICS))


_LINE = "(bin + 0.5) * step + slope * (x - (w - 1) / 2)"


@query("a10_dominant_lines", f"""
with c as (select vec_id // 64 as scene, vec_id % 64 as y, u.i - 1 as x, embedding[u.i]::double as v from embeddings, (select unnest(generate_series(1, 64)) as i) u),
s as (select scene, max(y) as h, max(x) as w, greatest(2.0::double, max(y) / 80) as step from c group by 1),
n as (select c.*, h, w, step, lead(v) over (partition by scene, y order by x) - v as gx, lead(v) over (partition by scene, x order by y) - v as gy from c join s using (scene)),
m as (select *, sqrt(gx * gx + gy * gy) as g from n where gx is not null and gy is not null and y >= floor(h * 0.2::double) and y < greatest(floor(h * 0.8::double), 1)),
l as (select scene, greatest(0.025, quantile_cont(g, 0.75) filter (where g > 1e-6)) as least from m group by 1 having count(*) >= 64 and count(*) filter (where g > 1e-6) >= 32),
t as (select m.*, abs(gy) >= abs(gx) * 0.5 as lv from m join l using (scene) where g >= least),
a as (select scene, count(*) filter (where lv) as n, sum(g) filter (where lv) as weight, coalesce(sum(g) filter (where abs(gx) > abs(gy) * 1.5), 0) as upright from t group by 1),
f as (select t.* from t join a using (scene) where lv and a.n >= 32), p as (select unnest(generate_series(-29, 29, 2)) as angle),
b as (select *, tan(radians(angle)) as slope from f, p), q as (select *, floor((y - slope * (x - (w - 1) / 2)) / step)::int as bin from b),
v as (select scene, angle, bin, sum(g) as votes from q where bin >= 0 and bin < greatest(1, ceil(h / step) + 1) group by 1, 2, 3),
k as (select * from (select *, row_number() over (partition by scene order by votes desc, angle, bin) as r from v) where r = 1),
i as (select scene, count(*) as inliers, count(distinct least(floor(x * 16 / greatest(1, w)), 15)) as cols from (select f.*, k.bin, tan(radians(k.angle)) as slope from f join k using (scene)) where abs(y - ({_LINE})) <= step group by 1),
r as (select scene, count(*) filter (where gap is null or gap > 2) as lines from (select v.scene, v.bin - lag(v.bin) over (partition by v.scene order by v.bin) as gap from v join k on k.scene = v.scene and k.angle = v.angle where v.votes >= k.votes * 0.35) group by 1),
o as (select scene, k.angle, round(cols / 16 * least(1.0, votes / greatest(weight, 1e-9) * 2.5) / (1 + 0.65 * greatest(0, lines - 1)) * greatest(0.25, 1 - upright / greatest(weight + upright, 1e-9)), 4) as support
 from k join i using (scene) join r using (scene) join a using (scene) where inliers >= 24)
select s.scene, case when support >= 0.08 then o.angle::double end as angle, coalesce(support, 0) as support from s left join o using (scene)""")
def a10(spark, d):
    """Each 64 vectors in a row as a grid of 64 by 64 cells."""
    cells = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("scene"), (F.col("vec_id") % 64).alias("y"), F.posexplode("embedding").alias("x", "f"))
    return G.dominant_lines(cells.select("scene", "x", "y", F.col("f").cast("double").alias("v")), by=["scene"])


_MARKS = """with m as (select vec_id, u.r as region, abs(embedding[4 * u.r + 1]::double) * 4 as x0, abs(embedding[4 * u.r + 2]::double) * 4 as y0, abs(embedding[4 * u.r + 3]::double) * 5 as w0, abs(embedding[4 * u.r + 4]::double) * 5 as h0
 from embeddings, (select unnest(generate_series(0, 11)) as r) u),
c as (select vec_id, region, least(1.0, x0) as x, least(1.0, y0) as y, w0, h0 from m where region < 10),
b as (select vec_id, region, x, y, least(1 - x, w0) as w, least(1 - y, h0) as h from c),
e as (select *, w * h as area, greatest(0, round_even((x - w * 0.08::double) * 8, 0)::int) as le, least(8, round_even((x + w + w * 0.08::double) * 8, 0)::int) as ri,
 greatest(0, round_even((1 - y - h - h * 0.08::double) * 8, 0)::int) as tp, least(8, round_even((1 - y + h * 0.08::double) * 8, 0)::int) as bo,
 (x <= 0.012)::int + (y <= 0.012)::int + (x + w >= 0.988)::int + (y + h >= 0.988)::int as contacts from b where w * h >= 0.0025),
k as (select * from e where ri - le >= 3 and bo - tp >= 3),
g as (select vec_id, (u.i - 1) % 8 as x, (u.i - 1) // 8 as y, embedding[u.i]::double as v from embeddings, (select unnest(generate_series(1, 64)) as i) u),
n as (select g.vec_id, region, area, contacts, v, lead(v) over (partition by g.vec_id, region, g.y order by g.x) as rt, lag(v) over (partition by g.vec_id, region, g.y order by g.x) as lt,
 lead(v) over (partition by g.vec_id, region, g.x order by g.y) as dn, lag(v) over (partition by g.vec_id, region, g.x order by g.y) as up from g join k on g.vec_id = k.vec_id and g.x >= le and g.x < ri and g.y >= tp and g.y < bo),
q as (select vec_id, region, any_value(area) as area, sqrt(any_value(area)) as wt, any_value(contacts) as contacts, """ + ", ".join(f"{f} as {c}" for c, f in _FIGURES.items()) + """ from n group by 1, 2)
select vec_id, count(*) as region_count, round(least(1.0, sum(area)), 6) as coverage, round(least(1.0, sum(wt * least(1.0, contacts / 2)) / sum(wt)), 6) as boundary, """


@query("a9_region_quality", _MARKS + ", ".join(f"round(sum(coalesce({c}, 0) * wt) / sum(wt), 6) as {c}" for c in G.METRICS) + " from q group by 1")
def a9(spark, d):
    share = lambda i, by: (F.abs(F.get("embedding", F.col("region") * 4 + i).cast("double")) * by)
    marks = read(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("region"))
    marks = marks.select("vec_id", "region", share(0, 4).alias("x"), share(1, 4).alias("y"), share(2, 5).alias("w"), share(3, 5).alias("h"))
    out = G.region_metrics(grids(spark, d), marks, key="vec_id", cols=8, rows=8, least=3)
    return out.select("vec_id", "region_count", *(r6(F.col(c), c) for c in ["coverage", "boundary", *G.METRICS]))
