"""Queries over inventories, projections, views, set operations, summaries, images of cells and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import relational as T
from gleaner.plans.ordered_queries import r6
from gleaner.plans.registry import query
from gleaner.sources import inventory as S
from gleaner.sources.tables import materialize, read, shared_folder

C = F.col


@query("s1_read_inventory", "select event_id, event_type, value from events where value is not null")
def s1(spark, d):
    return S.read_inventory(spark, f"{d}/events.parquet", "parquet", "event_id long, event_type string, value double").where("value is not null")


@query("s2_manifest_round_trip", "select source as album, doc_id, lang from documents")
def s2(spark, d):
    path = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    S.write_manifests(read(spark, d, "documents").select("source", "doc_id", "lang"), path, album="source")
    return S.read_manifests(spark, path, "doc_id long, lang string")


@query("s4_fingerprint_texts", "select page_id, sha256(html) as content_sha256, sha256(sha256(html) || '|' || strlen(html)::varchar || '|v1') as fingerprint from pages")
def s4(spark, d):
    digest = F.sha2(C("html").cast("binary"), 256)
    return read(spark, d, "pages").select("page_id", digest.alias("content_sha256"), F.sha2(F.concat_ws("|", digest, F.octet_length("html").cast("string"), F.lit("v1")).cast("binary"), 256).alias("fingerprint"))


@query("s5_take_snapshot", """
with r as (select o_orderpriority, substr(md5(o_orderkey::varchar), 1, 3) as bucket, sha256(concat_ws('|', o_orderkey, o_orderkey, o_custkey, o_orderstatus)) as item from orders),
b as (select o_orderpriority, bucket, count(*) as n, sha256(string_agg(item, ',' order by item)) as digest from r group by 1, 2)
select o_orderpriority, sum(n)::bigint as items, sha256(string_agg(bucket || ':' || digest, ',' order by bucket || ':' || digest)) as membership from b group by 1""")
def s5(spark, d):
    return S.take_snapshot(read(spark, d, "orders"), by="o_orderpriority", order="o_orderkey", row=["o_orderkey", "o_custkey", "o_orderstatus"])


@query("s6_latest_snapshot", "select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def s6(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_INCOMING = "select c_custkey, case when c_custkey % 9 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal, c_mktsegment from customer where c_custkey % 7 <> 0"


def _sides(spark, d):
    base = read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = base.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(C("c_custkey") % 9 == 0, C("c_acctbal") + 1).otherwise(C("c_acctbal")))
    return base.where("c_custkey % 5 <> 0"), new


@query("s7_merge_inventory", f"""with n as ({_INCOMING}), c as (select c_custkey, c_acctbal, c_mktsegment from customer where c_custkey % 5 <> 0)
select coalesce(n.c_custkey, c.c_custkey) as c_custkey, case when n.c_custkey is null then c.c_acctbal else n.c_acctbal end as c_acctbal, case when n.c_custkey is null then c.c_mktsegment else n.c_mktsegment end as c_mktsegment,
n.c_custkey is null as inactive, n.c_custkey is null or c.c_custkey is null or n.c_acctbal is distinct from c.c_acctbal or n.c_mktsegment is distinct from c.c_mktsegment as changed from c full join n on c.c_custkey = n.c_custkey""")
def s7(spark, d):
    return S.merge_inventory(*_sides(spark, d), key="c_custkey", fields=["c_acctbal", "c_mktsegment"])


@query("s8_invalidate_groups", "select l_orderkey, l_partkey from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_partkey in (select p_partkey from part where p_size > 45))")
def s8(spark, d):
    changed = read(spark, d, "part").where("p_size > 45").select(C("p_partkey").alias("l_partkey"))
    return S.invalidate_groups(read(spark, d, "lineitem").select("l_orderkey", "l_partkey"), changed, key="l_partkey", group="l_orderkey")


@query("s9_upsert_latest", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1")
def s9(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return S.upsert_latest(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 <> 0"), key=["user_id", "event_type"], order=["ts", "event_id"]).drop("ts")


@query("s10_replace_partitions", "select doc_id, source, lang from documents where not (source = 'src1' and doc_id % 2 = 0)")
def s10(spark, d):
    import uuid

    path = f"{shared_folder(spark)}/partitions-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").select("doc_id", "lang", "source")
    S.replace_partitions(docs, path, by=["source"])
    S.replace_partitions(docs.where("source = 'src1' and doc_id % 2 <> 0"), path, by=["source"])
    return spark.read.parquet(path).select("doc_id", C("source").cast("string").alias("source"), "lang")


@query("s11_t5_insert_new", "select c_custkey, c_acctbal from customer where c_custkey % 5 <> 0 union all select c_custkey, case when c_custkey % 9 = 0 then c_acctbal + 1 else c_acctbal end from customer where c_custkey % 7 <> 0 and c_custkey % 5 = 0")
def s11(spark, d):
    base, new = _sides(spark, d)
    return S.insert_new(base.drop("c_mktsegment"), new.drop("c_mktsegment"), key=["c_custkey"])


@query("s12_export_import", "select vec_id, label from embeddings where vec_id % 3 <> 0")
def s12(spark, d):
    import uuid

    rows = read(spark, d, "embeddings").select("vec_id", "label")
    rows.write.parquet(path := f"{shared_folder(spark)}/export-{uuid.uuid4().hex}")
    return S.import_rows(spark, rows.where("vec_id % 3 = 0"), path, key=["vec_id"], known=rows, known_key="vec_id")


@query("s12_corpus_import", """
with b as (select doc_id as id, 'd' || doc_id as key from documents where doc_id % 3 <> 0), x as (select 'd' || doc_id as key from documents where doc_id % 2 = 0), m as (select max(id) as last from b),
n as (select (select last from m) + row_number() over (order by key) as id, key from x where key not in (select key from b)), a as (select * from b union all select * from n),
l as (select doc_id, quality from labels), q as (select min(id) as id, lo, hi from (select doc_id as id, doc_id as lo, doc_id + 3 as hi from documents where doc_id % 3 <> 0 and doc_id % 5 = 0 and doc_id + 3 in (select doc_id from documents)) group by lo, hi),
p as (select least(u.id, v.id) as lo, greatest(u.id, v.id) as hi from documents d join a u on u.key = 'd' || d.doc_id join a v on v.key = 'd' || (d.doc_id + 2) where d.doc_id % 2 = 0 and d.doc_id % 3 = 0 and d.doc_id + 2 in (select doc_id from documents)),
w as (select coalesce((select max(id) from q), 0) + row_number() over (order by lo, hi) as id, lo, hi from p where (lo, hi) not in (select lo, hi from q))
select 'items' as kind, id, key as text, null::double as value from a
union all select 'labels', a.id, a.key, quality::double from l join a on a.key = 'd' || l.doc_id where l.doc_id % 3 <> 0 or l.doc_id % 2 = 0
union all select 'pairs', id, lo || '|' || hi, null from (select * from q union all select * from w)""")
def s12_import(spark, d):
    """A corpus of two thirds of the documents takes in an exported one of every second document, under ids of its own."""
    from gleaner.sources import corpus as K

    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), C("doc_id").cast("string")).alias("key"))
    quality = read(spark, d, "labels").select("doc_id", C("quality").cast("double").alias("value"))

    def corpus(own, ids, step, every):
        """The documents ``own`` as a corpus with ``ids``, and pairs of each ``every``-th of a third with the one ``step`` further."""
        there = docs.where(own).withColumn("id", ids)
        far = docs.select((C("doc_id") - step).alias("doc_id")).join(docs.where(own).select((C("doc_id") - step).alias("doc_id")), "doc_id")
        pairs = docs.where(own & every).join(far, "doc_id").select(ids.alias("id"), ids.alias("left_id"))
        shift = docs.where(own & every).join(far, "doc_id").select(ids.alias("left_id"), F.expr(step_sql(ids_sql[step], step)).alias("right_id"))
        pairs = pairs.join(shift, "left_id").select("id", "left_id", "right_id", C("left_id").alias("preferred_id"))
        return {
            "items": there.select("id", "key", F.lit("calibration").alias("split")), "vectors": there.select(C("id").alias("item_id"), F.lit("v1").alias("space"), F.lit(2).alias("size"), F.unhex(F.lit("0000803f00000040")).alias("data")),
            "labels": there.join(quality, "doc_id").select(C("id").alias("item_id"), F.lit("quality").alias("name"), "value"), "pairs": pairs,
            "rounds": pairs.select("id", F.concat(F.lit("r"), C("left_id").cast("string")).alias("key"), C("id").alias("pair_id")),
        }

    ids_sql = {3: "doc_id", 2: "doc_id * 10 + 7"}
    step_sql = lambda e, step: e.replace("doc_id", f"(doc_id + {step})")
    base = corpus(C("doc_id") % 3 != 0, F.expr(ids_sql[3]), 3, C("doc_id") % 5 == 0)
    other = corpus(C("doc_id") % 2 == 0, F.expr(ids_sql[2]), 2, C("doc_id") % 3 == 0)
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    K.export_corpus(other, path)
    merged, _ = K.import_corpus(base, K.read_corpus(spark, path))
    items, none = merged["items"], F.lit(None).cast("double")
    labels = merged["labels"].join(items.select(C("id").alias("item_id"), "key"), "item_id")
    out = items.select(F.lit("items").alias("kind"), "id", C("key").alias("text"), none.alias("value")).unionByName(labels.select(F.lit("labels").alias("kind"), C("item_id").alias("id"), C("key").alias("text"), "value"))
    ends = F.concat_ws("|", F.least("left_id", "right_id").cast("string"), F.greatest("left_id", "right_id").cast("string"))
    return out.unionByName(merged["pairs"].select(F.lit("pairs").alias("kind"), "id", ends.alias("text"), none.alias("value")))


@query("s13_export_scores", "select doc_id, quality::double as score, 'labels' as engine, '1' as version from labels")
def s13(spark, d):
    return S.export_scores(read(spark, d, "labels"), key="doc_id", score="quality", engine="labels", version="1")


@query("s14_pending_work", """
with s as (select doc_id, 'quality' as kind, case when quality = 1 then 'ready' else 'error' end as status, '2' as version from labels), w as (select doc_id, kind, version from documents, (values ('quality', '2'), ('toxic', '1')) k(kind, version))
select w.doc_id, w.kind from w left join s on s.doc_id = w.doc_id and s.kind = w.kind where not coalesce(s.status = 'ready' and s.version = w.version, false)""")
def s14(spark, d):
    signals = read(spark, d, "labels").select("doc_id", F.lit("quality").alias("kind"), F.when(C("quality") == 1, "ready").otherwise("error").alias("status"), F.lit("2").alias("version"), C("doc_id").cast("string").alias("fingerprint"))
    assets = read(spark, d, "documents").select("doc_id", C("doc_id").cast("string").alias("fp"))
    return S.pending_work(assets, signals, {"quality": "2", "toxic": "1"}, key="doc_id", fingerprint="fp")


@query("p1_normalize_media", "select event_id, case when event_type in ('image', 'photo', 'picture') then 'image' when event_type in ('video', 'movie', 'clip') then 'video' when value > 10 then 'image' else 'video' end as kind from events")
def p1(spark, d):
    return read(spark, d, "events").select("event_id", T.normalize_media(C("event_type"), F.coalesce(C("value") > 10, F.lit(False))).alias("kind"))


@query("p2_eligible", "select doc_id from documents where text is not null and n_chars > 0 and lang in ('en', 'de')")
def p2(spark, d):
    return read(spark, d, "documents").where("text is not null and n_chars > 0 and lang in ('en', 'de')").select("doc_id")


@query("p3_revision_fingerprint", "select c_custkey, coalesce(case when c_custkey % 4 = 0 then 'r' || c_custkey::varchar end, sha256(c_name || '|' || c_nationkey::varchar || '|' || c_mktsegment)) as revision from customer")
def p3(spark, d):
    explicit = F.when(C("c_custkey") % 4 == 0, F.concat(F.lit("r"), C("c_custkey").cast("string")))
    return read(spark, d, "customer").select("c_custkey", T.revision_fingerprint(explicit, [C("c_name"), C("c_nationkey"), C("c_mktsegment")]).alias("revision"))


@query("p4_resolve_source", "select page_id, case when page_id % 5 = 0 then url || '#e' when page_id % 3 = 0 then 'big' else url end as path, case when page_id % 5 = 0 then 'edited' when page_id % 3 = 0 then 'derivative' else 'original' end as code from pages")
def p4(spark, d):
    made = F.array(F.struct(F.lit(1).alias("size"), F.lit("small").alias("path")), F.struct(F.lit(9).alias("size"), F.lit("big").alias("path")))
    s = T.resolve_source(F.when(C("page_id") % 5 == 0, F.concat("url", F.lit("#e"))), F.when(C("page_id") % 3 == 0, made), C("url"))
    return read(spark, d, "pages").select("page_id", s["path"].alias("path"), s["code"].alias("code"))


@query("p5_resolution_gate", "select p_partkey, case when least(p_size * 20, 400) >= 256 and greatest(p_size * 20, 400) >= 512 then 'ready' else 'degraded' end as state from part")
def p5(spark, d):
    return read(spark, d, "part").select("p_partkey", T.resolution_gate(C("p_size") * 20, F.lit(400))["state"].alias("state"))


@query("p6_burst_key", "select c_custkey, case when c_mktsegment = 'BUILDING' then null else c_mktsegment end as burst from customer")
def p6(spark, d):
    raw = F.when(C("c_mktsegment") == "BUILDING", F.lit(" None ")).otherwise(C("c_mktsegment"))
    return read(spark, d, "customer").select("c_custkey", T.normalize_burst_key(raw).alias("burst"))


@query("p7_external_flags", "select o_orderkey, array_to_string(list_sort(list_distinct(list_filter([o_orderstatus, case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' end], lambda x: x is not null))), ',') as flags from orders")
def p7(spark, d):
    f = T.merge_external_flags(F.array("o_orderstatus"), F.array("o_orderpriority"), {"1-URGENT": "urgent", "2-HIGH": "high"})
    return read(spark, d, "orders").select("o_orderkey", F.array_join(f, ",").alias("flags"))


@query("p9_selection_filter", "select o_orderpriority, count(*) as n from orders where o_orderstatus <> 'F' group by 1")
def p9(spark, d):
    from gleaner.operators.rules import effective_category

    c = effective_category(F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(C("o_orderstatus") == "F", "reject"))
    return read(spark, d, "orders").where(c == "keep").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("p10_decode_json", "select event_id, coalesce(try_cast(props as json) is not null and json_type(try_cast(props as json)) = 'OBJECT', false) as known from events")
def p10(spark, d):
    parsed = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return read(spark, d, "events").select("event_id", parsed.isNotNull().alias("known"))


@query("p10_typed_fields", """
with e as (select event_id, case when event_id % 17 = 0 then left(props, 4) else props end as props from events), j as (select event_id, try_cast(props as json) as j from e)
select event_id, try_cast(j ->> '$.k' as bigint) as k, coalesce(len(json_keys(j)), 0)::integer as n_fields, coalesce(json_array_length(j -> '$.tags'), 0)::integer as n_tags, coalesce(try_cast(j ->> '$.k' as bigint) > 50, false) as large from j""")
def p10_fields(spark, d):
    """Every seventeenth text is cut off: broken text has empty values."""
    props = F.when(C("event_id") % 17 == 0, F.substring("props", 1, 4)).otherwise(C("props"))
    own = X.decode_fields(props, {"k": "bigint", "tags": "array<string>"}, whole="map<string,string>")
    rows = read(spark, d, "events").select("event_id", own.alias("f"))
    return rows.select("event_id", "f.k", F.size("f.whole").alias("n_fields"), F.size("f.tags").alias("n_tags"), F.coalesce(F.col("f.k") > 50, F.lit(False)).alias("large"))


@query("j13_snapshot_drift", """
with p as (select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders where o_orderkey % 997 <> 1), c as (select o_orderkey, o_custkey, case when o_orderkey % 1009 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderstatus from orders where o_orderkey % 991 <> 2)
select coalesce(p.o_orderkey, c.o_orderkey) as o_orderkey, case when c.o_orderkey is null then 'missing' when p.o_orderkey is null then 'extra' else 'changed:o_totalprice' end as reasons
from p full join c on p.o_orderkey = c.o_orderkey where c.o_orderkey is null or p.o_orderkey is null or p.o_totalprice <> c.o_totalprice""")
def j13_snapshots(spark, d):
    """Two snapshots of the orders, of which a few rows were added, dropped and changed."""
    import uuid

    from gleaner.sources import digests

    fields = ["o_custkey", "o_totalprice", "o_orderstatus"]
    orders = read(spark, d, "orders").select("o_orderkey", *fields)
    now = orders.where("o_orderkey % 991 <> 2").withColumn("o_totalprice", F.when(C("o_orderkey") % 1009 == 0, C("o_totalprice") + 1).otherwise(C("o_totalprice")))
    base = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    depth = digests.depth_for(orders.count())
    digests.write_snapshot(orders.where("o_orderkey % 997 <> 1"), f"{base}/old", key="o_orderkey", fields=fields, depth=depth)
    digests.write_snapshot(now, f"{base}/new", key="o_orderkey", fields=fields, depth=depth)
    schema = ", ".join(f"{c} {kind}" for c, kind in orders.dtypes)
    out = digests.snapshot_drift(spark, f"{base}/old", f"{base}/new", key="o_orderkey", fields=fields, schema=schema)
    return out.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("u7_sketch_rollup", """select event_type, count(*) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most, true as median_holds, true as users_hold from events group by 1""")
def u7(spark, d):
    """Daily sketches rolled up to event types; the estimates are held against the exact figures."""
    from gleaner.operators import sketches as K

    events = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = materialize(K.sketched(events, by=["event_type", "day"], value="value", item="user_id"))
    whole = K.rolled_up(daily, by=["event_type"])
    told = K.robust_stats(whole, by=["event_type"]).select("event_type", "med", "items")
    exact = events.join(told, "event_type").groupBy("event_type").agg((F.count_if(C("value") <= C("med")) / F.count("value")).alias("below"), F.count_distinct("user_id").alias("users"), F.first("items").alias("items"))
    held = exact.select("event_type", (F.abs(C("below") - 0.5) <= 0.02).alias("median_holds"), (F.abs(C("items") - C("users")) <= 0.03 * C("users")).alias("users_hold"))
    return whole.join(held, "event_type").select("event_type", "n", F.round("total", 4).alias("total"), "least", "most", "median_holds", "users_hold")


@query("p11_cards", """
select o_orderkey, to_json({'o_orderkey': o_orderkey, 'o_custkey': o_custkey, 'o_orderstatus': o_orderstatus, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g'), 'o_orderpriority': o_orderpriority})::varchar as card from orders""")
def p11(spark, d):
    return T.card(read(spark, d, "orders"), key="o_orderkey", heavy=["o_totalprice"])


@query("p12_blind_projection", "select doc_id, text from documents")
def p12(spark, d):
    return T.blind(read(spark, d, "documents"), ["doc_id", "text", "score"])


@query("p13_lookup", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def p13(spark, d):
    keys = read(spark, d, "orders").where("o_totalprice > 300000").select(C("o_custkey").alias("c_custkey"))
    return T.lookup(read(spark, d, "customer"), keys, key="c_custkey").select("c_custkey", "c_name")


@query("p14_pseudonymize", "select c_custkey, sha256('asset|' || c_mktsegment || '|' || c_custkey::varchar) as pseudonym from customer")
def p14(spark, d):
    from gleaner.functions.expressions import pseudonym

    return read(spark, d, "customer").select("c_custkey", pseudonym(F.lit("asset"), C("c_mktsegment"), C("c_custkey")).alias("pseudonym"))


@query("j1_asset_view", """select l_orderkey, l_linenumber, l_quantity, o_orderstatus, c_name, n_name, r_name, s_name, p_brand from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey left join supplier on s_suppkey = l_suppkey left join part on p_partkey = l_partkey""")
def j1(spark, d):
    t = lambda n: read(spark, d, n)
    out = t("lineitem").join(t("orders"), C("o_orderkey") == C("l_orderkey"), "left").join(t("customer"), C("c_custkey") == C("o_custkey"), "left")
    out = out.join(t("nation"), C("n_nationkey") == C("c_nationkey"), "left").join(t("region"), C("r_regionkey") == C("n_regionkey"), "left")
    out = out.join(t("supplier"), C("s_suppkey") == C("l_suppkey"), "left").join(t("part"), C("p_partkey") == C("l_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "o_orderstatus", "c_name", "n_name", "r_name", "s_name", "p_brand")


@query("j2_label_view", "select d.doc_id, d.source, l.quality from documents d left join labels l on l.doc_id = d.doc_id")
def j2(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j4_series_members", "select l_orderkey, l_linenumber, l_shipdate from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'O' and l_linestatus = 'O' order by l_orderkey, l_shipdate, l_linenumber")
def j4(spark, d):
    both = read(spark, d, "lineitem").where("l_linestatus = 'O'").join(read(spark, d, "orders").where("o_orderstatus = 'O'"), C("o_orderkey") == C("l_orderkey"))
    return both.orderBy("l_orderkey", "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "l_shipdate")


@query("j5_exists_filter", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.09)")
def j5(spark, d):
    return T.exists_filter(read(spark, d, "orders"), read(spark, d, "lineitem").where("l_discount > 0.09"), key="o_orderkey", other_key="l_orderkey").select("o_orderkey")


@query("j6_exclude_pairs", "select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def j6(spark, d):
    return T.exclude(read(spark, d, "documents"), read(spark, d, "labels").where("toxic = 1"), on=["doc_id"]).select("doc_id")


@query("j19_t2_intersect", "select l_orderkey from lineitem where l_discount > 0.08 intersect select l_orderkey from lineitem where l_tax > 0.06")
def j19(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.where("l_discount > 0.08").select("l_orderkey").intersect(rows.where("l_tax > 0.06").select("l_orderkey"))


@query("t1_union_distinct", "select l_orderkey as k from lineitem where l_discount > 0.09 union select o_orderkey from orders where o_totalprice > 250000")
def t1(spark, d):
    a = read(spark, d, "lineitem").where("l_discount > 0.09").select(C("l_orderkey").alias("k"))
    return a.union(read(spark, d, "orders").where("o_totalprice > 250000").select("o_orderkey")).distinct()


@query("t3_symmetric_difference", "(select doc_id from documents except select doc_id from labels) union all (select doc_id + 1 from labels except select doc_id from documents)")
def t3(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return docs.subtract(labels).union(labels.select(C("doc_id") + 1).subtract(docs))


@query("t4_subset_checks", "select l_orderkey, bool_and(l_linenumber <= 7) as subset, not bool_or(l_returnflag = 'R') or not bool_or(l_returnflag = 'A') as disjoint from lineitem group by 1")
def t4(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("n"), F.collect_set(F.when(C("l_returnflag") == "R", "x")).alias("r"), F.collect_set(F.when(C("l_returnflag") == "A", "x")).alias("a"))
    return g.select("l_orderkey", (F.size(F.array_except("n", F.array(*map(F.lit, range(1, 8))))) == 0).alias("subset"), (~F.arrays_overlap("r", "a")).alias("disjoint"))


@query("t6_t7_ordered_listing", "select o_orderkey, o_orderstatus from orders order by case o_orderstatus when 'O' then 0 when 'P' then 1 else 2 end, o_totalprice desc, o_orderkey limit 40 offset 20")
def t6(spark, d):
    rank = F.when(C("o_orderstatus") == "O", 0).when(C("o_orderstatus") == "P", 1).otherwise(2)
    return read(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").offset(20).limit(40).select("o_orderkey", "o_orderstatus")


@query("a1_project_summary", "select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_totalprice > 200000) as large, count(distinct o_custkey) as \"distinct\" from orders group by 1")
def a1(spark, d):
    return T.summary(read(spark, d, "orders"), by=["o_orderpriority"], flags={"done": C("o_orderstatus") == "F", "large": C("o_totalprice") > 200000}, distinct="o_custkey")


@query("a2_publish_summary", "select count(*) filter (where o_orderstatus = 'O') as open, count(*) filter (where o_orderstatus = 'F') as done, count(*) filter (where o_orderstatus = 'P') as partial, count(*) filter (where o_totalprice is null) as unpriced from orders")
def a2(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    return read(spark, d, "orders").agg(n(C("o_orderstatus") == "O", "open"), n(C("o_orderstatus") == "F", "done"), n(C("o_orderstatus") == "P", "partial"), n(C("o_totalprice").isNull(), "unpriced"))


@query("a3_count_filtered", "select count(*) as n from orders where o_orderstatus = 'O' and o_totalprice > 100000")
def a3(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice > 100000").agg(F.count("*").alias("n"))


@query("a6_learning_status", "select quality, count(*) filter (where toxic = 0) as clean, count(*) filter (where toxic = 1) as toxic from labels group by 1")
def a6(spark, d):
    return read(spark, d, "labels").groupBy("quality").pivot("toxic", [0, 1]).count().select("quality", F.coalesce("0", F.lit(0)).cast("bigint").alias("clean"), F.coalesce("1", F.lit(0)).cast("bigint").alias("toxic"))


@query("a11_component_mean", "select l_orderkey, l_linenumber, round((l_discount + l_tax) / 2 * 100, 6) as score from lineitem")
def a11(spark, d):
    from gleaner.functions.expressions import component_mean

    scores = F.create_map(F.lit("d"), C("l_discount"), F.lit("t"), C("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(component_mean(scores, ["d", "t", "none"]), "score"))


@query("a13_scale_guard", "select l_orderkey, count(*) filter (where abs(l_quantity - l_linenumber * 7) > 35) as far, max(l_quantity) <= 14 as collapsed from lineitem group by 1")
def a13(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.abs(C("l_quantity") - C("l_linenumber") * 7) > 35).alias("far"), (F.max("l_quantity") <= 14).alias("collapsed"))


@query("a14_rollup", "select o_orderpriority, o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by rollup (o_orderpriority, o_orderstatus)")
def a14(spark, d):
    return read(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("u2_score_model", "select doc_id, n_chars % 100 / 100.0::double as score, 'ready' as status from documents")
def u2(spark, d):
    from gleaner.sources.images import score_model

    return score_model(read(spark, d, "documents").select("doc_id", "n_chars"), lambda: lambda b: b["n_chars"] % 100 / 100.0, key="doc_id", engine="demo", version="1").select("doc_id", "score", "status")


@query("u3_f15_vector_codec", "select vec_id, len(embedding) as n from embeddings")
def u3(spark, d):
    from gleaner.functions.vectors import decode_vector, encode_vector

    coded = read(spark, d, "embeddings").select("vec_id", "embedding", encode_vector("embedding").alias("base64"))
    same = coded.withColumn("back", decode_vector("base64")).where(C("back") == C("embedding"))
    return same.select("vec_id", F.size("back").cast("bigint").alias("n"))


@query("r20_curate")
def r20(spark, d):
    from gleaner.plans.curate import curate

    return curate(read(spark, d, "lineitem").where("l_linenumber <= 7"))


@query("r21_scene_tree")
def r21(spark, d):
    from gleaner.plans.curate import scene_tree

    return scene_tree(read(spark, d, "embeddings"))


def _replay(spark, d, keep):
    """The events as a stream of one table, run to its end into a written table."""
    import uuid

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    read(spark, d, "events").withColumn("ts", C("ts").cast("timestamp")).write.parquet(f"{base}/in")
    events = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    out, mode = keep(events)
    if mode == "update":
        # A batch that is repeated replaces itself.
        done = out.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).outputMode("update")
    else:
        done = out.writeStream.format("parquet").option("path", f"{base}/out").outputMode(mode)
    done.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("st1_latest_decisions", "select user_id, max(event_id) as generation, arg_max(event_type, event_id) as decision from events group by 1")
def st1(spark, d):
    from gleaner.streaming.streams import latest_decisions

    out = _replay(spark, d, lambda e: (latest_decisions(e, key="user_id", generation="event_id", value="event_type"), "update"))
    return out.groupBy("user_id").agg(F.max("generation").alias("generation"), F.max_by("decision", "generation").alias("decision"))


@query("st2_exact_dedup", "select count(distinct event_type || user_id::varchar) as n from events")
def st2(spark, d):
    from gleaner.streaming.streams import exact_dedup

    out = _replay(spark, d, lambda e: (exact_dedup(e.withColumn("content", F.concat("event_type", C("user_id").cast("string"))), time="ts", content="content", delay="400 days"), "append"))
    return out.agg(F.count("*").alias("n"))


@query("st3_interval_pairs", """select a.event_type, least(a.event_id, b.event_id) as src, greatest(a.event_id, b.event_id) as dst from events a join events b on a.event_type = b.event_type
 and epoch_us(b.ts) between epoch_us(a.ts) and epoch_us(a.ts) + 120000000 and (b.ts > a.ts or a.event_id < b.event_id) and a.event_id <> b.event_id""")
def st3(spark, d):
    from gleaner.streaming.streams import interval_pairs

    return _replay(spark, d, lambda e: (interval_pairs(e, time="ts", key="event_id", by="event_type", seconds=120, delay="400 days"), "append"))


@query("st4_episodes", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as n from events), s as (select *, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, count(*) as n from s group by user_id, k""")
def st4(spark, d):
    from gleaner.streaming.streams import episodes

    batch = episodes(read(spark, d, "events").withColumn("ts", C("ts").cast("timestamp")), time="ts", by="user_id", gap="6 hours", delay="0 seconds")
    return batch.select("user_id", "n")


@query("st4_adaptive_episodes", """
with b as (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events), a as (select user_id, epoch_us(ts) as t, event_id % 50 = 0 and epoch_us(ts) < lo + (hi - lo) // 3 - 172800000000 as late from events, b), e as (select user_id, t from a where not late),
g as (select user_id, t, case when t - lag(t) over (partition by user_id order by t) <= (user_id % 4 + 2) * 3600000000 then 0 else 1 end as n from e), s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) as k from g)
select user_id, min(t) as first, max(t) as last, count(*) as n, 0::bigint as late from s group by user_id, k union all select user_id, null, null, 0, count(*) from a where late group by user_id""")
def st4_adaptive(spark, d):
    """The events as a stream of three files; some of the first third's come days late, in the second file, and are dropped."""
    from gleaner.streaming import streams

    events = read(spark, d, "events").select("event_id", "user_id", C("ts").cast("timestamp").alias("ts"))
    t = F.unix_micros("ts")
    lo, hi = events.agg(F.min(t), F.max(t)).first()
    third = (hi - lo) // 3
    late = (C("event_id") % 50 == 0) & (t < lo + third - 172_800_000_000)
    turn = F.when(late, 1).otherwise(F.least(F.floor((t - lo) / third), F.lit(2)))
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A row of no user, a year on, lets the watermark pass all others.
    end = events.limit(1).select(C("event_id"), F.lit(-1).cast("long").alias("user_id"), F.timestamp_micros(F.lit(hi + 31_536_000_000_000)).alias("ts"))
    for k in range(3):
        part = events.where(turn == k)
        (part if k < 2 else part.unionByName(end)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    limits = events.select("user_id").distinct().withColumn("seconds", (C("user_id") % 4 + 2) * 3600)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = streams.adaptive_episodes(stream, materialize(limits), time="ts", by="user_id", delay="1 hour")
    with streams.timed_state(spark):
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n", "late")


@query("st5_pending", "select event_id from events where user_id not in (select distinct user_id from events where event_type = 'purchase' and user_id % 2 = 0)")
def st5(spark, d):
    from gleaner.streaming.streams import pending

    signals = read(spark, d, "events").where("event_type = 'purchase' and user_id % 2 = 0").select("user_id", F.lit("ready").alias("status"), F.lit("1").alias("version"))
    return _replay(spark, d, lambda e: (pending(e, materialize(signals), key="user_id", version="1").select("event_id"), "append"))


@query("st6_window_summary", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type, time_bucket(interval 1 day, ts, timestamp '1970-01-01')")
def st6(spark, d):
    from gleaner.streaming.streams import window_summary

    out = _replay(spark, d, lambda e: (window_summary(e, time="ts", by="event_type", value="value", width="1 day", delay="0 seconds"), "update"))
    last = out.groupBy("start", "event_type").agg(F.max_by("n", "n").alias("n"), F.max_by("total", "n").alias("total"))
    return last.select("event_type", "n", F.round("total", 4).alias("total"))
