"""Grouping of verified pairs: components, leaders without chains, descriptions and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.sources.tables import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over (src, dst) edges; hash-to-min with two-step stars."""
    e = materialize(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = materialize(e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct())
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(roots)


#: Rounds of :func:`first_independent` before chains are followed.
PLAIN_ROUNDS = 3


def first_independent(ranks: DataFrame, edges: DataFrame) -> DataFrame:
    """(n, leads) of every node (n, r) with an edge (n, m): the first maximal independent set by ascending unique rank.

    A node leads unless an earlier neighbour does. Each round settles the nodes without an open earlier neighbour and
    those beside a leader; they and their edges leave. What has a single open earlier neighbour is its opposite: such
    chains are followed by doubled pointers, so that a chain takes as many steps as its length has digits.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("n", "m").where("n <> m").distinct()
    nodes = materialize(both.select("n").distinct())
    # Only edges to earlier neighbours decide.
    e = materialize(both.join(ranks, "n").join(ranks.select(F.col("n").alias("m"), F.col("r").alias("rm")), "m").where("rm < r").select("n", "m"))
    left, parts = nodes, []

    def settle(known: DataFrame) -> None:
        """Settle the ``known`` and what stands beside a leader among them; all of these and their edges leave."""
        nonlocal left, e
        led = known.where("leads").select(F.col("n").alias("m"))
        beside = e.join(led, "m", "left_semi").select("n").distinct().join(known, "n", "left_anti").withColumn("leads", F.lit(False))
        new = materialize(known.unionByName(beside))
        parts.append(new)
        gone = new.select("n")
        left = materialize(left.join(gone, "n", "left_anti"))
        e = materialize(e.join(gone, "n", "left_anti").join(gone.withColumnRenamed("n", "m"), "m", "left_anti").select("n", "m"))

    turn = 0
    while left.head(1):
        settle(left.join(e.select("n").distinct(), "n", "left_anti").withColumn("leads", F.lit(True)))
        turn += 1
        if turn < PLAIN_ROUNDS:
            continue  # most graphs end here; only long chains are worth pointers
        single = materialize(e.groupBy("n").agg(F.count("*").alias("c"), F.min("m").alias("m")).where("c = 1").select("n", "m", F.lit(True).alias("opposite")))
        if not single.head(1):
            continue
        while True:
            on = single.select(F.col("n").alias("m"), F.col("m").alias("m2"), F.col("opposite").alias("o2"))
            further = single.join(on, "m", "left")
            moved = further.select("n", F.coalesce("m2", "m").alias("m"), (F.col("opposite") != F.coalesce("o2", F.lit(False))).alias("opposite"), F.col("m2").isNotNull().alias("moved"))
            single = materialize(moved)
            if not single.where("moved").head(1):
                break
            single = single.drop("moved")
        # A chain that begins at a settled node would have been settled; one that begins at a node without open earlier
        # neighbours follows it: that node leads.
        free = left.join(e.select("n").distinct(), "n", "left_anti").select(F.col("n").alias("m"))
        ends = materialize(single.join(free, "m", "left_semi").select("n", (~F.col("opposite")).alias("leads")).unionByName(free.select(F.col("m").alias("n"), F.lit(True).alias("leads"))))
        if ends.head(1):
            settle(ends)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out if parts else nodes.withColumn("leads", F.lit(True))


def leader_split(nodes: DataFrame, edges: DataFrame, *, key: str, rank: str, exact: str | None = None) -> DataFrame:
    """(key, leader): groups of a leader and its direct neighbours, so no chain joins what isn't alike.

    Leaders are the first maximal independent set by ascending ``rank`` (unique). A member goes to its best adjacent
    leader; leaders without members are left out. With ``exact``, rows that share its value are peeled off first: they form a
    group of their own, led by the best, and neither they nor their edges take part in the rest.
    """
    ranks = nodes.select(F.col(key).alias("n"), F.col(rank).alias("r"))
    peeled = None
    if exact:
        same = nodes.where(F.col(exact).isNotNull()).groupBy(F.col(exact).alias("x")).agg(F.min_by(key, rank).alias("leader"), F.count("*").alias("c")).where("c > 1").select("x", "leader")
        peeled = materialize(nodes.join(same, F.col(exact) == F.col("x")).select(F.col(key).alias("n"), "leader"))
        ends = [peeled.select(F.col("n").alias(c)) for c in ("src", "dst")]
        edges = edges.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti")
    edges = materialize(edges.select("src", "dst"))
    state = materialize(first_independent(ranks, edges))
    both = edges.union(edges.select("dst", "src")).toDF("n", "m").where("n <> m").distinct()
    best = both.join(state.where("leads").select(F.col("n").alias("m")), "m").join(state.where("not leads").select("n"), "n").join(ranks.select(F.col("n").alias("m"), F.col("r").alias("rm")), "m")
    members = best.groupBy("n").agg(F.min_by("m", "rm").alias("leader"))
    leaders = members.select(F.col("leader").alias("n"), F.col("leader").alias("leader")).distinct()
    out = members.unionByName(leaders)
    return (out.unionByName(peeled) if exact else out).withColumnRenamed("n", key)


def exact_groups(df: DataFrame, *, key: str, content: Column, order: Column, by: list[str] | None = None) -> DataFrame:
    """Buckets of equal content with two members or more: (by, content, leader, members, n)."""
    by = by or []
    grouped = df.withColumn("content", content).where("content is not null").groupBy(*by, "content")
    return grouped.agg(F.max_by(key, order).alias("leader"), F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("members")).where("n >= 2")


def exact_members(df: DataFrame, *, key: str, content: Column, order: Column, by: list[str] | None = None) -> DataFrame:
    """(by, content, key, leader, n): one row for each member of a bucket of equal content with two members or more. No list
    of members is made, so a bucket may hold nearly all rows."""
    by = by or []
    rows = df.withColumn("content", content).where("content is not null")
    own = rows.groupBy(F.struct(*by, "content").alias("_own")).agg(F.max_by(key, order).alias("leader"), F.count("*").alias("n")).where("n >= 2")
    return rows.withColumn("_own", F.struct(*by, "content")).join(own, "_own").select(*by, "content", key, "leader", "n")


def group_context(df: DataFrame, *, key: str, by: list[str], quality: str, leader: str) -> DataFrame:
    """Members beside their leader: group size, quality margin and the share of the leader's quality."""
    lead = df.where(F.col(leader)).groupBy(*by).agg(F.min(F.struct(key, quality)).alias("lead"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("group_size"))
    joined = df.join(lead, by, "left").join(sizes, by)
    return joined.withColumns({
        "leader_id": F.col(f"lead.{key}"), "quality_margin": F.col(f"lead.{quality}") - F.col(quality),
        "lower_copy": F.col(quality) < 0.75 * F.col(f"lead.{quality}"),
    }).drop("lead")


def describe_groups(df: DataFrame, *, by: list[str], content: str, confidence: str, size: str, leader: str) -> DataFrame:
    """Kind, confidence and whether the leader is a lower copy, for each group."""
    return df.groupBy(*by).agg(
        F.when(F.count_distinct(content) == 1, F.lit("exact")).otherwise(F.lit("near")).alias("kind"),
        F.min(confidence).alias("confidence"), F.count("*").alias("n"),
        (F.max(F.when(F.col(leader), F.col(size))) < 0.75 * F.max(size)).alias("leader_lower_resolution"),
    )


def group_batches(df: DataFrame, *, group: str, limit: int, by: list[str]) -> DataFrame:
    """(by, group, piece, n, batch): groups packed in order into batches of at most ``limit`` rows; a group stays whole
    but for one over the limit, which is cut into full pieces and a rest.

    A batch closes where the next piece doesn't fit. Where the batch that begins at a piece would end is looked up for all
    pieces at once, in buckets of running sums that hold ``limit`` pieces at most; which pieces do begin a batch follows by
    doubled jumps from the first one, so a partition of all rows takes as many rounds as its number of batches has digits.
    Rows with a null in ``by`` or ``group`` form partitions and groups of their own.
    """
    from gleaner.operators.segmented import ranged, scan

    sizes = df.groupBy(*by, group).agg(F.count("*").alias("rows"))
    pieces = sizes.select(*by, group, "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / limit))).alias("piece"))
    pieces = pieces.select(*by, group, "piece", F.least(F.lit(limit).cast("long"), F.col("rows") - F.col("piece") * limit).alias("n"))
    order = [group, "piece"]
    rows = materialize(scan(ranged(pieces, by=by, order=order), order=order, sums={"upto": F.col("n")}, number="at"))
    # The first piece that ends more than the limit after the beginning of this one.
    ends = rows.select("_by", F.floor((F.col("upto") - 1) / limit).alias("bucket"), F.col("at").alias("to"), F.col("upto").alias("end"))
    wanted = rows.withColumn("start", F.col("upto") - F.col("n"))
    wanted = wanted.select("_by", "at", "start", F.explode(F.array(F.floor(F.col("start") / limit) + 1, F.floor(F.col("start") / limit) + 2)).alias("bucket"))
    met = wanted.join(ends, ["_by", "bucket"]).where(F.col("end") > F.col("start") + limit)
    jump = materialize(met.groupBy("_by", "at").agg(F.min("to").alias("to")))
    begins = materialize(rows.where("at = 1").select("_by", "at"))
    while jump.head(1):
        more = begins.join(jump, ["_by", "at"]).select("_by", F.col("to").alias("at"))
        begins = materialize(begins.unionByName(more).distinct())
        on = jump.select("_by", F.col("at").alias("to"), F.col("to").alias("further"))
        jump = materialize(jump.join(on, ["_by", "to"]).select("_by", "at", F.col("further").alias("to")))
    marked = rows.join(begins.withColumn("begins", F.lit(1)), ["_by", "at"], "left").select(*by, group, "piece", "n", "_by", "_range", F.coalesce("begins", F.lit(0)).alias("begins"))
    counted = scan(marked, order=order, sums={"batch": F.col("begins")})
    return counted.select(*by, group, "piece", "n", (F.col("batch") - 1).cast("long").alias("batch"))


def external_leaders(df: DataFrame, *, by: list[str], key: str, rank: str, confidence: str, least: float = 0.75) -> DataFrame:
    """The new leader of groups in which exactly one confident member is ranked first."""
    good = (F.col(rank) == 1) & (F.col(confidence) >= least)
    return df.groupBy(*by).agg(F.count_if(good).alias("firsts"), F.min(F.when(good, F.col(key))).alias("leader")).where("firsts = 1").drop("firsts")


def series_picks(df: DataFrame, *, by: list[str], key: str, vector: str, quality: str, most: int = 3, slack: float = 0.08, alike: float = 0.94) -> DataFrame:
    """Up to ``most`` good and diverse members of each group of any size, best first: (by, key, pick).

    Each round takes the best row left of every group and drops those like it. Rows meet their group's best or pick by
    the group and one of 64 salts, so a large group is dealt over many tasks.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_salt")

    def meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
        names = [f"_by{k}" for k in range(len(by))]
        small = groups.select(*(F.col(c).alias(n) for c, n in zip(by, names)), *(c for c in groups.columns if c not in by), salts).withColumnRenamed("_salt", "_turn")
        on = F.col("_salt") == F.col("_turn")
        for c, n in zip(by, names):
            on = on & F.col(c).eqNullSafe(F.col(n))
        return rows.join(small, on).drop(*names, "_turn")

    length = F.greatest(X.norm(F.col(vector)), F.lit(1e-8))
    unit = F.transform(vector, lambda x: x.cast("double") / length)
    rows = df.select(*by, key, unit.alias("_unit"), F.col(quality).cast("double").alias("_quality"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows.where(F.col("_quality").isNotNull() & ~F.isnan("_quality")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(64)).cast("int")))
    left = meet(rows, rows.groupBy(*by).agg(F.max("_quality").alias("_best"))).where(F.col("_quality") >= F.col("_best") - slack).drop("_best")
    out = None
    for k in range(1, most + 1):
        left = materialize(left)
        first = left.groupBy(*by).agg(F.min(F.struct((-F.col("_quality")).alias("q"), F.col(key).alias("key"), "_row")).alias("_first"))
        picks = materialize(left.select("_row", F.col("_unit").alias("_like")).join(first.select(*by, F.col("_first.key").alias(key), F.col("_first._row").alias("_row")), "_row"))
        one = picks.select(*by, key, F.lit(k).alias("pick"))
        out = one if out is None else out.unionByName(one)
        near = meet(left, picks.select(*by, "_like", F.col("_row").alias("_picked")))
        left = near.where((F.col("_row") != F.col("_picked")) & (X.dot(F.col("_unit"), F.col("_like")) < alike)).drop("_like", "_picked")
    return out


def diversity_demotions(items: DataFrame, edges: DataFrame, *, key: str, rank: str, cap: int = 3) -> DataFrame:
    """(key, kept): an item is kept iff fewer than ``cap`` kept items before it (ascending unique rank) are alike.

    Each round decides the items that the open ones before them can't change; these and their edges leave, and kept
    ones are counted at those they are alike to. With a cap of one this is :func:`first_independent`.
    """
    ranks = items.select(F.col(key).alias("n"), F.col(rank).alias("r"))
    if cap == 1:
        leads = first_independent(ranks, edges)
        return ranks.join(leads, "n", "left").select(F.col("n").alias(key), F.coalesce("leads", F.lit(True)).alias("kept"))
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("n", "m").where("n <> m").distinct()
    e = materialize(both.join(ranks, "n").join(ranks.select(F.col("n").alias("m"), F.col("r").alias("rm")), "m").where("rm < r").select("n", "m"))
    left, out = materialize(ranks.select("n", F.lit(0).cast("long").alias("k"))), None
    while left.head(1):
        before = e.groupBy("n").agg(F.count("*").alias("u"))
        k, u = F.col("k"), F.coalesce("u", F.lit(0))
        seen = left.join(before, "n", "left").select("n", "k", F.when(k >= cap, F.lit(False)).when(k + u < cap, F.lit(True)).alias("kept"))
        seen = materialize(seen)
        new = seen.where("kept is not null").select("n", "kept")
        out = new if out is None else out.unionByName(new)
        still = seen.where("kept is null").select("n", "k")
        counts = e.join(new.where("kept").select(F.col("n").alias("m")), "m", "left_semi").groupBy("n").agg(F.count("*").alias("more"))
        left = materialize(still.join(counts, "n", "left").select("n", (F.col("k") + F.coalesce("more", F.lit(0))).alias("k")))
        e = materialize(e.join(left.select("n"), "n", "left_semi").join(new.select(F.col("n").alias("m")), "m", "left_anti").select("n", "m"))
    return (ranks.select("n", F.lit(True).alias("kept")) if out is None else out).withColumnRenamed("n", key)


#: Alike pairs for each row from which on no pair is written (:mod:`gleaner.operators.diversity`).
MANY_PAIRS = 8


def _places(df: DataFrame, *, by: list[str], key: str, order: list[str], descending: bool = False) -> DataFrame:
    """(_by, k, place): each row's place from 1 in its partition by ``order``; only these columns are put in order."""
    from gleaner.operators.segmented import ranged, scan

    own = df.select(*by, *(c for c in order if c != "k"), F.col(key).alias("k"))
    placed = scan(ranged(own, by=by, order=order), order=order, number="up").select("_by", "k", "up")
    if not descending:
        return materialize(placed.select("_by", "k", F.col("up").alias("place")))
    placed = placed.join(df.groupBy(F.struct(*by).alias("_by")).agg(F.count("*").alias("n")), "_by")
    return materialize(placed.select("_by", "k", (F.col("n") + 1 - F.col("up")).alias("place")))


def _in_blocks(df: DataFrame, placed: DataFrame, *, by: list[str], key: str, vector: str) -> DataFrame:
    from gleaner.operators.diversity import blocks_in_order

    rows = df.select(F.struct(*by).alias("_by"), F.col(key).alias("k"), F.col(vector).alias("v")).join(placed, ["_by", "k"])
    return blocks_in_order(rows.select(*(F.col("_by")[c].alias(c) for c in by), "k", "place", "v"), by=by)


def diverse(df: DataFrame, *, by: list[str], key: str, vector: str, rank: str, alike: float, cap: int) -> DataFrame:
    """(key, kept): :func:`diversity_demotions` over the pairs of a partition whose cosine reaches ``alike``. Where these are very
    many they are not written. Rows without a direction are alike to none."""
    from gleaner.operators import diversity as D
    from gleaner.operators.pairs import cosine_pairs

    single = dict(df.dtypes)[vector] == "array<float>"
    blocks = _in_blocks(df, _places(df, by=by, key=key, order=[rank]), by=by, key=key, vector=vector)
    if D.alike_pairs(blocks, single=single, alike=alike) <= MANY_PAIRS * blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        return diversity_demotions(df, cosine_pairs(df, key=key, vector=vector, threshold=alike, by=by), key=key, rank=rank, cap=cap)
    return _kept_or_not(blocks, D.kept_blocks(blocks, single=single, alike=alike, cap=cap), df.select(F.col(key).alias("k"))).withColumnRenamed("k", key)


def _kept_or_not(blocks: DataFrame, kept: list[DataFrame], keys: DataFrame) -> DataFrame:
    """``keys`` (k, ...) with whether they are kept: rows of blocks where ``kept`` has them, all others always. Without
    ``_by`` the key alone tells."""
    on = [c for c in keys.columns if c in ("_by", "k")]
    tell = lambda t: t.select(F.struct(*(F.col("_by")[c].alias(c) for c in t.select("_by.*").columns if c != "_size")).alias("_by"), F.explode("ks").alias("k")).select(*on)
    yes = tell(kept[0])
    for more in kept[1:]:
        yes = yes.unionByName(tell(more))
    all_rows = tell(blocks).withColumn("_seen", F.lit(True))
    return keys.join(all_rows, on, "left").join(yes.withColumn("_kept", F.lit(True)), on, "left").select(*keys.columns, (F.col("_seen").isNull() | F.col("_kept").isNotNull()).alias("kept"))


def diversity_rerank(df: DataFrame, *, by: list[str], key: str, vector: str, order: list[str], keep: Column, protected: Column, alike: float = 0.94, distinct: float = 0.65, cap: int = 3) -> DataFrame:
    """(by, key, value, nearest, similarity, demoted, reason): how much each row adds to its partition's kept rows.

    Kept rows that aren't protected come in descending order of the ``order`` columns and the key. One is demoted if ``cap`` of those taken before
    it are ``alike``. Its value falls from 100 at a similarity of ``distinct`` to the nearest of them to 0 at 1, and the
    nearest is named where it is nearer than that; the first of a partition is its anchor. Rows that aren't kept or have no
    vector have 50, protected ones 100, and neither counts for others.
    """
    from gleaner.operators import diversity as D
    from gleaner.operators.pairs import cosine_pairs

    state = F.when(~F.coalesce(keep, F.lit(False)), "other").when(F.coalesce(protected, F.lit(False)), "protected").when(F.coalesce(X.norm(F.col(vector)), F.lit(0.0)) > 1e-8, "open").otherwise("feature_unavailable")
    rows = materialize(df.withColumn("_state", state).select(*by, F.col(key).alias("k"), F.col(vector).alias("v"), "_state", *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))))
    own = rows.where("_state = 'open'")
    ahead = [*(f"_o{i}" for i in range(len(order))), "k"]
    placed = _places(own, by=by, key="k", order=ahead, descending=True)
    item = placed.select(F.struct("_by", "place").alias("r"), F.struct("_by", "k").alias("n"), "k")
    single = dict(df.dtypes)[vector] == "array<float>"
    blocks = _in_blocks(own, placed, by=by, key="k", vector="v")
    if D.alike_pairs(blocks, single=single, alike=distinct) <= MANY_PAIRS * blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
        kept, near = _by_pairs(item, materialize(cosine_pairs(own, key="k", vector="v", threshold=distinct, by=by)), alike=alike, cap=cap)
    else:
        found = D.kept_blocks(blocks, single=single, alike=alike, cap=cap)
        kept = _kept_or_not(blocks, found, placed.select("_by", "k")).select(F.struct("_by", "k").alias("n"), "kept")
        plain = F.struct(*(F.col("_by")[c].alias(c) for c in by))
        near = D.nearest_kept(blocks, found, single=single, least=distinct).select(F.struct(plain.alias("_by"), "k").alias("n"), F.struct("x.cosine", "x.first", F.struct(F.col("x.m").alias("k")).alias("m")).alias("x"))
    value = F.round(X.clamp((1 - F.col("x.cosine")) / (1 - distinct) * 100, 0.0, 100.0), 2)
    told = kept.join(near, "n", "left").join(item.select("n", "r"), "n").select(
        F.col("n._by").alias("_by"), F.col("n.k").alias("k"), F.coalesce(value, F.lit(100.0)).alias("value"), F.col("x.m.k").alias("nearest"), F.round("x.cosine", 4).alias("similarity"), (~F.col("kept")).alias("demoted"),
        F.when(F.col("r.place") == 1, "semantic_anchor").when(~F.col("kept"), "semantic_scene_limit").otherwise("semantic_distance").alias("reason"),
    )
    rest = rows.where("_state <> 'open'").select(
        F.struct(*by).alias("_by"), "k", F.when(F.col("_state") == "protected", 100.0).otherwise(50.0).alias("value"), F.lit(None).cast(dict(df.dtypes)[key]).alias("nearest"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("demoted"),
        F.when(F.col("_state") != "other", F.col("_state")).alias("reason"),
    )
    out = told.unionByName(rest)
    return out.select(*(F.col("_by")[c].alias(c) for c in by), F.col("k").alias(key), "value", "nearest", "similarity", "demoted", "reason")


def _by_pairs(item: DataFrame, pairs: DataFrame, *, alike: float, cap: int) -> tuple[DataFrame, DataFrame]:
    """(n, kept) of all items, and (n, x) of the nearest kept one before them, from all near pairs."""
    by = [c for c in pairs.columns if c not in ("src", "dst", "cosine")]
    ends = pairs.withColumn("_by", F.struct(*by)).select(F.struct("_by", F.col("src").alias("k")).alias("src"), F.struct("_by", F.col("dst").alias("k")).alias("dst"), "cosine")
    kept = materialize(diversity_demotions(item, ends.where(F.col("cosine") >= alike), key="n", rank="r", cap=cap))
    both = ends.select(F.col("src").alias("n"), F.col("dst").alias("m"), "cosine").union(ends.select("dst", "src", "cosine"))
    ranks = item.select("n", "r")
    before = both.join(kept.where("kept").select(F.col("n").alias("m")), "m").join(ranks, "n").join(ranks.select(F.col("n").alias("m"), F.col("r").alias("rm")), "m").where("rm < r")
    return kept, before.groupBy("n").agg(F.max(F.struct("cosine", F.struct(-F.col("rm.place")).alias("first"), "m")).alias("x"))


def disjoint_pairs(pairs: DataFrame, *, most: int) -> DataFrame:
    """Pairs (src, dst, component) in digest order that share no item with an earlier chosen pair, one of each component in
    turn, at most ``most``: (component, turn, left, right). The digest also decides the sides.

    Each round chooses the pairs that are the first open ones of both their items; what shares an item with them leaves. No
    two pairs are compared, so an item may be in nearly all of them; as digests are random, the rounds are few.
    """
    left, kept = materialize(pairs.select("src", "dst", "component", F.sha2(F.concat_ws("|", "src", "dst"), 256).alias("digest"))), None
    while kept is None or left.head(1):
        first = left.select(F.explode(F.array("src", "dst")).alias("item"), "digest").groupBy("item").agg(F.min("digest").alias("digest"))
        both = first.groupBy("digest").agg(F.count("*").alias("ends")).where("ends = 2").select("digest")
        new = materialize(left.join(both, "digest", "left_semi"))
        kept = new if kept is None else kept.unionByName(new)
        used = new.select(F.explode(F.array("src", "dst")).alias("item"))
        left = materialize(left.join(used, F.col("src") == F.col("item"), "left_anti").join(used, F.col("dst") == F.col("item"), "left_anti"))
    # Only the first of each component can be among the chosen.
    chosen = kept.withColumn("turn", F.expr("row_number() over (partition by component order by digest)")).where(F.col("turn") <= most)
    swap = F.substring("digest", 1, 1) < "8"
    return chosen.orderBy("turn", "digest").limit(most).select("component", "turn", F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("left"), F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("right"))


def member_digest(df: DataFrame, *, by: str, key: str) -> DataFrame:
    """(by, n, digest) of each group's set of members, as a digest of bucket digests, so no task sees a whole group."""
    ids = df.select(by, F.col(key).cast("string").alias("id")).distinct().withColumn("bucket", F.substring(F.md5("id"), 1, 2))
    each = ids.groupBy(by, "bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("digest"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), ",")
    return each.groupBy(by).agg(F.sum("n").alias("n"), F.sha2(whole, 256).alias("digest"))


def rerank_groups(members: DataFrame, edges: DataFrame, previous: DataFrame, *, key: str, score: str) -> DataFrame:
    """(group_id, key, leader, n) of new groups (key, grp, leader, score): a group whose members are those of a previous one
    (key, group_id) keeps its id, others get one from their members. The best member linked to all others leads; where
    there is none, the present leader stays. ``edges`` are (src, dst)."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF(key, "other").distinct()
    inside = both.join(members.select(key, F.col("grp").alias("g1")), key).join(members.select(F.col(key).alias("other"), F.col("grp").alias("g2")), "other").where("g1 = g2")
    degree = inside.groupBy(key).agg(F.count("*").alias("links"))
    sets = member_digest(members, by="grp", key=key)
    full = members.join(degree, key, "left").join(sets, "grp")
    best = full.groupBy("grp").agg(F.min(F.when(F.coalesce("links", F.lit(0)) == F.col("n") - 1, F.struct((-F.col(score)).alias("s"), F.col(key).alias("k")))).alias("best"))
    old = member_digest(previous, by="group_id", key=key).groupBy("digest").agg(F.min("group_id").alias("group_id"))
    named = sets.join(old, "digest", "left").select("grp", "n", F.coalesce("group_id", F.concat(F.lit("series-"), F.substring("digest", 1, 12))).alias("group_id"))
    return members.join(named, "grp").join(best, "grp").select("group_id", key, F.coalesce("best.k", "leader").alias("leader"), "n")
