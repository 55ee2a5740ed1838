"""Compositions: curate (score, decide, diversify, decide again) and the tree of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators import groups as G
from gleaner.operators import ordered as W
from gleaner.operators import rules as R
from gleaner.operators import scenes as S
from gleaner.sources.tables import materialize

C = F.col


def curate(lines: DataFrame) -> DataFrame:
    """Scores, thresholds and decisions of order lines, computed before and again after demoting all but the best three of a series."""
    ranked = W.normalize_metrics(lines, ["l_quantity", "l_extendedprice"], by=["l_orderkey"], quality_of=["l_quantity", "l_extendedprice"], bounded=True)
    parts = {"generic": C("quality") * 100, "content": C("l_discount") * 1000, "moment": C("l_tax") * 1000}
    scored = ranked.withColumn("score", R.composite_score(parts, penalty=R.technical_penalty(C("l_quantity") < 3, F.lit(False), F.lit(False)), utility=F.lit(False), delta=F.lit(0.0)))
    scored = materialize(scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "score"))  # read again for both thresholds

    def decide(rows: DataFrame, out: str) -> DataFrame:
        limits = W.selection_threshold(rows, by=["l_returnflag"], score="score", ratio=0.45, default=60.0)
        held = rows.join(limits, "l_returnflag")
        pick = R.decide(available=F.lit(True), protected=F.lit(False), loser=F.lit(False), leader=F.lit(False), exact=F.lit(False), confirmed=F.lit(False), confidence=F.lit(0.0), score=C("score"), threshold=C("threshold"), signal=F.lit(0.5))
        return held.withColumn(out, R.selection_state(pick["disposition"], C("score"), C("threshold"), pick["confidence"], F.lit(False))).drop("threshold")

    first = decide(scored, "first_state")
    placed = first.withColumn("place", F.expr("row_number() over (partition by l_orderkey order by score desc, l_linenumber, l_partkey, l_suppkey)"))
    demoted = materialize(placed.withColumn("score", F.when((C("place") > 3) & (C("first_state") == "pick"), C("score") - 10).otherwise(C("score"))))
    return decide(demoted, "state").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "first_state", "state")


def scene_tree(vectors: DataFrame) -> DataFrame:
    """Nodes (layer, node, parent, n) of label, scene and stack, by adaptive scenes and complete-link stacks."""
    scenes = W.semantic_scenes(vectors, vector="embedding", by=["label"], order=["vec_id"], low=-1.0, spread=1.0)
    named = scenes.withColumn("scene_key", F.concat_ws("/", C("label").cast("string"), C("scene").cast("string")))
    stacks = S.complete_link_stacks(named, by=["scene_key"], key="vec_id", vector="embedding", threshold=0.0)
    full = named.select("label", "scene_key", "vec_id").join(stacks, ["scene_key", "vec_id"])
    ids = F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))
    top = full.groupBy(C("label").cast("string").alias("node")).agg(F.count("*").alias("n")).select(F.lit("episode").alias("layer"), "node", F.lit(None).cast("string").alias("parent"), "n")
    mid = full.groupBy("scene_key", "label").agg(F.count("*").alias("n")).select(F.lit("scene"), "scene_key", C("label").cast("string"), "n")
    low = full.groupBy("scene_key", "stack").agg(X.node_id("stack", ids).alias("node"), F.count("*").alias("n")).select(F.lit("stack"), "node", "scene_key", "n")
    return top.union(mid).union(low)
