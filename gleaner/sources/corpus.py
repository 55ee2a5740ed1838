"""Export of a labelled corpus to files, and its import into another one under new ids.

A corpus has ``items`` (id, key, split), ``vectors`` (item_id, space, size, data: little-endian 4-byte floats), ``labels``
(item_id, name, value), ``pairs`` (id, left_id, right_id, preferred_id) and ``rounds`` (id, key, pair_id). Ids are the
corpus' own; what tells rows apart are the keys, and the items of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.segmented import ranged, scan
from gleaner.sources.tables import materialize

SCHEMAS = {
    "items": "id long, key string, split string", "vectors": "item_id long, space string, size int, data binary", "labels": "item_id long, name string, value double",
    "pairs": "id long, left_id long, right_id long, preferred_id long", "rounds": "id long, key string, pair_id long",
}
Corpus = dict[str, DataFrame]


def export_corpus(corpus: Corpus, path: str, *, excluded: DataFrame | None = None) -> None:
    """Each table as Parquet below ``path``; ``excluded`` pairs (id) and their rounds stay behind."""
    for name, table in corpus.items():
        if excluded is not None and name in ("pairs", "rounds"):
            table = table.join(excluded.select(F.col("id").alias("id" if name == "pairs" else "pair_id")), "id" if name == "pairs" else "pair_id", "left_anti")
        table.write.parquet(f"{path}/{name}")


def read_corpus(spark: SparkSession, path: str) -> Corpus:
    """The tables of an export; fails on missing, further or differently typed columns."""
    out = {}
    for name, schema in SCHEMAS.items():
        table = spark.read.parquet(f"{path}/{name}")
        want, have = dict(x.split() for x in schema.split(", ")), {c: k.replace("bigint", "long") for c, k in table.dtypes}
        if want != have:
            raise ValueError(f"{name}: columns {have}, expected {want}")
        out[name] = table.select(*want)
    return out


def corpus_faults(corpus: Corpus, base: Corpus) -> DataFrame:
    """(fault, id): rows that no import may take: vectors whose bytes are no finite floats of their size, references to
    rows that aren't there, preferred items outside their pair, and items that the base has under another split."""
    count = F.octet_length("data")
    # A float's exponent of all ones is infinite or no number: its last two bytes of four hold it.
    ends = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(count / 4) - 1, F.lit(0))), lambda i: F.conv(F.hex(F.concat(F.substring("data", i * 4 + 4, F.lit(1)), F.substring("data", i * 4 + 3, F.lit(1)))), 16, 10).cast("int"))
    wrong = F.coalesce((F.col("size") <= 0) | (count != F.col("size") * 4) | F.exists(ends, lambda x: x.bitwiseAND(F.lit(0x7F80)) == 0x7F80), F.lit(True))
    ids = corpus["items"].select(F.col("id").alias("known"))
    lost = lambda name, column, target: corpus[name].join(target, F.col(column) == F.col("known"), "left_anti").select(F.lit(f"{name}.{column}").alias("fault"), F.col(column).alias("id"))
    known = base["items"].select("key", F.col("split").alias("had"))
    faults = [
        corpus["vectors"].where(wrong).select(F.lit("vectors.data").alias("fault"), F.col("item_id").alias("id")), lost("vectors", "item_id", ids), lost("labels", "item_id", ids), lost("pairs", "left_id", ids), lost("pairs", "right_id", ids),
        lost("rounds", "pair_id", corpus["pairs"].select(F.col("id").alias("known"))),
        corpus["pairs"].where(~F.coalesce(F.col("preferred_id").isin(F.col("left_id"), F.col("right_id")), F.lit(False))).select(F.lit("pairs.preferred_id").alias("fault"), "id"),
        corpus["items"].join(known, "key").where(~F.col("split").eqNullSafe(F.col("had"))).select(F.lit("items.split").alias("fault"), "id"),
    ]
    out = faults[0]
    for more in faults[1:]:
        out = out.unionByName(more)
    return out


def _numbered(new: DataFrame, base: DataFrame, order: list[str]) -> DataFrame:
    """``new`` rows with a dense ``new_id`` after the base's greatest, in order, over all tasks."""
    rows = scan(ranged(new.withColumn("_all", F.lit(0)), by=["_all"], order=order), order=order, number="_place")
    last = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("new_id", F.col("_last") + F.col("_place")).select(*new.columns, "new_id")


def import_corpus(base: Corpus, incoming: Corpus) -> tuple[Corpus, dict[str, int]]:
    """The merged tables and how many rows each gained; what the base has stays as it is, so importing twice adds nothing.

    Items and rounds are told apart by key, pairs by their two items in either order, vectors by item and space, labels by item
    and name. New items, pairs and rounds get dense ids after the base's; every reference follows. Fails on any of
    :func:`corpus_faults`.
    """
    found = corpus_faults(incoming, base).groupBy("fault").count().collect()
    if found:
        raise ValueError(f"the corpus cannot be imported: {sorted((r['fault'], r['count']) for r in found)}")
    added: Corpus = {}

    items = incoming["items"].dropDuplicates(["key"])
    held = base["items"].select(F.col("id").alias("new_id"), "key")
    fresh = materialize(_numbered(items.join(held, "key", "left_anti"), base["items"], ["key"]))
    added["items"] = fresh.select(F.col("new_id").alias("id"), "key", "split")
    keys = held.unionByName(fresh.select("new_id", "key"))
    item = materialize(incoming["items"].join(keys, "key").select(F.col("id").alias("old"), F.col("new_id").alias("now")))

    def follow(table: DataFrame, column: str, ids: DataFrame) -> DataFrame:
        return table.join(ids, F.col(column) == F.col("old")).drop("old", column).withColumnRenamed("now", column)

    for name, own in (("vectors", ["item_id", "space"]), ("labels", ["item_id", "name"])):
        moved = follow(incoming[name], "item_id", item).dropDuplicates(own)
        added[name] = moved.join(base[name].select(*own), own, "left_anti").select(*base[name].columns)
    sides = [F.least("left_id", "right_id").alias("lo"), F.greatest("left_id", "right_id").alias("hi")]
    moved = incoming["pairs"]
    for column in ("left_id", "right_id", "preferred_id"):
        moved = follow(moved, column, item)
    moved = materialize(moved.select("*", *sides))
    there = base["pairs"].select(F.col("id").alias("new_id"), *sides).groupBy("lo", "hi").agg(F.min("new_id").alias("new_id"))
    one = moved.join(there, ["lo", "hi"], "left_anti").groupBy("lo", "hi").agg(F.min_by(F.struct("left_id", "right_id", "preferred_id"), "id").alias("p"))
    fresh = materialize(_numbered(one.select("lo", "hi", "p.*"), base["pairs"], ["lo", "hi"]))
    added["pairs"] = fresh.select(F.col("new_id").alias("id"), "left_id", "right_id", "preferred_id")
    pair = materialize(moved.join(there.unionByName(fresh.select("lo", "hi", "new_id")), ["lo", "hi"]).select(F.col("id").alias("old"), F.col("new_id").alias("now")))
    moved = follow(incoming["rounds"].dropDuplicates(["key"]), "pair_id", pair).join(base["rounds"].select("key"), "key", "left_anti")
    added["rounds"] = _numbered(moved.select("key", "pair_id"), base["rounds"], ["key"]).select(F.col("new_id").alias("id"), "key", "pair_id")
    added = {name: materialize(table.select(*base[name].columns)) for name, table in added.items()}
    return {name: base[name].unionByName(added[name]) for name in SCHEMAS}, {name: added[name].count() for name in SCHEMAS}
