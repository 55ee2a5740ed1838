"""Inventories: scans, snapshots, merges, invalidation and idempotent sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.evaluation import unknown_keys


def read_inventory(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """A source collection in Parquet, JSON or CSV under a fixed schema; order must be a column of the data."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_manifests(df: DataFrame, path: str, *, album: str) -> None:
    """One JSON document per album: {album, assets: [...]}; the commit protocol makes it atomic."""
    rest = [c for c in df.columns if c != album]
    df.groupBy(F.col(album).alias("album")).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("assets")).write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str, asset_schema: str) -> DataFrame:
    """Assets of all readable manifests; broken ones are skipped."""
    schema = f"album string, assets array<struct<{asset_schema}>>, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null and assets is not null").select("album", F.inline("assets"))


def fingerprint_files(spark: SparkSession, path: str, *, settings: str) -> DataFrame:
    """path, length, content digest and a source fingerprint of content, size and settings version."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digest = F.sha2("content", 256)
    return files.select("path", "length", digest.alias("content_sha256"), F.sha2(F.concat_ws("|", digest, F.col("length").cast("string"), F.lit(settings)), 256).alias("fingerprint"))


def take_snapshot(df: DataFrame, *, by: str, order: str, row: list[str]) -> DataFrame:
    """(by, items, membership): an immutable digest of the ordered membership of each partition.

    Rows are digested with their place in the order, and met in 4,096 buckets by it; the digests of a partition's buckets
    make its own, so no task holds a whole partition.
    """
    item = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in [order, *row])), 256)
    rows = df.select(by, F.substring(F.md5(F.col(order).cast("string")), 1, 3).alias("bucket"), item.alias("item"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    buckets = rows.groupBy(by, "bucket").agg(F.count("*").alias("n"), joined("item").alias("digest"))
    return buckets.groupBy(by).agg(F.sum("n").alias("items"), joined(F.concat("bucket", F.lit(":"), "digest")).alias("membership"))


def merge_inventory(current: DataFrame, incoming: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Upsert: incoming rows win, absent ones stay as ``inactive``, ``changed`` tells new, different or newly inactive."""
    c, n = current.select(key, F.struct(*fields).alias("c")), incoming.select(key, F.struct(*fields).alias("n"))
    both = c.join(n, key, "full")
    values = [F.coalesce(F.col("n"), F.col("c"))[f].alias(f) for f in fields]
    return both.select(key, *values, F.col("n").isNull().alias("inactive"), (~F.col("c").eqNullSafe(F.col("n"))).alias("changed"))


def invalidate_groups(members: DataFrame, changed: DataFrame, *, key: str, group: str) -> DataFrame:
    """Members of the groups that hold no changed key."""
    hit = members.join(changed.select(key).distinct(), key, "left_semi").select(group).distinct()
    return members.join(hit, group, "left_anti")


def upsert_latest(base: DataFrame, delta: DataFrame, *, key: list[str], order: list[str]) -> DataFrame:
    """Last writer wins for every key."""
    rows = base.unionByName(delta)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def insert_new(base: DataFrame, delta: DataFrame, *, key: list[str]) -> DataFrame:
    """Insert or ignore: the base's row wins, then one delta row of a key."""
    fresh = delta.join(base.select(*key), key, "left_anti").dropDuplicates(key)
    return base.unionByName(fresh)


def replace_partitions(df: DataFrame, path: str, *, by: list[str]) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pending_work(assets: DataFrame, signals: DataFrame, engines: dict[str, str], *, key: str, fingerprint: str) -> DataFrame:
    """(key, kind): engines whose signal for an asset is absent, not ready, older or of another version.

    ``signals``: key, kind, status, version, fingerprint.
    """
    wanted = F.explode(F.create_map(*[F.lit(x) for pair in engines.items() for x in pair])).alias("kind", "version")
    asked = assets.select(key, F.col(fingerprint).alias("want"), wanted)
    s = signals.select(key, "kind", F.col("status"), F.col("version").alias("has"), F.col("fingerprint").alias("seen"))
    fine = (F.col("status") == "ready") & (F.col("has") == F.col("version")) & F.col("seen").eqNullSafe(F.col("want"))
    return asked.join(s, [key, "kind"], "left").where(~F.coalesce(fine, F.lit(False))).select(key, "kind").distinct()


def export_scores(df: DataFrame, *, key: str, score: str, engine: str, version: str) -> DataFrame:
    """A frozen score table with its engine; fails where a row lacks a finite score."""
    s = F.col(score).cast("double")
    checked = F.when(s.isNull() | F.isnan(s), F.raise_error(F.lit("a row lacks a score")).cast("double")).otherwise(s)
    return df.select(key, checked.alias("score"), F.lit(engine).alias("engine"), F.lit(version).alias("version"))


def import_rows(spark: SparkSession, base: DataFrame, path: str, *, key: list[str], known: DataFrame, known_key: str) -> DataFrame:
    """Rows of an exported table that are new; fails on other columns or unknown items."""
    rows = spark.read.parquet(path)
    if sorted(rows.columns) != sorted(base.columns):
        raise ValueError(f"columns {sorted(rows.columns)}, expected {sorted(base.columns)}")
    if unknown_keys(rows, known, key=known_key).head(1):
        raise ValueError(f"unknown {known_key}")
    return rows.join(base.select(*key), key, "left_anti").dropDuplicates(key)


def model_versions(signals: DataFrame, *, key: str) -> DataFrame:
    """(key, versions): the map of kind to engine@version[/revision-r] of an item's signals; those without engine or
    version don't count. One signal per kind."""
    named = F.concat("engine_name", F.lit("@"), "engine_version", F.coalesce(F.concat(F.lit("/revision-"), F.col("request_revision").cast("string")), F.lit("")))
    held = signals.where("engine_name <> '' and engine_version <> ''").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal_kind", named.alias("version"))))).alias("versions"))
    return signals.select(key).distinct().join(held, key, "left").select(key, F.coalesce("versions", F.create_map().cast("map<string,string>")).alias("versions"))
