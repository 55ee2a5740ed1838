"""Views, listings, projections and summaries over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_media(kind: Column, is_photo: Column) -> Column:
    """image, video or audio from free text, with a fallback for unknown kinds."""
    low = F.lower(F.trim(kind))
    return F.when(low.isin("image", "photo", "picture"), "image").when(low.isin("video", "movie", "clip"), "video").when(low.isin("audio", "sound"), "audio").when(is_photo, "image").otherwise("video")


def revision_fingerprint(explicit: Column, fields: list[Column]) -> Column:
    """The explicit revision, else a digest of the fields in order."""
    return F.coalesce(explicit, F.sha2(F.concat_ws("|", *(f.cast("string") for f in fields)), 256))


def resolve_source(edited: Column, derivatives: Column, original: Column) -> Column:
    """Edited over the largest derivative (array of struct<size, path>) over the original, with a code."""
    largest = F.array_max(derivatives)["path"]
    row = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("code"))
    return F.when(edited.isNotNull(), row(edited, "edited")).when(largest.isNotNull(), row(largest, "derivative")).otherwise(row(original, "original"))


def resolution_gate(width: Column, height: Column, least: int = 256, most: int = 512) -> Column:
    """(state, warning) by the shorter and longer edge."""
    fine = (F.least(width, height) >= least) & (F.greatest(width, height) >= most)
    return F.struct(F.when(fine, "ready").otherwise("degraded").alias("state"), F.when(~fine, F.format_string("%sx%s is small", width, height)).alias("warning"))


def normalize_burst_key(key: Column) -> Column:
    """Sentinels for "no burst" become null."""
    return F.when(~F.lower(F.trim(key)).isin("", "0", "false", "none", "null"), key)


def merge_external_flags(own: Column, defects: Column, names: dict[str, str]) -> Column:
    """Own flags and mapped external defects, sorted and unique; unknown defects are left out."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_sort(F.array_union(own, F.array_compact(F.transform(defects, lambda d: F.element_at(table, d)))))


def decode_json(text: Column, schema: str, empty: Column) -> Column:
    """Parsed JSON; the empty value for missing or broken text."""
    return F.coalesce(F.from_json(text, schema), empty)


def card(df: DataFrame, *, key: str, heavy: list[str]) -> DataFrame:
    """(key, card): the row as JSON without heavy fields."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c not in heavy])).alias("card"))


def blind(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only columns on the allow list, so a labelling view carries no score."""
    return df.select(*[c for c in df.columns if c in allowed])


def lookup(df: DataFrame, keys: DataFrame, *, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exists_filter(df: DataFrame, other: DataFrame, *, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)).distinct(), key, "left_semi")


def exclude(df: DataFrame, other: DataFrame, *, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def summary(df: DataFrame, *, by: list[str], flags: dict[str, Column], distinct: str) -> DataFrame:
    """Counts of conditions and of distinct values, one pass."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()], F.count_distinct(distinct).alias("distinct"))
