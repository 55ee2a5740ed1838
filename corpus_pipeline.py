"""The corpus pipeline: STAGES applied in turn to ``documents``.

Every stage works on all that its predecessor kept and its decisions take effect; all but the last return the columns
of ``documents``. Packing returns one row per piece of a document in its sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table
from gleaner.llm.decontamination import find_leaks
from gleaner.llm.jaccard import grouped
from gleaner.llm.language import UNKNOWN, fit, is_held_out, predict
from gleaner.llm.packing import packed_digest
from gleaner.llm.privacy import find, sanitise

#: Documents whose trigrams their best language explains no better than chance are rejected.
LEAST_GAIN = 0.0


def _key(text_key: Column) -> Column:
    """Equal for rows of the same id and text, and never null."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), text_key).alias("row_key")


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, row_key): each document as one value, so that no column of it can clash with one of ours."""
    return docs.select(F.struct(*docs.columns).alias("row"), _key(F.xxhash64("text", F.col("text").isNull())))


def _by_key(docs: DataFrame) -> DataFrame:
    """The texts with their row key for an id, for operators that tell documents apart by id."""
    return docs.select(_key(F.xxhash64("text", F.col("text").isNull())).alias("doc_id"), "text")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents but for those whose row key is a rejected doc_id."""
    return _keyed(docs).join(rejected.select(F.col("doc_id").alias("row_key")).distinct(), "row_key", "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold no learned language: no letters (null and empty texts too), or trigrams that no learned
    language explains. Rows of the same id and text go or stay together; without labelled documents, or without any, no row stays."""
    found = predict(_by_key(docs), fit(docs.where(~is_held_out(F.col("doc_id")))))
    return _without(docs, materialize(found.where((F.col("lang_pred") == UNKNOWN) | (F.col("gain") < LEAST_GAIN)), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that links of five-word shingle sets, similarity 0.8, join;
    without any id, one of them. Of rows with the same id and text one stays; texts without words link with nothing."""
    found = grouped(docs, width=5, num=80, den=100)
    rows = materialize(found.groupBy("doc_id", "text_key").agg(F.max("comp").alias("comp"), F.count("*").alias("copies")), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(place).alias("first"))
    settled = rows.join(first, "comp", "left").select(_key(F.col("text_key")), (F.col("first").isNull() | (F.col("first") == place)).alias("kept"), "copies")
    settled = materialize(settled.where("not kept or copies > 1"), "settled")
    once = _without(docs, settled.select(F.col("row_key").alias("doc_id")))
    repeated = _keyed(docs).join(settled.where("kept").select("row_key"), "row_key", "left_semi")
    return once.unionByName(repeated.dropDuplicates(["row_key"]).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none; repeated rows go or stay together."""
    return _without(docs, materialize(find_leaks(_by_key(docs), table(spark, sf_dir, "benchmark")), "rejected"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and remove the terms that reveal it; n_chars follows the text. Null and empty texts, and
    all other columns whatever their names, stay as they are; repeated rows stay repeated."""
    found = find(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(F.struct("doc_id", "text_key").alias("own"), "spans").dropDuplicates(["own"])
    # Texts without a digit, @ or + hold no base span, and so no term either; they don't take part in the join.
    bare = ~F.coalesce(F.col("text").rlike("[0-9@+]"), F.lit(False))
    rows = docs.where(~bare).select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).alias("own"))
    met = rows.join(found, "own", "left")
    clean = F.when(F.col("spans").isNotNull(), sanitise(F.col("row")["text"], F.col("spans"))).otherwise(F.col("row")["text"])
    out = met.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    out = docs.where(bare).unionByName(out)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows of 4096 tokens: a null text counts as empty, repeated rows are packed each, other
    columns are not read and no row gives no piece."""
    return packed_digest(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", privacy),
    ("packing", packing),
]

#: Mixture inference, grouping and tokenisation have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = materialize(out, f"stage-{k}") if k + 1 < len(STAGES) else out
    return docs
