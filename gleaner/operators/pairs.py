"""Candidate and verified pairs. All return (by..., src, dst, ...) with src < dst and meet on equality keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators.intervals import pairs_in_time
from gleaner.operators.pivots import angle_pairs
from gleaner.operators.segmented import ranged, scan
from gleaner.operators.signatures import near_pairs
from gleaner.sources.tables import materialize, spread

BANDS_64 = (16, 16, 16, 16)
BANDS_60 = (15, 15, 15, 15)


def ordered_pair(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))


def interval_pairs(df: DataFrame, *, key: str, micros: Column, within: int, by: list[str]) -> DataFrame:
    """Every pair of a partition at most ``within`` seconds apart: (by, src, dst, seconds).

    See :func:`~gleaner.operators.intervals.pairs_in_time`: rows are shuffled about once, and sorted.
    """
    met = pairs_in_time(df.select(*by, F.col(key).alias("k"), micros.cast("long").alias("t")), by=by, span=within * 1_000_000)
    return met.select(*by, F.least("k", "k2").alias("src"), F.greatest("k", "k2").alias("dst"), (F.col("gap") / 1e6).alias("seconds"))


def k_next_pairs(df: DataFrame, *, key: str, micros: Column, within: int, by: list[str], k: int = 12, zoned: Column | None = None) -> DataFrame:
    """Pairs of each row with at most ``k`` following rows of its partition, as far as the interval reaches.

    Times with and without a zone (``zoned``) can't be compared: a row's pairs end before the first follower of the other
    kind. Rows are numbered by a segmented scan, so a partition may hold all of them.
    """
    zone = zoned if zoned is not None else F.lit(True)
    rows = ranged(df.select(*by, F.col(key).alias("k"), micros.alias("t"), zone.alias("zoned")), by=by, order=["t", "k"])
    rows = scan(rows, order=["t", "k"], lags={"before": "zoned"}, number="rn")
    if zoned is not None:
        # The number of changes so far is the same for rows with no change between them.
        rows = scan(rows, order=["t", "k"], sums={"run": (~F.col("zoned").eqNullSafe(F.col("before"))).cast("int")})
    else:
        rows = rows.withColumn("run", F.lit(0))
    rows = materialize(rows.select(*by, "_by", "rn", "run", "k", "t"))
    left = rows.withColumn("rn", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.col("rn") + i)))
    right = rows.select("_by", "rn", "run", F.col("k").alias("k2"), F.col("t").alias("t2"))
    met = left.join(right, ["_by", "rn", "run"]).where(F.col("t2") - F.col("t") <= within * 1_000_000)
    return met.select(*by, F.least("k", "k2").alias("src"), F.greatest("k", "k2").alias("dst"), ((F.col("t2") - F.col("t")) / 1e6).alias("seconds"))


def text_signatures(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, signature): the majority of the tokens' bits, as 60 bits. Texts without tokens have no row.

    One sum counts two bits, 30 apart: a text has fewer than 2^30 tokens, so the lower count never reaches the upper.
    """
    tokens = spread(df.select(key, text)).select(key, F.explode(F.split(text, " ")).alias("token")).where("token <> ''").withColumn("h", X.token_bits(F.col("token")))
    both = F.lit((1 << 30) + 1)
    counts = tokens.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.shiftright("h", b).bitwiseAND(both)).alias(f"c{b}") for b in range(30)])
    bits = F.lit(0).cast("bigint")
    for b in range(30):
        low, high = F.col(f"c{b}").bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright(f"c{b}", 30)
        bits = bits + F.when(2 * low > F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)) + F.when(2 * high > F.col("n"), F.lit(1 << (b + 30))).otherwise(F.lit(0))
    return counts.select(key, bits.alias("signature"))


def signature_pairs(df: DataFrame, *, signature: str, most: int = 10, bands: tuple[int, ...] = BANDS_64) -> DataFrame:
    """All pairs of different signatures at most ``most`` bits apart: (src, dst, distance).

    Every block of signatures meets every other (:func:`~gleaner.operators.signatures.near_pairs`), so the pairs don't depend on ``bands``.
    """
    own = df.select(F.col(signature).alias("s")).where("s is not null").distinct()
    near = near_pairs(own.select(F.col("s").alias("k"), "s", F.lit(True).alias("lead")), most=most)
    return ordered_pair(near, "k", "k2", "distance").select("src", "dst", "distance")


def representative_pairs_within(df: DataFrame, *, key: str, signature: str, order: list[str], micros: Column, within: int, most: int = 10) -> DataFrame:
    """Those of :func:`representative_pairs` that lie at most ``within`` seconds apart.

    Rows meet in time buckets as long as the interval, so pairs that the time rules out are never made: the work grows with the
    rows and with how many of them fall in one interval, not with the square of all. Both sides are merged, as Spark takes a
    side for no larger than before its rows were copied to their buckets, and would broadcast it.
    """
    span = within * 1_000_000
    rows = materialize(df.where(F.col(signature).isNotNull()).select(F.col(key).alias("k"), F.col(signature).alias("s"), micros.alias("t"), F.struct(*order, key).alias("place")).where("t is not null"))
    first = rows.groupBy("s").agg(F.min_by(F.struct("k", "t"), "place").alias("f")).select("s", "f.k", "f.t")
    bucket = F.floor(F.col("t") / span)
    one = first.withColumn("bucket", bucket)
    other = rows.select(F.col("s").alias("s2"), F.col("k").alias("k2"), F.col("t").alias("t2"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = (F.col("s") != F.col("s2")) & (F.abs(F.col("t") - F.col("t2")) <= span) & (X.hamming(F.col("s"), F.col("s2")) <= most)
    return ordered_pair(one.join(other.hint("merge"), "bucket").where(near), "k", "k2").distinct()


def equal_key_star(df: DataFrame, *, key: str, on: str, order: list[str]) -> DataFrame:
    """The first row of each bucket of equal values paired with the others: n - 1 pairs for n rows."""
    first = df.where(F.col(on).isNotNull()).groupBy(on).agg(F.min_by(key, F.struct(*order, key)).alias("first"))
    return ordered_pair(df.join(first, on).where(F.col(key) != F.col("first")), "first", key)


def representative_pairs(df: DataFrame, *, key: str, signature: str, order: list[str], most: int = 10) -> DataFrame:
    """Pairs across signatures at most ``most`` bits apart: each one's first row with all rows of the other, each pair once;
    buckets stay linear. ``df`` may have rows of one key and signature several times."""
    rows = df.where(F.col(signature).isNotNull())
    return ordered_pair(near_pairs(leading(rows, key=key, signature=signature, order=order), most=most), "k", "k2")


def leading(df: DataFrame, *, key: str, signature: str, order: list[str]) -> DataFrame:
    """(k, s, lead): the rows' keys and signatures, and whether a row is the first of its signature."""
    first = df.groupBy(F.col(signature).alias("s")).agg(F.min_by(key, F.struct(*order, key)).alias("first"))
    return df.select(F.col(key).alias("k"), F.col(signature).alias("s")).distinct().join(first, "s").select("k", "s", (F.col("k") == F.col("first")).alias("lead"))


def within_group_pairs(df: DataFrame, *, key: str, by: list[str]) -> DataFrame:
    """All pairs inside (small) groups."""
    a, b = df.select(*by, F.col(key).alias("src")), df.select(*by, F.col(key).alias("dst"))
    return a.join(b, by).where("src < dst")


def drift(plan: DataFrame, current: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """(key, reasons): rows of a frozen plan that are missing, extra or changed, with the changed fields."""
    p, c = plan.select(key, F.struct(*fields).alias("p")), current.select(key, F.struct(*fields).alias("c"))
    reasons = [F.when(F.col("c").isNull(), F.lit("missing")), F.when(F.col("p").isNull(), F.lit("extra"))]
    both = F.col("p").isNotNull() & F.col("c").isNotNull()
    reasons += [F.when(both & ~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")), F.lit(f"changed:{f}")) for f in fields]
    return p.join(c, key, "full").select(key, F.array_compact(F.array(*reasons)).alias("reasons")).where(F.size("reasons") > 0)


def pair_provenance(pairs: DataFrame, members: DataFrame, *, key: str, group: str) -> DataFrame:
    """Pairs with the sorted pair of their groups; null if either side has none."""
    m = members.select(key, F.col(group).alias("g"))
    both = pairs.join(m.select(F.col(key).alias("src"), F.col("g").alias("gs")), "src", "left").join(m.select(F.col(key).alias("dst"), F.col("g").alias("gd")), "dst", "left")
    return both.withColumn("episode_pair", F.when(F.col("gs").isNotNull() & F.col("gd").isNotNull(), F.array_join(F.array_sort(F.array(F.col("gs").cast("string"), F.col("gd").cast("string"))), "|"))).drop("gs", "gd")


def cosine_pairs(df: DataFrame, *, key: str, vector: str, threshold: float, by: list[str], block: int = 512) -> DataFrame:
    """Pairs of a partition whose cosine reaches ``threshold``: (by, src, dst, cosine). See :mod:`gleaner.operators.pivots`."""
    return angle_pairs(df, key=key, vector=vector, threshold=threshold, by=by, block=block)


def preference_products(df: DataFrame, *, by: list[str], key: str, label: str) -> DataFrame:
    """Each chosen item of a round against each rejected one: (by, preferred, other)."""
    return df.where(f"{label} = 1").select(*by, F.col(key).alias("preferred")).join(df.where(f"{label} = 0").select(*by, F.col(key).alias("other")), by)


def scene_pairs(pairs: DataFrame, evidence: dict[str, Column]) -> DataFrame:
    """Pairs of one moment that rest on what is seen in both: confirmed, alike in vector, pixels, histogram, shape and
    signatures, and no exact copies. Missing evidence rejects a pair. ``evidence`` as for ``confirm_pair``."""
    e = evidence
    seen = (e["cos"] >= 0.96) & (e["mae"] <= 0.18) & (e["hist"] >= 0.80) & (e["aspect"] <= 0.08) & (e["phash"] <= 16) & (e["dhash"] <= 18)
    return pairs.where(F.coalesce(seen & ~F.coalesce(e["same_hash"], F.lit(False)), F.lit(False)) & X.confirm_pair(e))
