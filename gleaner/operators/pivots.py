"""Pairs of vectors by angle, with pivots: a tree of blocks, each with a centre and the widest angle from it.

Angles obey the triangle inequality, so two nodes whose centres are further apart than their radii and the wanted angle
hold no pair; nothing below them is looked at. Only blocks that may hold a pair meet, and are multiplied as matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.sources.tables import materialize

#: Rounding of angles near 0.
SLACK = 1e-6
#: Rows of a block that are looked at for its pivots, on average, and rounds of splitting; blocks of copies are cut by hash then.
CANDIDATES, ROUNDS = 64, 8


def blocks_of(rows: DataFrame, *, block: int, fanout: int) -> DataFrame:
    """``rows`` (_by, k, v) with the ``path`` of their block: blocks of more than ``block`` rows are split by the nearest
    of ``fanout`` of their own rows, again and again; what doesn't part is cut by hash."""
    rows = materialize(rows.withColumn("path", F.array().cast("array<int>")))
    own = F.xxhash64("k")
    for turn in range(ROUNDS + 1):
        large = rows.groupBy("_by", "path").agg(F.count("*").alias("n")).where(F.col("n") > block)
        if not large.head(1):
            break
        if turn == ROUNDS:
            cut = F.array(F.pmod(own, F.ceil(F.col("n") / block)).cast("int"))
            return materialize(rows.join(large, ["_by", "path"], "left").withColumn("path", F.when(F.col("n").isNull(), F.col("path")).otherwise(F.concat("path", cut))).drop("n"))
        some = rows.join(large, ["_by", "path"]).where(F.pmod(own, F.ceil(F.col("n") / CANDIDATES)) == 0)
        pivots = some.groupBy("_by", "path").agg(F.slice(F.array_sort(F.collect_list(F.struct(own.alias("h"), "v"))), 1, fanout).alias("pivots"))
        met = rows.join(pivots.select("_by", "path", F.transform("pivots", lambda p: p["v"]).alias("pivots")), ["_by", "path"], "left")
        near = F.transform("pivots", lambda p: X.dot(F.col("v"), p))
        place = F.array((F.array_position(near, F.array_max(near)) - 1).cast("int"))
        rows = materialize(met.withColumn("path", F.when(F.col("pivots").isNull(), F.col("path")).otherwise(F.concat("path", place))).drop("pivots"))
    return rows


def _angle(a: Column, b: Column) -> Column:
    return F.acos(X.clamp(X.dot(a, b), -1.0, 1.0))


def _parents(nodes: DataFrame) -> DataFrame:
    """(_by, path, n, total, centre, radius) of the nodes above these, a node's children being at most its fan-out."""
    up = nodes.withColumnRenamed("centre", "child").withColumn("path", F.expr("slice(path, 1, size(path) - 1)"))
    summed = up.groupBy("_by", "path").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
    total = F.aggregate("totals", F.transform(F.col("totals")[0], lambda x: F.lit(0.0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    summed = summed.select("_by", "path", "n", total.alias("total"))
    length = F.greatest(X.norm(F.col("total")), F.lit(1e-300))
    summed = summed.withColumn("centre", F.transform("total", lambda x: x / length))
    wide = up.join(summed.select("_by", "path", F.col("centre").alias("middle")), ["_by", "path"]).groupBy("_by", "path").agg(F.max(_angle(F.col("child"), F.col("middle")) + F.col("radius")).alias("radius"))
    return summed.join(wide, ["_by", "path"]).select("_by", "path", "n", "total", "centre", "radius")


def near_blocks(leaves: DataFrame, *, threshold: float) -> DataFrame:
    """(_by, a, b): the pairs of leaves (_by, path, n, total, centre, radius) that may hold a pair, found from the root down.

    Both nodes of a pair go down together; a leaf waits for the other.
    """
    depth = leaves.agg(F.coalesce(F.max(F.size("path")), F.lit(0)).alias("d")).first()["d"]
    levels = [materialize(leaves)]
    for d in range(depth, 0, -1):
        deepest = levels[-1].where(F.size("path") == d)
        levels.append(materialize(levels[-1].where(F.size("path") < d).unionByName(_parents(deepest))))
    levels.reverse()  # levels[d]: the nodes of depth d, and the leaves above
    wanted = math.acos(min(1.0, max(-1.0, threshold))) + SLACK
    pairs = levels[0].select("_by", F.col("path").alias("a"), F.col("path").alias("b"))
    for d, nodes in enumerate(levels[1:], 1):
        # A leaf above this depth is its own child.
        parent = F.when(F.size("path") == d, F.expr("slice(path, 1, size(path) - 1)")).otherwise(F.col("path"))
        x, y = (nodes.select("_by", parent.alias(s), F.col("path").alias(f"{s}2"), F.col("centre").alias(f"{s}_centre"), F.col("radius").alias(f"{s}_radius")) for s in "ab")
        met = pairs.join(x, ["_by", "a"]).join(y, ["_by", "b"]).where((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2")))
        may = (F.col("a2") == F.col("b2")) | (_angle(F.col("a_centre"), F.col("b_centre")) - F.col("a_radius") - F.col("b_radius") <= wanted)
        pairs = materialize(met.where(may).select("_by", F.col("a2").alias("a"), F.col("b2").alias("b")))
    return pairs


def angle_pairs(df: DataFrame, *, key: str, vector: str, threshold: float, by: list[str], block: int = 512, fanout: int = 16) -> DataFrame:
    """Pairs of a partition whose cosine reaches ``threshold``: (by, src, dst, cosine), src < dst.

    Vectors of different lengths never meet; null, zero and non-finite ones meet none, and rows of one key no others of it.
    Blocks travel as matrices of bytes, and no task holds more than two.
    """
    kinds = dict(df.dtypes)
    plain = df.select(F.struct(*by, F.size(vector).alias("_size")).alias("_by"), F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    length = X.norm(F.col("v"))
    unit = plain.withColumn("_n", length).where((F.col("_n") > 1e-8) & ~F.isnan("_n") & (F.col("_n") < math.inf)).select("_by", "k", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    rows = blocks_of(unit, block=block, fanout=fanout)

    def pack(group: pa.Table) -> pa.Table:
        m = np.stack([np.asarray(v) for v in group.column("v").to_pylist()])
        total = m.sum(axis=0)
        centre = total / max(np.linalg.norm(total), 1e-300)
        radius = float(np.arccos(np.clip(m @ centre, -1, 1)).max())
        return pa.table({
            "_by": group.column("_by").slice(0, 1), "path": group.column("path").slice(0, 1), "n": pa.array([len(m)], pa.int64()), "total": [total.tolist()], "centre": [centre.tolist()],
            "radius": [radius], "ks": pa.array([group.column("k").to_pylist()], pa.list_(group.schema.field("k").type)), "m": pa.array([m.tobytes()], pa.binary()),
        })

    kind = dict(rows.dtypes)
    packed = materialize(rows.groupBy("_by", "path").applyInArrow(pack, f"_by {kind['_by']}, path array<int>, n long, total array<double>, centre array<double>, radius double, ks array<{kind['k']}>, m binary"))
    near = near_blocks(packed.select("_by", "path", "n", "total", "centre", "radius"), threshold=threshold)
    x, y = (packed.select("_by", F.col("path").alias(s), F.col("ks").alias(f"k{s}"), F.col("m").alias(f"m{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ka, kb = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("ka", "kb"))
                a, b = (np.frombuffer(row.column(c)[0].as_buffer(), dtype=np.float64) for c in ("ma", "mb"))
                c = a.reshape(len(ka), -1) @ b.reshape(len(kb), -1).T
                i, j = np.nonzero((c >= threshold) & (ka[:, None] != kb[None, :]))
                src, dst, c = np.minimum(ka[i], kb[j]), np.maximum(ka[i], kb[j]), np.clip(c[i, j], -1, 1)
                _, once = np.unique(np.stack([src, dst]), axis=1, return_index=True)
                own = pa.array([row.column("_by")[0].as_py()] * len(once), batch.schema.field("_by").type)
                yield pa.RecordBatch.from_arrays([own, pa.array(src[once], row.column("ka").type.value_type), pa.array(dst[once], row.column("ka").type.value_type), pa.array(c[once])], ["_by", "src", "dst", "cosine"])

    met = near.join(x, ["_by", "a"]).join(y, ["_by", "b"]).select("_by", "ka", "kb", "ma", "mb")
    found = met.mapInArrow(run, f"_by {kind['_by']}, src {kinds[key]}, dst {kinds[key]}, cosine double")
    return found.select(*(F.col("_by")[c].alias(c) for c in by), "src", "dst", "cosine")
