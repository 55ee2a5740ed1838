"""Order-dependent choices inside scenes of any size: first-fit stacks and novelty-aware subsets.

Both follow a sequential rule to the letter, but no task holds a whole scene. Stacks are filled block by block of rows;
what the earlier stacks answer to a block is worked out in parts. Subsets take many picks a round: values only fall, so
the best of the leading rows stands as long as it beats what every row left out could still have.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import expressions as X
from gleaner.operators.segmented import ranged, scan
from gleaner.sources.tables import materialize

#: Rows of a scene placed at a time, stacked rows that a task compares them with, and leading rows of a part.
BLOCK, PART, LEADING = 1024, 8192, 256


def _unit(vector: str) -> Column:
    length = F.greatest(X.norm(F.col(vector)), F.lit(1e-8))
    return F.transform(vector, lambda x: x.cast("double") / length).alias("v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; those of another length (or null) become NaN, which compares with nothing."""
    out = np.full((len(column), width), np.nan)
    for k, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == width:
            out[k] = [np.nan if x is None else x for x in v]
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((len(v) for c in columns for v in c.to_pylist() if v is not None), default=0)


def complete_link_stacks(df: DataFrame, *, by: list[str], key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """First-fit stacks in key order: an item joins the first stack alike to all its members: (by, key, stack from 0).

    Scenes of up to ``block`` rows go to one task each. Larger ones are placed in blocks of so many rows: a block's rows
    ask the stacks so far which of them they fit. Of these the first ``block`` are enough, as every other row of the
    block closes one stack at most. The vectors of a scene have one length; a null one is alike to none. Keys are unique.
    """
    rows = ranged(df.select(*by, F.col(key).alias("k"), _unit(vector)), by=by, order=["k"])
    rows = scan(rows, order=["k"], number="place").withColumn("turn", F.floor((F.col("place") - 1) / block).cast("int"))
    rows = materialize(rows.select("_by", "turn", "place", "k", "v"))
    kind, item = dict(rows.dtypes)["_by"], dict(df.dtypes)[key]
    placed_type = f"_by {kind}, k {item}, v array<double>, stack long"

    def place(rows: pa.Table, fits: pa.Table | None) -> pa.Table:
        """Put a block's rows in order; ``fits``: (place, stacks) that the stacks so far allow, in their order."""
        rows = rows.sort_by("place")
        v = _matrix(rows.column("v"), _width(rows.column("v")))
        alike = (v @ v.T) >= threshold
        allowed = dict(zip(fits.column("place").to_pylist(), fits.column("stacks").to_pylist())) if fits is not None else {}
        first = fits.column("stacks_so_far").to_pylist()[0] if fits is not None and len(fits) else 0
        joined: dict[int, list[int]] = {}  # old stacks: the block's rows in them
        new: list[list[int]] = []
        at = []
        for i, p in enumerate(rows.column("place").to_pylist()):
            stack = next((s for s in allowed.get(p) or () if all(alike[i, m] for m in joined.get(s, ()))), None)
            if stack is not None:
                joined.setdefault(stack, []).append(i)
            else:
                k = next((k for k, own in enumerate(new) if alike[i, own].all()), len(new))
                if k == len(new):
                    new.append([])
                new[k].append(i)
                stack = first + k
            at.append(stack)
        return pa.table({"_by": rows.column("_by"), "k": rows.column("k"), "v": rows.column("v"), "stack": pa.array(at, pa.int64())})

    placed = materialize(rows.where("turn = 0").select("_by", "place", "k", "v").groupBy("_by").applyInArrow(lambda t: place(t, None), placed_type))
    last = rows.agg(F.max("turn").alias("t")).first()["t"] or 0

    def fit(asking: pa.Table, held: pa.Table) -> pa.Table:
        """(_by, place, stacks): of a part's stacks those that each row fits."""
        width = _width(asking.column("v"), held.column("v"))
        held = held.sort_by("stack")
        stack = held.column("stack").to_numpy()
        heads = np.flatnonzero(np.append(True, stack[1:] != stack[:-1])) if len(stack) else np.zeros(0, dtype=np.int64)
        good = _matrix(asking.column("v"), width) @ _matrix(held.column("v"), width).T >= threshold
        fits = np.logical_and.reduceat(good, heads, axis=1) if len(heads) else np.zeros((len(asking), 0), dtype=bool)
        found = [stack[heads[np.flatnonzero(row)[:block]]].tolist() for row in fits]
        return pa.table({"_by": asking.column("_by"), "place": asking.column("place"), "stacks": pa.array(found, pa.list_(pa.int64()))})

    for turn in range(1, last + 1):
        own = rows.where(F.col("turn") == turn).select("_by", "place", "k", "v")
        sizes = placed.join(own.select("_by").distinct(), "_by").groupBy("_by").agg(F.ceil(F.count("*") / PART).alias("parts"), (F.max("stack") + 1).alias("stacks_so_far"))
        sizes = materialize(sizes)
        held = placed.join(sizes, "_by").withColumn("part", F.pmod(F.xxhash64("stack"), F.col("parts")))
        asking = own.join(sizes, "_by").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        answers = asking.select("_by", "part", "place", "v").groupBy("_by", "part").cogroup(held.select("_by", "part", "stack", "v").groupBy("_by", "part")).applyInArrow(fit, f"_by {kind}, place long, stacks array<long>")
        fits = answers.groupBy("_by", "place").agg(F.slice(F.array_sort(F.flatten(F.collect_list("stacks"))), 1, block).alias("stacks")).join(sizes.select("_by", "stacks_so_far"), "_by")
        more = own.groupBy("_by").cogroup(fits.groupBy("_by")).applyInArrow(place, placed_type)
        placed = materialize(placed.unionByName(more)) if turn % 16 == 0 else placed.unionByName(materialize(more))
    return placed.select(*(F.col("_by")[c].alias(c) for c in by), F.col("k").alias(key), F.col("stack").cast("int").alias("stack"))


def ranked_subset(df: DataFrame, *, by: list[str], key: str, vector: str, rank: str, density: float = 1.0, protected: str | None = None, render: str | None = None, part: int = PART, leading: int = LEADING) -> DataFrame:
    """Novelty-aware choice from each scene: (by, key, place), as many as the root of its size times ``density``, rounded up.

    Protected rows come first, by rank; without any, the row of the highest rank (ties to the greater key). Then always the
    row of the greatest .70 rank + .30 novelty, ties by rank and key, where novelty is 1 less the greatest similarity to a
    chosen row, .65 without one; a row whose ``render`` a chosen one has is passed over. Ranks lie within 0..1; null ones count as 0.
    """
    rows = df.select(
        F.struct(*by).alias("_by"), F.col(key).alias("k"), _unit(vector), F.coalesce(F.col(rank).cast("double"), F.lit(0.0)).alias("r"),
        (F.coalesce(F.col(protected), F.lit(False)) if protected else F.lit(False)).alias("p"), (F.col(render).cast("string") if render else F.lit(None).cast("string")).alias("h"),
    )
    sizes = rows.groupBy("_by").agg(F.count("*").alias("n"), F.count_if("p").alias("kept"), F.ceil(F.count("*") / part).alias("parts"))
    budget = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.sqrt("n") * density), F.col("kept"))).alias("budget")
    sizes = materialize(sizes.select("_by", "parts", "kept", budget))
    rows = rows.join(sizes, "_by").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
    rows = materialize(rows.withColumns({"most": F.lit(None).cast("double"), "shut": F.lit(False)}).select("_by", "part", "k", "v", "r", "p", "h", "most", "shut"))
    kind, item = dict(rows.dtypes)["_by"], dict(df.dtypes)[key]
    row_type = f"_by {kind}, part long, k {item}, v array<double>, r double, p boolean, h string, most double, shut boolean"

    def value(most: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.round(0.7 * r + 0.3 * np.where(np.isnan(most), 0.65, np.maximum(0, 1 - most)), 12)

    def update(own: pa.Table, chosen: pa.Table) -> pa.Table:
        """A part's rows after the newly ``chosen`` (k, v, h) of its scene."""
        if not len(chosen) or not len(own):
            return own
        width = _width(own.column("v"), chosen.column("v"))
        sim = _matrix(own.column("v"), width) @ _matrix(chosen.column("v"), width).T
        best = np.fmax.reduce(np.clip(sim, -1, 1), axis=1)
        most = np.fmax(own.column("most").to_numpy(zero_copy_only=False).astype(np.float64), best)
        taken, renders = set(chosen.column("k").to_pylist()), {h for h in chosen.column("h").to_pylist() if h is not None}
        shut = [s or k in taken or h in renders for s, k, h in zip(own.column("shut").to_pylist(), own.column("k").to_pylist(), own.column("h").to_pylist())]
        names = own.column_names
        return own.set_column(names.index("most"), "most", pa.array(most, from_pandas=True)).set_column(names.index("shut"), "shut", pa.array(shut, pa.bool_()))

    def lead(own: pa.Table) -> pa.Table:
        """The leading open rows of a part with their value; the last of more than ``leading`` bounds those left out."""
        own = own.filter(pa.array([not s for s in own.column("shut").to_pylist()], pa.bool_()))
        v = value(own.column("most").to_numpy(zero_copy_only=False).astype(np.float64), own.column("r").to_numpy())
        r, k = own.column("r").to_pylist(), own.column("k").to_pylist()
        order = sorted(range(len(v)), key=lambda i: (v[i], r[i], k[i]), reverse=True)[: leading + 1]
        bound = [len(order) > leading and i == leading for i in range(len(order))]
        return own.take(pa.array(order, pa.int64())).append_column("bound", pa.array(bound, pa.bool_()))

    def choose(leaders: pa.Table, state: pa.Table) -> pa.Table:
        """The next picks of a scene: the best leader again and again, while it beats every bound."""
        room, n = (state.column(c)[0].as_py() for c in ("budget", "chosen"))
        bounds = leaders.filter(leaders.column("bound"))
        most, r, k = leaders.column("most").to_numpy(zero_copy_only=False).astype(np.float64), leaders.column("r").to_numpy(), leaders.column("k").to_pylist()
        h, p = leaders.column("h").to_pylist(), leaders.column("p").to_pylist()
        v = _matrix(leaders.column("v"), _width(leaders.column("v")))
        open_ = [not b for b in leaders.column("bound").to_pylist()]
        limit = max(zip(value(bounds.column("most").to_numpy(zero_copy_only=False).astype(np.float64), bounds.column("r").to_numpy()).tolist(), bounds.column("r").to_pylist(), bounds.column("k").to_pylist()), default=None)
        picks: list[int] = []
        while n + len(picks) < room:
            own = value(most, r)
            best = max((i for i in range(len(k)) if open_[i]), key=lambda i: (own[i], r[i], k[i]), default=None)
            if best is None or limit is not None and (own[best], r[best], k[best]) < limit:
                break
            picks.append(best)
            most = np.fmax(most, np.clip(v @ v[best], -1, 1))
            for i in range(len(k)):
                if i == best or h[best] is not None and h[i] == h[best]:
                    open_[i] = False
        got = leaders.take(pa.array(picks, pa.int64())).select(["_by", "k", "v", "h"])
        return got.append_column("place", pa.array([n + i + 1 for i in range(len(picks))], pa.int64()))

    # Protected rows first, else the best: by rank alone.
    first = rows.where("p")
    top = rows.join(sizes.where("kept = 0").select("_by"), "_by").groupBy("_by").agg(F.max_by(F.struct("k", "v", "h"), F.struct("r", "k")).alias("x")).select("_by", "x.k", "x.v", "x.h", F.lit(1).cast("long").alias("place"))
    ordered = ranged(first.select("_by", "k", "v", "h", (-F.col("r")).alias("low")).withColumnRenamed("_by", "own"), by=["own"], order=["low", "k"])
    kept = scan(ordered, order=["low", "k"], number="place").select(F.col("own").alias("_by"), "k", "v", "h", "place")
    new = materialize(kept.unionByName(top))
    done = new
    while True:
        spread = new.join(sizes.select("_by", "parts"), "_by").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("_by", "part", "k", "v", "h")
        rows = materialize(rows.groupBy("_by", "part").cogroup(spread.groupBy("_by", "part")).applyInArrow(update, row_type))
        so_far = done.groupBy("_by").agg(F.count("*").alias("chosen"))
        state = sizes.join(so_far, "_by").where("chosen < budget").select("_by", "budget", "chosen")
        leaders = rows.join(state.select("_by"), "_by").groupBy("_by", "part").applyInArrow(lead, f"{row_type}, bound boolean")
        new = materialize(leaders.groupBy("_by").cogroup(state.groupBy("_by")).applyInArrow(choose, f"_by {kind}, k {item}, v array<double>, h string, place long"))
        if not new.head(1):
            break
        done = materialize(done.unionByName(new))
    return done.select(*(F.col("_by")[c].alias(c) for c in by), F.col("k").alias(key), F.col("place").cast("int").alias("place"))
