"""Operator 9: n-gram Jaccard join on count vectors.

A document is the set of its word shingles. Shingles are hashed to groups; the counts of the groups are a point, and
the summed coordinate minima of two points bound the overlap of two sets from above. An R-tree packs points into boxes
whose tops bound all points below likewise; only pairs of nodes that may hold a link are searched. Pairs that survive are
verified on the sets.

Documents meet without a cross join: in one order of all shingles, two sets that link share one of their first shingles
(n - threshold * n + 1 of n). Rare shingles come first in that order, counted over the whole corpus, so a text of
its own meets nobody and passages that many documents share bring few of them together. What shares such a key is one
bucket. Two rounds compare one member of every bucket with the others, which joins large groups of copies in linear
time; the R-tree then searches the buckets that are still in several components: first for the likeliest partner of each
set, then, where that leaves components apart, for all that may link. Buckets too large for one task are cut into
blocks, and every two blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, holding, materialize, table, trim
from gleaner.llm.components import connected_components
from gleaner.llm.hashing import mix, window_hashes, word_hashes
from gleaner.llm.passages import text_batches

#: A point has about so many groups for each shingle that two linked sets of its size may each have alone.
GROUPS_FOR_EACH = 8
LEAST_GROUPS, MOST_GROUPS = 16, 4096
#: Points in a leaf of the R-tree, children of an inner node, and points of a block.
LEAF, FANOUT, BLOCK = 32, 8, 1024
#: Rounds in which one member of every bucket is compared with the others, before the R-tree takes the rest.
STAR_ROUNDS = 2
#: Shingles are counted and ordered by their number of documents if their hash is in the lowest part of all hashes, of
#: this many times the share of a set's shingles that must be looked at; the others come last, by hash.
COUNTED_SHARE = 1.5
#: Pairs that a task knows to have met before in another bucket.
KNOWN = 1 << 17
#: Bytes of text that are shingled at a time.
TEXTS = 1 << 20
#: Members of a star that meet its centre in one place.
STAR = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words, bounds = word_hashes([t.translate(_LOWER) for t in texts])
    windows, out = window_hashes(words, width), []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - begin
        out.append(np.unique(windows[begin : end - width + 1] if n >= width else window_hashes(words[begin:end], n) if n else words[:0]))
    return out


def set_id(shingles: np.ndarray) -> int:
    """A 63-bit hash of the set."""
    total = mix(shingles ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(total[None])[0] >> np.uint64(1))


def keys_of(shingles: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's counted shingles, and those after them that are needed to make up the first (n - threshold * n + 1)."""
    n, share = len(shingles), min(1.0, COUNTED_SHARE * (den - num) / den)
    counted = int(np.searchsorted(shingles, np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))))
    return shingles[:counted], shingles[counted : first_of(n, num, den)]


def first_of(n: int, num: int, den: int) -> int:
    """How many of a set's first shingles two linked sets have one in common of."""
    return n + (-num * n // den) + 1


def groups_of(n: int, num: int, den: int) -> int:
    """The number of groups of a set's point, a power of two."""
    wanted = GROUPS_FOR_EACH * n * (den - num) // (den + num)
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, wanted - 1).bit_length()))


def point_of(shingles: np.ndarray, num: int, den: int) -> bytes:
    """The counts of the groups, in as few bytes as the largest needs."""
    groups = groups_of(len(shingles), num, den)
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    most = int(counts.max())
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def counts_of(point: bytes, n: int, num: int, den: int) -> np.ndarray:
    groups = groups_of(n, num, den)
    return np.frombuffer(point, dtype=f"<u{len(point) // groups}").astype(np.int32)


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """Points (rows) on fewer groups."""
    return counts if counts.shape[-1] == groups else counts.reshape(len(counts), -1, groups).sum(axis=1, dtype=np.int32)


class Tree:
    """A bulk-loaded R-tree of points, ordered by set size; level 0 holds the leaves' boxes.

    ``left``: how many shingles of each set stand from the common key on. ``places``: of the points in the order of the
    leaves. A box has the largest count of each group, on as many groups as its least point has, and the range of sizes.
    """

    def __init__(self, n: np.ndarray, left: np.ndarray, comp: np.ndarray, counts: list[np.ndarray]):
        self.places = np.argsort(n, kind="stable")
        self.n, self.left, self.comp = n[self.places], left[self.places], comp[self.places]
        own = [(k, min(k + LEAF, len(n))) for k in range(0, len(n), LEAF)]
        self.points = [np.stack([fold(counts[k][None], len(counts[self.places[a]]))[0] for k in self.places[a:b]]) for a, b in own]
        tops = [p.max(axis=0) for p in self.points]
        self.levels = [(own, tops)]
        while len(own) > 1:
            groups = [(k, min(k + FANOUT, len(own))) for k in range(0, len(own), FANOUT)]
            tops = [np.max([fold(t[None], len(tops[i]))[0] for t in tops[i:j]], axis=0) for i, j in groups]
            own = [(own[i][0], own[j - 1][1]) for i, j in groups]
            self.levels.append((own, tops))


def minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed coordinate minima of points, row by row, on the groups that both have."""
    groups = min(a.shape[1], b.shape[1])
    return np.minimum(fold(a, groups), fold(b, groups)).sum(axis=1)


def tree_pairs(p: Tree, q: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in p, places in q, bounds as shares of both sizes) of pairs from different components that may link; p may
    be q."""

    def may(x: tuple[int, int], y: tuple[int, int]) -> bool:
        (a, b), (c, d) = p.levels[x[0]][0][x[1]], q.levels[y[0]][0][y[1]]
        if p.n[b - 1] * den < num * q.n[c] or q.n[d - 1] * den < num * p.n[a]:
            return False
        return minima(p.levels[x[0]][1][x[1]][None], q.levels[y[0]][1][y[1]][None])[0] * (num + den) >= num * (p.n[a] + q.n[c])

    def below(tree: Tree, at: tuple[int, int]) -> list[tuple[int, int]]:
        return [(at[0] - 1, k) for k in range(at[1] * FANOUT, min((at[1] + 1) * FANOUT, len(tree.levels[at[0] - 1][0])))] if at[0] else [at]

    todo = [((len(p.levels) - 1, 0), (len(q.levels) - 1, 0))]
    while todo:
        x, y = todo.pop()
        same = p is q and x == y
        if p is q and x[0] == y[0] and x[1] > y[1] or not (same or may(x, y)):
            continue
        if x[0] or y[0]:
            todo += [(i, j) for i in below(p, x) for j in below(q, y)]
            continue
        (a, b), (c, d) = p.levels[0][0][x[1]], q.levels[0][0][y[1]]
        total = p.n[a:b, None] + q.n[None, c:d]
        good = (p.comp[a:b, None] != q.comp[None, c:d]) & (np.minimum(p.left[a:b, None], q.left[None, c:d]) * (num + den) >= num * total)
        i, j = np.nonzero(np.triu(good, 1) if same else good)
        if len(i):
            bound, total = minima(p.points[x[1]][i], q.points[y[1]][j]), total[i, j]
            near = bound * (num + den) >= num * total
            yield p.places[a + i[near]], q.places[c + j[near]], (bound / total)[near]


def _signatures(rows: DataFrame, *, width: int) -> DataFrame:
    """(doc_id, text_key, n, sid) of every row: set size and hash of the set (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in text_batches(batches, 2, TEXTS):
            sets = shingle_sets([r[2] for r in some], width)
            columns = [[r[0] for r in some], [r[1] for r in some], [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "n", "sid"])

    return rows.mapInArrow(run, "doc_id long, text_key long, n long, sid long")


def _sets(rows: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """One row for each different set: sid, n, text_key of one of its texts, counted (how many of the keys), keys, point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies elsewhere are told apart below
        for some in text_batches(batches, 1, TEXTS):
            some = [r for r in some if not (r[0] in seen or seen.add(r[0]))]
            sets = [(r[0], s, keys_of(s, num, den)) for r, s in zip(some, shingle_sets([r[1] for r in some], width)) if len(s)]
            columns = [
                pa.array([set_id(s) for _, s, _ in sets], pa.int64()), pa.array([len(s) for _, s, _ in sets], pa.int64()), pa.array([k for k, _, _ in sets], pa.int64()),
                pa.array([len(own) for _, _, (own, _) in sets], pa.int64()), pa.array([np.concatenate(keys).view(np.int64) for _, _, keys in sets], pa.list_(pa.int64())),
                pa.array([point_of(s, num, den) for _, s, _ in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "text_key", "counted", "keys", "point"])

    return rows.select("text_key", "text").mapInArrow(run, "sid long, n long, text_key long, counted long, keys array<long>, point binary").dropDuplicates(["sid"])


def _members(sets: DataFrame, *, num: int, den: int) -> DataFrame:
    """(key, sid, n, at): the first shingles of each set that other sets have too, and their place in the common order.

    The order: counted shingles by their number of sets, then the others by hash. A set's shingles that no other set has
    stand at its beginning, so their number is all that is needed of them.
    """
    shared = materialize(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
    held = sets.select("sid", "n", "counted", F.posexplode("keys").alias("place", "key")).join(shared, "key")
    own = F.col("place") < F.col("counted")
    of_set = Window.partitionBy("sid")
    rank = F.row_number().over(of_set.orderBy(~own, "m", "key"))
    at = F.when(own, F.col("counted") - F.sum(own.cast("long")).over(of_set) + rank - 1).otherwise(F.col("place").cast("long"))
    first = F.col("n") + F.floor(F.col("n") * -num / den) + 1
    members = materialize(held.withColumn("at", at).where(F.col("at") < first).select("key", "sid", "n", "at"), "members")
    discard(shared)
    return members


def _needs(n: Column, overlap: Column, num: int, den: int) -> Column:
    """Whether an overlap of so many shingles could do for sets with ``n`` shingles together."""
    return overlap * (num + den) >= n * num


def _meet(n: Column, at: Column, m: Column, place: Column, num: int, den: int) -> Column:
    """Whether sets of n and m shingles whose first common key stands at these places could link."""
    return _needs(n + m, F.least(n - at, m - place), num, den)


def _bounded(pairs: DataFrame, sets: DataFrame, *, num: int, den: int) -> DataFrame:
    """(a, b, bound) of the (a, b) pairs whose points' summed minima would do."""
    p, q = (sets.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"point_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = [int(minima(counts_of(x, n, num, den)[None], counts_of(y, m, num, den)[None])[0]) for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            good = [bound * (num + den) >= num * (n + m) for bound, n, m in zip(bounds, batch.column(2).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds, pa.int64())], ["a", "b", "bound"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(p, "a").join(q, "b").select("a", "b", "n_a", "point_a", "n_b", "point_b").mapInArrow(run, "a long, b long, bound long")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """Of the distinct (a, b) pairs those whose sets link. A centre's set travels once for every STAR members."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    wanted = materialize(sets.select("sid", "text_key").join(wanted, "sid"), "wanted")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for some in text_batches(batches, 1, TEXTS):
            some = [r for r in some if not (r[0] in seen or seen.add(r[0]))]
            found = [s for s in shingle_sets([r[1] for r in some], width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["sid", "shingles"])

    held = holding(rows.select("text_key", "text"), wanted, "text_key", compute, "sid long, shingles binary")
    held = materialize(held.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("cuts"))
    spokes = pairs.join(stars, "a").select("a", F.pmod(F.xxhash64("b"), "cuts").alias("cut"), "b").join(held.select(F.col("sid").alias("b"), "shingles"), "b").select("a", "cut", "b", "shingles")
    centres = stars.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")).join(held.select(F.col("sid").alias("a"), "shingles"), "a")
    ordered = spokes.unionByName(centres.withColumn("b", F.lit(None).cast("long"))).repartition("a", "cut").sortWithinPartitions("a", "cut", F.col("b").asc_nulls_first())

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            good = []
            for b, raw in zip(batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                if b is None:
                    centre = own.copy()
                both = len(np.intersect1d(centre, own, assume_unique=True)) if b is not None else 0
                good.append(b is not None and den * both >= num * (len(centre) + len(own) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            trim()

    links = materialize(ordered.select("a", "cut", "b", "shingles").mapInArrow(link, "a long, b long"), "links")
    discard(wanted, held)
    return links


def _likeliest(pairs: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of the (x, y) rows, for each x and each y the one with the largest share."""
    both, twice = np.concatenate([pairs, pairs[:, ::-1]]), np.concatenate([share, share])
    order = np.lexsort((both[:, 1], -twice, both[:, 0]))
    return both[order[np.unique(both[order, 0], return_index=True)[1]]]


def _tree_pairs(placed: DataFrame, sets: DataFrame, *, likeliest: bool, num: int, den: int) -> DataFrame:
    """(a, b) pairs of different components in one bucket that the R-tree leaves; or one for each set and bucket.
    ``placed``: key, sid, at, comp. Buckets of two are left out: their pair was the first star."""
    open_keys = placed.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("m > 2 and c0 < c1")
    members = placed.join(open_keys.select("key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "key").select("key", "sid", "at", "comp", "blocks")
    block = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = members.withColumn("block", block).select("key", "sid", "at", "comp", "block", other.alias("other")).join(sets.select("sid", "n", "point"), "sid")
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "sid", "comp", "n", "at", "point")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def search(unit: list[tuple]) -> set[tuple[int, int]]:
        """The pairs of one unit of (key, lo, hi, block, sid, comp, n, at, point) rows: all of a block, or of two."""
        lo, hi = unit[0][1:3]
        parts = [part for b in ([lo] if lo == hi else [lo, hi]) if (part := [r for r in unit if r[3] == b])]
        if lo != hi and len(parts) < 2:
            return set()
        columns = [[np.array(c) for c in list(zip(*part))[4:8]] for part in parts]
        trees = [Tree(n, n - at, comp, [counts_of(r[8], r[6], num, den) for r in part]) for (_, comp, n, at), part in zip(columns, parts)]
        found = list(tree_pairs(trees[0], trees[-1], num, den))
        if not found:
            return set()
        pairs = np.concatenate([np.stack([columns[0][0][i], columns[-1][0][j]], axis=1) for i, j, _ in found])
        if likeliest and len(pairs):
            pairs = _likeliest(pairs, np.concatenate([x[2] for x in found]))
        return set(map(tuple, np.sort(pairs, axis=1).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()  # a pair may meet in many buckets
        unit: list[tuple] = []

        def pairs() -> pa.RecordBatch:
            new = search(unit) - known if len(unit) > 1 else set()
            if len(known) > KNOWN:
                known.clear()
            known.update(new)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if unit and row[:3] != unit[0][:3]:
                    yield pairs()
                    unit = []
                unit.append(row)
            trim()
        yield pairs()

    return rows.mapInArrow(run, "a long, b long").distinct()


def _placed(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Members of buckets with their component so far."""
    if parts is None:
        return members.withColumn("comp", F.col("sid"))
    return members.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")


def _apart(pairs: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    if parts is None:
        return pairs
    x, y = (parts.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab")
    both = pairs.join(x, "a", "left").join(y, "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _components(rows: DataFrame, *, width: int, num: int, den: int) -> DataFrame:
    """(sid, comp): the component of every set, named by one of its sets."""
    sure = {"width": width, "num": num, "den": den}
    sets = materialize(_sets(rows, **sure), "sets")
    members = _members(sets, num=num, den=den)
    links = parts = waiting = seen = None

    def unseen(pairs: DataFrame) -> DataFrame:
        if seen is None:
            return pairs
        return pairs.join(seen, [F.least(pairs["a"], pairs["b"]) == seen["lo"], F.greatest(pairs["a"], pairs["b"]) == seen["hi"]], "left_anti")

    # Every open bucket compares one more member with those of its other components: first the one with the fewest
    # shingles before its key, then any that a set of its size could link to.
    late = F.col("at") * (num + den) > F.col("n") * (den - num)
    turns = [F.struct("at", "sid"), *(F.struct(late, F.xxhash64(F.lit(k), "sid")) for k in range(1, STAR_ROUNDS)), True, False]
    for turn in turns:
        placed = _placed(members, parts)
        if isinstance(turn, bool):
            star = unseen(_tree_pairs(placed, sets, likeliest=turn, num=num, den=den)).withColumn("bound", F.lit(0).cast("long"))
        else:
            leaders = placed.groupBy("key").agg(F.min_by(F.struct("sid", "comp", "n", "at"), turn).alias("lead"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key", "lead")
            star = placed.join(leaders, "key").where("comp <> lead.comp").where(_meet(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), num, den))
            star = _bounded(unseen(star.select(F.col("lead.sid").alias("a"), F.col("sid").alias("b")).distinct()), sets, num=num, den=den)
        star = materialize(star, "stars")
        own = star.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
        seen = own if seen is None else seen.union(own)
        open_ = star if waiting is None else star.union(waiting)
        if isinstance(turn, bool):
            pairs = materialize(open_.select("a", "b").distinct(), "pairs")
        else:
            # One pair for each member, with its likeliest centre; the others wait, and most are joined by then.
            pairs = materialize(open_.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a")).select("a", "b"), "pairs")
        if not pairs.head(1):
            continue
        found = _verified(pairs, rows, sets, **sure)
        links = found if links is None else links.union(found)
        parts = materialize(connected_components(links), "components")
        waiting = materialize(_apart(open_.join(pairs, ["a", "b"], "left_anti"), parts), "waiting")
    named = sets.select("sid")
    out = named.withColumn("comp", F.col("sid")) if parts is None else named.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("comp"))
    out = materialize(out, "named")
    discard(sets, members)
    return out


def grouped(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), n_shingles, comp: equal for the documents of one
    component, null without shingles."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, text.isNull()).alias("text_key"), text.alias("text"))
    sigs = materialize(_signatures(rows, width=width), "signatures")
    comps = _components(rows, width=width, num=num, den=den)
    return sigs.join(comps, "sid", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "comp")


def join(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Two documents link when den * intersection >= num * union. Null texts and texts without words have no shingles and
    link with nothing; copies link with each other; repeated rows each get a row. A row without an id keeps its row and
    links like any other; its component_id is null only if no row of its component has an id. Sets are told apart by
    64-bit hashes. Other columns are not read.
    """
    found = grouped(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col)
    first = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return found.join(first, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return join(table(spark, sf_dir, "documents"))
