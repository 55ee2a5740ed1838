"""Operator 13: fingerprints of documents from their improbable features.

Every window of bytes of a text has an entropy; how rare that level of entropy is among all windows of all documents
ranks it. A window that is the rarest around it for long enough is a feature; the features of a text go, in order, into
a chain of Bloom filters of fixed size. Two chains are as alike as the bits that their best filters share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, shuffle_partitions, table, trim
from gleaner.llm.hashing import mix, prefix_sums, stretch_hashes, window_minima
from gleaner.llm.passages import BATCH_BYTES, text_batches

#: Bytes of a window; windows that compete (no more than its bytes, so that texts laid end to end never do); how many
#: of these contests a feature wins at least.
WINDOW, RIVALS, WINS = 16, 16, 8
#: Steps of entropy, and the level below which a window (a run of few different bytes) comes last.
LEVELS, DULL = 1000, 400
#: Bits of a filter, bits of a feature and features of a filter.
BITS, HASHES, FEATURES = 2048, 5, 160
#: The share of the way from chance to equality that counts as nothing.
CUTOFF = 0.3
#: Bytes whose entropies are summed at a time (they stay in a core's cache), those of a text taken at a time, and those of a block of documents.
STRIP, PIECE, BLOCK = 1 << 16, 1 << 18, 8 << 20
_SCALE = 1 << 20


def entropy_levels(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy of each window of bytes by its first place, in LEVELS steps of the greatest possible (integers throughout).

    With c bytes of one value the sum of c log c changes, as a byte enters or leaves, by what the number of equal
    bytes in the window tells; those are counted for all places at once, one distance after the other.
    """
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    count = np.arange(1, window + 1)
    weight = np.diff(np.rint(count * np.log2(count) * _SCALE).astype(np.int64), prepend=0)
    most = int(weight.sum())
    entering, leaving = np.empty(len(data), dtype=np.int64), np.empty(len(data), dtype=np.int64)
    for at in range(0, len(data), STRIP):
        first, end = max(0, at - window), min(len(data), at + STRIP + window)
        part = data[first:end]
        before, after = np.zeros(len(part), dtype=np.uint8), np.zeros(len(part), dtype=np.uint8)
        for d in range(1, min(window, len(part))):
            same = (part[d:] == part[:-d]).view(np.uint8)
            before[d:] += same
            after[:-d] += same
        entering[at : at + STRIP] = weight[before[at - first :][:STRIP]]
        leaving[at : at + STRIP] = weight[after[at - first :][:STRIP]]
    total = np.cumsum(entering)[window - 1 :]
    total[1:] -= np.cumsum(leaving)[: n - 1]
    return (most - total) * LEVELS // most


def _inside(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For texts of these sizes laid end to end: at which bytes a window begins that lies in one text."""
    ends = np.cumsum(sizes)
    change = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.int8)
    np.add.at(change, np.maximum(ends - sizes, ends - window + 1), 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change, dtype=np.int8)[:-1] == 0


def rarity(docs: DataFrame, *, text_col: str = "text") -> tuple[np.ndarray, int]:
    """The rank of each level of entropy, the rarest among all windows of all texts first and dull ones last, and the
    bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = np.zeros(LEVELS + 1, dtype=np.int64), 0
        for rows in text_batches(batches, 0):
            sizes = np.array([len(raw) for (raw,) in rows], dtype=np.int64)
            data, inside = np.frombuffer(b"".join(raw for (raw,) in rows), dtype=np.uint8), _inside(sizes)
            size += len(data)
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                levels = entropy_levels(data[at : at + PIECE + WINDOW - 1])
                counts += np.bincount(levels[inside[at : at + len(levels)]], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 2)), pa.array(np.append(counts, size))], ["level", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 2, dtype=np.int64)
    for r in found:
        counts[r["level"]] = r["n"]
    level = np.arange(LEVELS + 1)
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[np.lexsort((-level, counts[:-1], level < DULL))] = level
    return ranks, int(counts[-1])


def features(texts: list[bytes], ranks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places of each text's features, ascending, and their 64-bit hashes.

    A window wins a contest of RIVALS neighbours by rank, then by hash, then by place; WINS contests make it a feature.
    A text shorter than a window is its own feature, an empty one has none.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data, inside = np.frombuffer(b"".join(texts), dtype=np.uint8), _inside(sizes)
    n = max(len(data) - WINDOW + 1, 0)
    places, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    none = np.full(RIVALS - 1, np.iinfo(np.int64).max)
    for lo in range(0, n, PIECE):
        first, hi = max(0, lo - RIVALS + 1), min(n, lo + PIECE)
        part = data[first : min(n, hi + RIVALS - 1) + WINDOW - 1]
        rank = ranks[entropy_levels(part)]
        start = np.arange(len(rank))
        own = stretch_hashes(prefix_sums(part), start, start + WINDOW)
        # Ten bits of rank, thirty of hash and the place within the piece.
        key = (rank << 53) | ((own >> np.uint64(34)).astype(np.int64) << 22) | start
        key[~inside[first : first + len(key)]] = none[0]
        best = window_minima(np.concatenate([none, key, none]), RIVALS)
        wins = np.bincount(best[best < none[0]] & ((1 << 22) - 1), minlength=len(key))[: len(key)]
        won = np.flatnonzero(wins >= WINS)
        won = won[(won + first >= lo) & (won + first < hi)]
        places.append(won + first)
        hashes.append(own[won])
    place, own = np.concatenate(places), np.concatenate(hashes)
    begin = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(place, np.append(begin, len(data)))
    out = [(place[i:j] - b, own[i:j]) for i, j, b in zip(cuts.tolist(), cuts[1:].tolist(), begin.tolist())]
    for k in np.flatnonzero((sizes > 0) & (sizes < WINDOW)).tolist():
        out[k] = np.zeros(1, dtype=np.int64), stretch_hashes(prefix_sums(np.frombuffer(texts[k], dtype=np.uint8)), np.zeros(1, dtype=np.int64), np.array([len(texts[k])]))
    return out


class Chain:
    """Bloom filters (packed bits, one row each) of a text's different features in order, FEATURES to a filter."""

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters
        self.ones = np.bitwise_count(filters.view(np.uint64)).sum(axis=1).astype(np.float64)
        self.sizes = np.minimum(FEATURES, n - FEATURES * np.arange(len(filters))).astype(np.float64)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Chain:
        hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
        count = -(-len(hashes) // FEATURES)
        bits = np.zeros(count * BITS, dtype=np.uint8)
        mixed = mix(hashes)
        base = np.arange(len(hashes)) // FEATURES * BITS
        for k in range(HASHES):
            bits[base + ((mixed >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        return cls(len(hashes), np.packbits(bits).reshape(count, BITS // 8))

    @classmethod
    def parse(cls, text: str) -> Chain:
        n, raw = text.split(":")
        return cls(int(n), np.frombuffer(base64.b64decode(raw), dtype=np.uint8).reshape(-1, BITS // 8))

    def __str__(self) -> str:
        """The number of features and the filters, base 64."""
        return f"{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}"

    def likeness(self, other: Chain) -> float:
        """From 0 to 1: for each filter of the shorter chain the best match in the longer, weighed by its features; of
        chains of equal length both ways, halved. Equal chains are 1, an empty one and another 0."""
        if self.n == other.n and np.array_equal(self.filters, other.filters):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        a, b = (self, other) if len(self.filters) <= len(other.filters) else (other, self)
        x, y = a.filters.view(np.uint64), b.filters.view(np.uint64)
        empty = (1 - 1 / BITS) ** HASHES
        down, across = np.zeros(len(x)), np.zeros(len(y))
        step = max(1, (1 << 16) // len(x))
        for k in range(0, len(y), step):
            shared = np.bitwise_count(x[:, None, :] & y[None, k : k + step]).sum(axis=2).astype(np.float64)
            most = np.minimum(a.ones[:, None], b.ones[None, k : k + step])
            s, t = a.sizes[:, None], b.sizes[None, k : k + step]
            chance = BITS * (1 - empty**s - empty**t + empty ** (s + t))
            # Of a few bits, two deviations from chance are more than that share.
            floor = chance + np.maximum(CUTOFF * np.maximum(most - chance, 0), 2 * np.sqrt(chance))
            score = np.where(most > floor, np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1), (shared >= most).astype(np.float64))
            down = np.maximum(down, score.max(axis=1))
            across[k : k + step] = score.max(axis=0)
        found = float(down @ a.sizes / a.sizes.sum())
        return found if len(x) < len(y) else (found + float(across @ b.sizes / b.sizes.sum())) / 2


def fingerprint(docs: DataFrame, ranks: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, fingerprint): one row per document, for the ranks of :func:`rarity`.

    A null or empty text has no feature, a text shorter than a window is one. Equal texts have equal fingerprints, repeated
    rows and null ids each their row; very long texts go through in pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, 1):
            chains = [Chain.of(h) for _, h in features([raw for _, raw in rows], ranks)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([c.n for c in chains], pa.int64()), pa.array([str(c) for c in chains])], ["doc_id", "n_features", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_features long, fingerprint string")


def compare(pairs: DataFrame, one: str, other: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of the fingerprints in two of its columns (null where either is)."""

    @F.pandas_udf("double")
    def likeness(x, y):
        return x.combine(y, lambda a, b: None if a is None or b is None else Chain.parse(a).likeness(Chain.parse(b)))

    return pairs.withColumn(name, likeness(one, other))


def in_order(docs: DataFrame, *, blocks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, guest, doc_id, packed, key): the documents in blocks of neighbouring ids, each sorted within its partition, their
    texts as :func:`unpacked` reads them.

    Null ids come first; rows of one id are ordered by ``key``, a hash of their texts, and lie in one block. Each block ends with
    a ``guest``, the first document of the next block (of the first one, after the last).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shares = [k / blocks for k in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares or [0.5], 20 * blocks).alias("cuts")).first()["cuts"] or []
    first = rows.agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("key"))).alias("first")).first()["first"]
    bounds = np.unique(np.array(cuts if shares else [], dtype=np.int64))
    bounds = bounds[bounds > first["doc_id"]] if first and first["doc_id"] is not None else bounds

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress  # whole texts go through the shuffle
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            block = np.where(named, np.searchsorted(bounds, ids, side="right"), 0)
            at_bound = np.flatnonzero(named & (block > 0) & (bounds[np.maximum(block - 1, 0)] == ids)) if len(bounds) else np.zeros(0, dtype=np.int64)
            is_first = batch.column(0).is_null().to_numpy(zero_copy_only=False) if first["doc_id"] is None else named & (ids == first["doc_id"])
            leading = np.flatnonzero(is_first & (batch.column(2).to_numpy() == first["key"]))
            take = np.concatenate([np.arange(len(ids)), at_bound, leading])
            where = np.concatenate([block, block[at_bound] - 1, np.full(len(leading), len(bounds))])
            guest = np.arange(len(take)) >= len(ids)
            for at in range(0, len(take), 512):
                some = slice(at, at + 512)
                out = batch.take(pa.array(take[some]))
                packed = [press((t or "").encode("utf-8", "surrogatepass")) for t in out.column(1).to_pylist()]
                columns = [pa.array(where[some].astype(np.int32)), pa.array(guest[some]), out.column(0), pa.array(packed, pa.binary()), out.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "guest", "doc_id", "packed", "key"])

    dealt = rows.withColumn("key", F.xxhash64("text")).mapInArrow(deal, "block int, guest boolean, doc_id long, packed binary, key long")
    return dealt.repartition(max(blocks, shuffle_partitions(docs.sparkSession)), "block").sortWithinPartitions("block", "guest", "doc_id", "key")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of :func:`in_order` as (block, guest, doc_id, UTF-8 bytes of the text), gathered to about BATCH_BYTES."""
    read = zstandard.ZstdDecompressor().decompress
    rows, width = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            for block, guest, doc, packed, _ in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns)):
                rows.append((block, guest, doc, read(packed)))
                width += len(rows[-1][3])
                if width >= BATCH_BYTES:
                    yield rows
                    rows, width = [], 0
                    trim()
    if rows:
        yield rows
    trim()


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, *, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The edited text ends with the beginning of the next document in place of its own last n_chars // ``share`` code points.
    A null text counts as empty. The order, and the next of the last, is :func:`in_order`'s; a repeated row is a document
    of its own; a single document is its own next; an empty table gives no row; other columns are not read.
    """
    ranks, size = rarity(docs, text_col=text_col)
    blocks = max(shuffle_partitions(docs.sparkSession), -(-size // BLOCK))

    def results(rows: list[tuple]) -> pa.RecordBatch | None:
        """The rows that are no guests; each one's successor stands after it."""
        texts = [r[3].decode("utf-8", "surrogatepass") for r in rows]
        found = features([r[3] for r in rows], ranks)
        chains = [Chain.of(h) for _, h in found]
        edited, tails, held = [], [], []
        for k in range(len(rows) - 1):
            part = len(texts[k]) // share
            head = texts[k][: len(texts[k]) - part].encode("utf-8", "surrogatepass")
            edited.append(head + texts[k + 1][:part].encode("utf-8", "surrogatepass"))
            # Up to here a window and all its rivals lie in what has stayed.
            stays = max(0, len(head) - WINDOW - RIVALS + 2) if len(rows[k][3]) >= WINDOW <= len(edited[-1]) else 0
            held.append(stays)
            tails.append(edited[-1][max(0, stays - RIVALS + 1) :])
        out = []
        for k, (place, own) in enumerate(features(tails, ranks)):
            if rows[k][1]:
                continue
            old = found[k][0] < held[k]
            new = place + max(0, held[k] - RIVALS + 1) >= held[k]
            chain = Chain.of(np.concatenate([found[k][1][old], own[new]]))
            out.append((rows[k][2], len(texts[k]), hashlib.sha256(edited[k]).hexdigest(), str(chains[k]), str(chain), chains[k].likeness(chain), chains[k].likeness(chains[k + 1])))
        fields = [x.split() for x in EDITED.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], [n for n, _ in fields]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []
        for rows in unpacked(batches):
            # The last row waits for its successor; of the guests of a block only the first counts, as the one after its last row.
            rows = before + rows
            if done := results(rows) if len(rows) > 1 else None:
                yield done
            before = rows[-1:]

    # Written here, as whole texts go to the workers in small batches only while a step is written.
    return materialize(in_order(docs, blocks=blocks, id_col=id_col, text_col=text_col).mapInArrow(run, EDITED), "edited")


def op13_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how like they and the next document's are."""
    return edited_pairs(table(spark, sf_dir, "documents"))
