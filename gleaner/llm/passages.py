"""Operator 3: removal of repeated passages of words by fixed-block anchors.

Every text is cut into blocks of words that don't overlap; a window twice as long holds one block whole. The blocks are
the index, and every rolling run of as many words of every text probes it. A run that meets a block elsewhere anchors
the windows around it; those are extended, window by window, to the maximal exact repeats, and each window's first
place in the corpus is kept.

Hashes travel in packed pieces, one for each batch of texts and bucket of hashes. Of the equal runs and windows of one
batch a single one goes on, so that a passage in very many documents never meets in one task in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table, total_bytes, trim, with_ids
from gleaner.llm.hashing import window_hashes, word_hashes

#: Bytes of text in a batch, and for each bucket of hashes.
BATCH_BYTES = 3 << 20
BUCKET_BYTES = 8 << 20
#: Positions are stored as two bytes within segments of so many words.
SEGMENT = 1 << 16
FIRST_ID = -(1 << 63)

#: Values in two columns, then the heads of segments and the places in them. Without values: an answer on its way.
PIECES = "bucket int, a binary, b binary, c binary, d binary"
ANSWERS = "part int, c binary, d binary"


def _split(bucket: pa.Table) -> tuple[pa.Table, pa.Table]:
    """What a bucket asks, and the answers that only pass through."""
    asks = pc.is_valid(bucket.column("a"))
    return bucket.filter(asks), bucket.filter(pc.invert(asks)).select(["c", "d"])


def text_batches(batches: Iterator[pa.RecordBatch], text: int, size: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """Rows as tuples, the text as UTF-8, gathered to about ``size`` bytes."""
    rows: list[tuple] = []
    width = 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512).to_pydict()
            for row in zip(*part.values()):
                raw = (row[text] or "").encode("utf-8", "surrogatepass")
                rows.append((*row[:text], raw, *row[text + 1 :]))
                width += len(raw)
                if width >= size:
                    yield rows
                    rows, width = [], 0
                    trim()
    if rows:
        yield rows
    trim()


def _record(columns: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns), kinds)], ["bucket", "a", "b", "c", "d"])


def _runs(order: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted places: whether each begins a run of equal values, and the run it belongs to."""
    ranked = values[order]
    head = np.ones(len(ranked), dtype=bool)
    head[1:] = ranked[1:] != ranked[:-1]
    return head, np.cumsum(head) - 1


def _segments(doc: np.ndarray, place: np.ndarray, uids: np.ndarray) -> tuple[bytes, bytes]:
    """Heads (uid, first word, count) of the segments that sorted (doc, place) pairs lie in, and the places in them."""
    key = doc * (1 << 24) + place // SEGMENT
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(key)))
    head = np.stack([uids[doc[first]], place[first] // SEGMENT * SEGMENT, count], axis=1) if len(first) else np.zeros((0, 3), dtype=np.int64)
    return head.astype("<i8").tobytes(), (place % SEGMENT).astype("<u2").tobytes()


def _places(heads: np.ndarray, low: np.ndarray, answered: pa.Table, groups: int) -> pa.Table:
    """(part, c, d): these segments and the answers that pass through, in one row for each of ``groups`` of documents."""
    more = [[np.frombuffer(x, kind) for x in answered.column(k).to_pylist()] for k, kind in ((0, "<i8"), (1, "<u2"))]
    head = np.concatenate([heads, *(x.reshape(-1, 3) for x in more[0])]).astype("<i8")
    place = np.concatenate([low, *more[1]]).astype("<u2")
    part = head[:, 0] % groups
    order = np.argsort(part, kind="stable")
    begin, count = (np.cumsum(head[:, 2]) - head[:, 2])[order], head[order, 2]
    place = place[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    head, part = head[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(count)])[cuts]
    ranges = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist()))
    return pa.table({
        "part": pa.array(part[cuts[:-1]].astype(np.int32)), "c": pa.array([head[i:j].tobytes() for i, j, _, _ in ranges], pa.binary()), "d": pa.array([place[x:y].tobytes() for _, _, x, y in ranges], pa.binary()),
    })


def _by_document(answers: DataFrame, name: str) -> DataFrame:
    """(uid, places): one row per document, with all its places as little-endian 8-byte numbers in a list of one."""

    def gather(part: pa.Table) -> pa.Table:
        head = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in part.column("c").to_pylist()])
        place = np.concatenate([np.frombuffer(x, "<u2") for x in part.column("d").to_pylist()]).astype("<i8") + np.repeat(head[:, 1], head[:, 2])
        uid = np.repeat(head[:, 0], head[:, 2])
        order = np.lexsort((place, uid))
        uid, place = uid[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1], [True]])).tolist() if len(uid) else [0]
        return pa.table({"uid": pa.array([int(uid[i]) for i in cuts[:-1]], pa.int64()), "places": pa.array([[place[i:j].tobytes()] for i, j in zip(cuts, cuts[1:])], pa.list_(pa.binary()))})

    return materialize(answers.groupBy("part").applyInArrow(gather, "uid long, places array<binary>"), name)


def probe_blocks(rows: DataFrame, *, block: int, buckets: int) -> DataFrame:
    """(uid, places): every place of a run of ``block`` words that may also stand elsewhere as a block of the index.

    ``rows``: uid, text. Hashes are compared by 40 bits besides the bucket's, so a few places more are given.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, 1):
            uids = np.array([r[0] for r in rows], dtype=np.int64)
            words, bounds = word_hashes([r[1] for r in rows])
            runs = window_hashes(words, block)
            doc = np.repeat(np.arange(len(rows)), np.diff(bounds))[: len(runs)]
            place = np.arange(len(runs)) - bounds[doc]
            whole = np.flatnonzero(place + block <= (bounds[doc + 1] - bounds[doc]))
            runs, doc, place = runs[whole], doc[whole], place[whole]
            # Among equal runs a block of the index goes first, and goes on alone; the others are sure to be repeats.
            order = np.lexsort((place % block != 0, runs))
            head, group = _runs(order, runs)
            size = np.bincount(group, minlength=1)
            again = np.sort(order[size[group] > 1]) if len(order) else order
            out = [(int(uids[0] % buckets), None, None, *_segments(doc[again], place[again], uids))] if len(again) else []
            alone = np.sort(order[head])
            bucket = (runs[alone] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            for b, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if end > begin:
                    own = alone[by[begin:end]]
                    rest = runs[own] // np.uint64(buckets)
                    out.append((b, (rest & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), ((rest >> np.uint64(32)) & np.uint64(0xFF)).astype("u1").tobytes(), *_segments(doc[own], place[own], uids)))
            if out:
                yield _record(out)

    def answer(bucket: pa.Table) -> pa.Table:
        bucket, answered = _split(bucket)
        low, high, heads, places = (bucket.column(k).to_pylist() for k in range(1, 5))
        values = np.frombuffer(b"".join(low), "<u4").astype(np.uint64) | np.frombuffer(b"".join(high), "u1").astype(np.uint64) << np.uint64(32)
        place = np.frombuffer(b"".join(places), "<u2")
        head = np.frombuffer(b"".join(heads), "<i8").reshape(-1, 3)
        base = np.repeat(head[:, 1], head[:, 2])
        order = np.argsort(values)
        _, group = _runs(order, values)
        indexed = np.bincount(group, weights=((place + base) % block == 0)[order], minlength=1) > 0
        hit = np.zeros(len(values), dtype=bool)
        hit[order] = (indexed & (np.bincount(group, minlength=1) > 1))[group] if len(order) else False
        left = np.add.reduceat(hit.astype(np.int64), np.cumsum(head[:, 2]) - head[:, 2]) if len(head) else np.zeros(0, dtype=int)
        kept = np.stack([head[:, 0], head[:, 1], left], axis=1)[left > 0]
        return _places(kept, place[hit], answered, buckets)

    return _by_document(rows.mapInArrow(probe, PIECES).groupBy("bucket").applyInArrow(answer, ANSWERS), "hits")


def later_windows(rows: DataFrame, hits: DataFrame, *, window: int, block: int, buckets: int) -> DataFrame:
    """(uid, places): the places of windows whose words also start earlier.

    ``rows``: uid, order_id, text; earlier is by (order_id, uid, place).
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, 2):
            # Rows in the corpus order, so that the first of equal windows stands first.
            rows.sort(key=lambda r: (r[1], r[0]))
            uids, ids = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
            words, bounds = word_hashes([r[2] for r in rows])
            near = np.zeros(len(words) + 1, dtype=np.int64)
            for k, r in enumerate(rows):
                at = np.frombuffer(b"".join(r[3]), "<i8")
                np.add.at(near, bounds[k] + np.maximum(at - (window - block), 0), 1)
                np.add.at(near, np.minimum(bounds[k] + at + 1, len(words)), -1)
            all_windows = window_hashes(words, window)
            doc = np.repeat(np.arange(len(rows)), np.diff(bounds))[: len(all_windows)]
            place = np.arange(len(all_windows)) - bounds[doc]
            own = np.flatnonzero((np.cumsum(near)[: len(all_windows)] > 0) & (place + window <= bounds[doc + 1] - bounds[doc]))
            values, doc, place = all_windows[own], doc[own], place[own]
            order = np.argsort(values, kind="stable")
            head, group = _runs(order, values)
            first = order[head]
            own = first[group] if len(order) else order
            later = np.sort(order[(uids[doc[order]] != uids[doc[own]]) | (place[order] != place[own])])  # a repeated row repeats nothing
            out = [(int(uids[0] % buckets), None, None, *_segments(doc[later], place[later], uids))] if len(later) else []
            bucket = (values[first] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            for b, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if end > begin:
                    some = np.sort(first[by[begin:end]])
                    heads, places = _segments(doc[some], place[some], uids)
                    rank = ids[doc[some]]
                    out.append((b, values[some].astype("<u8").tobytes(), rank[_changes(doc[some], place[some])].astype("<i8").tobytes(), heads, places))
            if out:
                yield _record(out)

    def first_places(bucket: pa.Table) -> pa.Table:
        bucket, answered = _split(bucket)
        raw, ids, heads, places = (bucket.column(k).to_pylist() for k in range(1, 5))
        values, place = np.frombuffer(b"".join(raw), "<u8"), np.frombuffer(b"".join(places), "<u2")
        head, ids = np.frombuffer(b"".join(heads), "<i8").reshape(-1, 3), np.frombuffer(b"".join(ids), "<i8")
        segment = np.repeat(np.arange(len(head)), head[:, 2])
        # Segments in the corpus order; places within one ascend.
        rank = np.empty(len(head), dtype=np.int64)
        rank[np.lexsort((head[:, 1], head[:, 0], ids))] = np.arange(len(head))
        order = np.lexsort((place, rank[segment], values))
        begins, group = _runs(order, values)
        later = np.zeros(len(values), dtype=bool)
        if len(order):
            first = order[begins][group]
            later[order] = (head[segment[order], 0] != head[segment[first], 0]) | (place[order] != place[first]) | (head[segment[order], 1] != head[segment[first], 1])
        left = np.add.reduceat(later.astype(np.int64), np.cumsum(head[:, 2]) - head[:, 2]) if len(head) else np.zeros(0, dtype=int)
        kept = np.stack([head[:, 0], head[:, 1], left], axis=1)[left > 0]
        return _places(kept, place[later], answered, buckets)

    near = with_ids(rows, hits, "uid").select("uid", "order_id", "text", "places")
    return _by_document(near.mapInArrow(extend, PIECES).groupBy("bucket").applyInArrow(first_places, ANSWERS), "repeats")


def _changes(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where a segment of sorted (doc, place) pairs begins."""
    key = doc * (1 << 24) + place // SEGMENT
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def remove_repeats(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its remaining words joined by spaces).

    A word goes if a window of ``window`` words that covers it also starts earlier: at a smaller id, or earlier in the
    same document. Null texts have no words; texts shorter than a window stay whole; null ids come first. Rows with the
    same id and text are one document, and each keeps its row; rows that share an id alone are ordered by a hash of their texts.
    """
    block = window // 2
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("uid"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)).alias("order_id"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    once = rows.select("uid", "order_id", "text")
    buckets = max(1, -(-total_bytes(rows, "text") // BUCKET_BYTES))
    hits = probe_blocks(once.select("uid", "text"), block=block, buckets=buckets)
    later = later_windows(once, hits, window=window, block=block, buckets=buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(2).to_pylist()]
            kept = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), kept], ["uid", "doc_id", "n_words", "whole_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for raw, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = raw.encode("utf-8", "surrogatepass").split()
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.frombuffer(b"".join(places), "<i8")
                np.add.at(covered, at, 1)
                np.add.at(covered, at + window, -1)
                gone = np.cumsum(covered)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["uid", "n_removed", "kept"])

    shorter = with_ids(once.select("uid", "text"), later, "uid").mapInArrow(cut, "uid long, n_removed long, kept string").dropDuplicates(["uid"])
    every = rows.select("uid", "doc_id", "text").mapInArrow(count, "uid long, doc_id long, n_words long, whole_sha256 string")
    return every.join(shorter, "uid", "left")


def op3_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated windows of 20 words are removed."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("whole_sha256"))
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), digest.alias("kept_sha256"))
