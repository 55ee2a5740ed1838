"""Operator 6: removal of repeated byte strings by sampled names.

Only equality over a fixed length counts here, so positions need names, not ranks, and a sample of positions that every
string of that length must hold replaces the residues of a fixed cover:

1. sample: every string stands on the byte run in it with the least hash, so equal strings stand on equal runs. Names
   of samples are sorted in buckets, and equal neighbours show which repeat; a string on a unique sample can't.
2. recursion: all the bytes of the strings that stand on one sample are a stretch with a name of its own; where it
   repeats, so do all those strings.
3. remaining positions: strings on samples that the second step leaves open are named one by one and compared with
   equal neighbours, together with those on equal samples elsewhere, settled or not, which may be their only match.

Names are 64-bit hashes. Of equal names in a batch of texts one goes on, so a string in very many documents never meets
in one task in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table, total_bytes, with_ids
from gleaner.llm.hashing import PIECE, mix, prefix_sums, stretch_hashes, window_minima
from gleaner.llm.passages import ANSWERS, BUCKET_BYTES, PIECES, _by_document, _places, _record, _runs, _segments, _split, text_batches


def samples(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and names of the sampled byte runs, and the first and last start of the strings each stands for.

    A string of ``length`` bytes stands on the first of its byte runs with the least hash, which its bytes alone decide.
    """
    run = max(1, length * 9 // 25)
    width = length - run + 1
    found = []
    for begin in range(0, len(data) - length + 1, PIECE):
        part = data[begin : begin + PIECE + length - 1]
        at = np.arange(len(part) - run + 1)
        hashes = stretch_hashes(prefix_sums(part), at, at + run)
        least = window_minima(hashes, width)
        some = np.flatnonzero(~window_minima(~np.pad(least, width - 1), width) == hashes)  # the least of some string
        which = np.searchsorted(some, np.arange(len(least)))
        open_ = np.flatnonzero(hashes[some[which]] != least)
        while len(open_):
            which[open_] += 1
            open_ = open_[hashes[some[which[open_]]] != least[open_]]
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        place = some[which[first]]
        found.append((place + begin, hashes[place], first + begin, np.append(first[1:], len(least)) - 1 + begin))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    places, names, first, last = (np.concatenate(x) for x in zip(*found))
    head = np.concatenate([[True], places[1:] != places[:-1]])  # one that a cut between pieces has halved
    return places[head], names[head], first[head], last[np.append(np.flatnonzero(head)[1:] - 1, len(places) - 1)]


def names_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Names of stretches with ascending starts, about PIECE bytes at a time."""
    out = [np.zeros(0, dtype=np.uint64)]
    for at in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // PIECE)) + 1):
        if len(at):
            lo, hi = int(starts[at[0]]), int(ends[at].max())
            out.append(stretch_hashes(prefix_sums(data[lo:hi]), starts[at] - lo, ends[at] - lo))
    return np.concatenate(out)


def _held(parts: list[bytes] | None) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(parts), "<i8")) if parts else np.zeros(0, dtype=np.int64)


def _send(own: np.ndarray, value: np.ndarray, flag: np.ndarray | None, doc: np.ndarray, place: np.ndarray, uids: np.ndarray, buckets: int) -> list[tuple]:
    """Pieces of the ascending entries ``own``, one for each bucket of their values."""
    bucket = (value[own] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    ends, out = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist(), []
    for b, (begin, end) in enumerate(zip([0, *ends[:-1]], ends)):
        if end > begin:
            some = own[by[begin:end]]
            out.append((b, value[some].astype("<u8").tobytes(), None if flag is None else flag[some].astype("u1").tobytes(), *_segments(doc[some], place[some], uids)))
    return out


def _ask(rows: DataFrame, named: Callable[[tuple], tuple[np.ndarray, ...]], *, buckets: int, name: str, repeats: bool) -> DataFrame:
    """(uid, places) answered for the places that ``named`` gives each row (uid, text, ...).

    ``repeats``: (places, names); those whose name some other place has. Else (places, names, contexts, flags): one
    unflagged place of each context whose name a flagged place of another context has.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_batches(batches, 1):
            rows = list({r[0]: r for r in rows}.values())
            uids = np.array([r[0] for r in rows], dtype=np.int64)
            found = [named(r) for r in rows]
            doc = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
            place, value, *more = (np.concatenate([f[k] for f in found]) for k in range(2 if repeats else 4))
            order = np.argsort(value if repeats else more[0], kind="stable")
            head, group = _runs(order, value if repeats else more[0])
            alone, flag, out = np.sort(order[head]), None, []
            if repeats and len(order):
                again = np.sort(order[np.bincount(group)[group] > 1])
                out = [(int(uids[0] % buckets), None, None, *_segments(doc[again], place[again], uids))] if len(again) else []
            elif len(order):
                flag = np.zeros(len(order), dtype=bool)
                flag[order] = (np.bincount(group, weights=more[1][order]) > 0)[group]
            out += _send(alone, value, flag, doc, place, uids, buckets)
            if out:
                yield _record(out)

    def answer(bucket: pa.Table) -> pa.Table:
        bucket, answered = _split(bucket)
        raw, flags, heads, places = (bucket.column(k).to_pylist() for k in range(1, 5))
        value, place = np.frombuffer(b"".join(raw), "<u8"), np.frombuffer(b"".join(places), "<u2")
        head = np.frombuffer(b"".join(heads), "<i8").reshape(-1, 3)
        segment = np.repeat(np.arange(len(head)), head[:, 2])
        order = np.argsort(value, kind="stable")
        begins, group = _runs(order, value)
        hit = np.zeros(len(value), dtype=bool)
        if len(order) and repeats:
            first = order[begins][group]  # a repeated row repeats nothing
            other = (head[segment[order], 0] != head[segment[first], 0]) | (head[segment[order], 1] != head[segment[first], 1]) | (place[order] != place[first])
            hit[order] = (np.bincount(group, weights=other) > 0)[group]
        elif len(order):
            flag = np.frombuffer(b"".join(flags), "u1") > 0
            hit[order] = (np.bincount(group, weights=flag[order]) > 0)[group]
            hit &= ~flag
        left = np.add.reduceat(hit.astype(np.int64), np.cumsum(head[:, 2]) - head[:, 2]) if len(head) else np.zeros(0, dtype=int)
        return _places(np.stack([head[:, 0], head[:, 1], left], axis=1)[left > 0], place[hit], answered, buckets)

    return _by_document(rows.mapInArrow(ask, PIECES).groupBy("bucket").applyInArrow(answer, ANSWERS), name)


def remove_substrings(docs: DataFrame, *, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Null texts count as empty;
    texts shorter than ``length`` stay whole. Rows with the same id and text are one document and each keeps its row.
    Bytes are UTF-8, so what is left of a text need not be text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("uid"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    once = rows.select("uid", "text")
    buckets = max(1, -(-total_bytes(rows, "text") // BUCKET_BYTES))
    bytes_of = lambda row: np.frombuffer(row[1], dtype=np.uint8)

    def name_stretches(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Repeated samples by all the bytes of the strings that stand on them."""
        data = bytes_of(row)
        places, _, first, last = samples(data, length)
        at = np.flatnonzero(np.isin(places, _held(row[2])))
        return places[at], names_of(data, first[at], last[at] + length)

    def name_samples(row: tuple) -> tuple[np.ndarray, ...]:
        """Repeated samples by their names, with the names of their stretches as contexts; open ones are flagged."""
        data = bytes_of(row)
        places, names, first, last = samples(data, length)
        at = np.flatnonzero(np.isin(places, _held(row[2])))
        context = mix(names[at] + names_of(data, first[at], last[at] + length) * np.uint64(3))
        return places[at], names[at], context, (~np.isin(places[at], _held(row[3]))).astype(np.uint64)

    def name_rest(row: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the strings that stand on open or wanted samples."""
        data = bytes_of(row)
        places, _, first, last = samples(data, length)
        at = np.isin(places, _held(row[2])) & (~np.isin(places, _held(row[3])) | np.isin(places, _held(row[4])))
        size = (last - first + 1)[at]
        starts = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return starts, names_of(data, starts, starts + length)

    named = lambda df, name: df.withColumnRenamed("places", name)
    repeated = _ask(once, lambda row: samples(bytes_of(row), length)[:2], buckets=buckets, name="samples", repeats=True)
    near = with_ids(once, named(repeated, "sampled"), "uid").select("uid", "text", "sampled")
    wide = _ask(near, name_stretches, buckets=buckets, name="stretches", repeats=True)
    hits = materialize(named(repeated, "sampled").join(named(wide, "wide"), "uid", "left"), "hits")
    near = with_ids(once, hits, "uid").select("uid", "text", "sampled", "wide")
    wanted = _ask(near, name_samples, buckets=buckets, name="wanted", repeats=False)
    hits = materialize(hits.join(named(wanted, "wanted"), "uid", "left"), "hits")
    near = with_ids(once, hits, "uid").select("uid", "text", "sampled", "wide", "wanted")
    single = _ask(near, name_rest, buckets=buckets, name="starts", repeats=True)
    both = wide.select("uid", F.col("places").alias("wide")).join(single.select("uid", F.col("places").alias("single")), "uid", "full")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
            sums = pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()), sums], ["uid", "doc_id", "n_bytes", "whole_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, wide, single in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                raw = raw.encode("utf-8", "surrogatepass")
                data = np.frombuffer(raw, dtype=np.uint8)
                edges = np.zeros(len(data) + 1, dtype=np.int32)
                if wide:
                    places, _, first, last = samples(data, length)
                    at = np.isin(places, _held(wide))
                    np.add.at(edges, first[at], 1)
                    np.add.at(edges, last[at] + length, -1)
                alone = _held(single)
                np.add.at(edges, alone, 1)
                np.add.at(edges, alone + length, -1)
                gone = np.cumsum(edges)[:-1] > 0
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["uid", "n_removed", "n_spans", "sha256"])

    shorter = with_ids(once, both, "uid").select("uid", "text", "wide", "single").mapInArrow(cut, "uid long, n_removed long, n_spans long, sha256 string").dropDuplicates(["uid"])
    every = rows.select("uid", "doc_id", "text").mapInArrow(digest, "uid long, doc_id long, n_bytes long, whole_sha256 string").join(shorter, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha256", "whole_sha256").alias("kept_sha256"))


def op6_sampled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated strings of 200 bytes are removed."""
    return remove_substrings(table(spark, sf_dir, "documents"))
