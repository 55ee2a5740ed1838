"""Operator 11: alignment of two tokenizers by galloping intersection of their tokens' ends.

Both tokenizers' tokens are laid over the bytes of a text. Their ends are two sorted lists; the shorter one drives an
exponential and then binary search through the longer. The ends found in both cut the text into groups, and the
differences of their ranks in either list are the ranges of tokens that a group holds.

Every batch of texts counts its id pairs once and asks for the corpus-wide counts once, so that no pair, however common,
meets in one task for each document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table
from gleaner.llm.passages import text_batches

#: Neither tokenizer joins anything over a single space between two other characters than white space.
SEGMENT = re.compile(r"\s*+\S*+(?:(?! \S)\s++\S*+)*+")
#: Segments aligned at a time, and those kept with their ids by a worker.
UNIT, KEEP = 150_000, 600_000
#: New segments read together.
TOGETHER = 10_000
#: Driving ends searched by one lane, in order; lanes run side by side.
LANE = 128


def gallop(driver: np.ndarray, bounds: np.ndarray, other: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each value of ``driver`` the place of the first value of ``other`` that is not less.

    ``bounds`` (n + 1 of them) cut ``driver`` into ascending lanes; ``low`` is a place in ``other`` to begin at for each.
    A lane goes on from where its last value was found: steps double until they reach the value, then halve. ``other``
    holds a value as great as each lane's last at or after its place.
    """
    out, sizes = np.empty(len(driver), dtype=np.int64), np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, low, sizes = bounds[:-1][order], low[order].copy(), sizes[order]
    last = len(other) - 1
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k))  # lanes with more than k values
        value, base = driver[begin[:m] + k], low[:m]
        reach = base.copy()
        todo, step = np.flatnonzero(other[reach] < value), 1
        while len(todo):
            base[todo] = reach[todo] + 1
            reach[todo] = np.minimum(reach[todo] + step, last)
            step *= 2
            todo = todo[other[reach[todo]] < value[todo]]
        todo = np.flatnonzero(base < reach)
        while len(todo):
            mid = (base[todo] + reach[todo]) >> 1
            less = other[mid] < value[todo]
            base[todo[less]] = mid[less] + 1
            reach[todo[~less]] = mid[~less]
            todo = todo[base[todo] < reach[todo]]
        out[begin[:m] + k] = low[:m] = reach
    return out


def common_ends(a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and in ``b`` of the ends they share.

    The bounds cut both into texts (n + 1 each); ends ascend over all texts and every text ends at the same value in
    both. The shorter list of a text drives.
    """
    shorter = np.diff(a_bounds) <= np.diff(b_bounds)
    found = []
    for lists, (x, xb, y, yb) in ((shorter, (a, a_bounds, b, b_bounds)), (~shorter, (b, b_bounds, a, a_bounds))):
        sizes = np.diff(xb)[lists]
        at = np.repeat(xb[:-1][lists] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        driver = x[at]
        # Lanes begin where a text does and every LANE values in it; the others' heads are looked up by binary search.
        within = np.arange(len(driver)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        heads = np.flatnonzero(within % LANE == 0)
        low = np.where(within[heads] == 0, np.repeat(yb[:-1][lists], -(-sizes // LANE)), 0)
        inner = within[heads] > 0
        low[inner] = np.searchsorted(y, driver[heads[inner]])
        place = gallop(driver, np.append(heads, len(driver)), y, low)
        same = y[place] == driver if len(driver) else np.zeros(0, dtype=bool)
        found.append((at[same], place[same]) if x is a else (place[same], at[same]))
    in_a, in_b = np.concatenate([found[0][0], found[1][0]]), np.concatenate([found[0][1], found[1][1]])
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id below ``size`` in decimal digits, right-aligned, and how many it has."""
    width = len(str(max(size - 1, 1)))
    ids = np.arange(size)[:, None]
    digits = (ids // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)
    return digits, 1 + (ids >= 10 ** np.arange(1, width)).sum(axis=1)


class Pair:
    """Two tokenizers, and the ids of both for the segments seen lately.

    The first is a byte-level tokenizer file, the second a piece model whose pieces never hold a space after another
    character, so that texts may be cut before single spaces.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [k for k in range(256) if k not in set(printable)]
        byte_of = {chr(k): k for k in printable} | {chr(256 + k): byte for k, byte in enumerate(rest)}
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("texts cannot be cut before spaces for these pieces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in some], dtype=np.int64) for some in (self.a_bytes, self.b_bytes))
        self.digits, self.n_digits = _decimals(max(len(self.a_bytes), len(self.b_bytes)))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, dtype=bool)
        self.n = [np.zeros(0, dtype=np.int64)] * 2
        self.begin = [np.zeros(0, dtype=np.int64)] * 2
        self.ids = [np.zeros(0, dtype=np.int64)] * 2

    def _encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Both tokenizers' ids of each text, and whether both give back its bytes."""
        ids = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sound = [x == b"".join(map(self.a_bytes.__getitem__, i)) == b"".join(map(self.b_bytes.__getitem__, j)) for x, i, j in zip(raw, *ids)]
        return [[np.array(x, dtype=np.int64) for x in side] for side in ids], np.array(sound, dtype=bool)

    def _learn(self, segments: list[str]) -> None:
        """Segments that end with a character are read together, as both tokenizers cut them apart again; where the bytes
        don't come back, and for all others, one by one."""
        joined = [s for s in segments if not s[-1].isspace()]
        alone = [s for s in segments if s[-1].isspace()]
        for k in range(0, len(joined), TOGETHER):
            some = joined[k : k + TOGETHER]
            ids, sound = self._encode(["".join(some)])
            if not sound[0]:
                alone += some
                continue
            ends = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in some])
            self._keep(some, [(x[0], np.diff(np.searchsorted(np.cumsum(size[x[0]]), ends, side="right"), prepend=0)) for x, size in zip(ids, (self.a_size, self.b_size))], np.ones(len(some), dtype=bool))
        for k in range(0, len(alone), TOGETHER):
            ids, sound = self._encode(alone[k : k + TOGETHER])
            self._keep(alone[k : k + TOGETHER], [(np.concatenate([np.zeros(0, dtype=np.int64), *x]), np.array([len(y) for y in x], dtype=np.int64)) for x in ids], sound)

    def _keep(self, segments: list[str], sides: list[tuple[np.ndarray, np.ndarray]], sound: np.ndarray) -> None:
        self.known.update(zip(segments, range(len(self.known), len(self.known) + len(segments))))
        self.sound = np.append(self.sound, sound)
        for side, (ids, n) in enumerate(sides):
            self.begin[side] = np.append(self.begin[side], len(self.ids[side]) + np.cumsum(n) - n)
            self.n[side] = np.append(self.n[side], n)
            self.ids[side] = np.append(self.ids[side], ids)

    def look_up(self, segments: list[str]) -> np.ndarray:
        if len(self.known) > KEEP or max(map(len, self.ids)) > 8 * KEEP:
            self._forget()
        if missing := list(set(segments).difference(self.known)):
            self._learn(missing)
        return np.fromiter(map(self.known.__getitem__, segments), dtype=np.int64, count=len(segments))

    def tokens(self, which: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these segments, laid end to end, and how many each segment has."""
        n = self.n[side][which]
        to = np.cumsum(n)
        return self.ids[side][np.repeat(self.begin[side][which] - (to - n), n) + np.arange(int(to[-1]) if len(to) else 0)], n

    def spell(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups ``a1,a2|b1;`` of all texts as bytes, and where each group ends."""
        a_before, b_before = np.append(0, in_a[:-1] + 1), np.append(0, in_b[:-1] + 1)
        size = len(a) + len(b)
        ids, marks = np.empty(size, dtype=np.int64), np.full(size, ord(","), dtype=np.uint8)
        ids[np.arange(len(a)) + np.repeat(b_before, in_a + 1 - a_before)] = a
        ids[np.arange(len(b)) + np.repeat(in_a + 1, in_b + 1 - b_before)] = b
        marks[in_a + b_before] = ord("|")
        marks[in_a + in_b + 1] = ord(";")
        shown = np.concatenate([self.digits[ids], marks[:, None]], axis=1)
        n = self.n_digits[ids]
        flat = shown[np.arange(shown.shape[1]) >= shown.shape[1] - 1 - n[:, None]]
        return flat.tobytes(), np.cumsum(n + 1)[in_a + in_b + 1]

    def align(self, texts: list[str]) -> tuple[list[list[int]], list[list[bytes]], list[np.ndarray], np.ndarray]:
        """For each text its numbers of tokens of both kinds, groups and links, and its groups in bytes; for all links of
        all texts the text and the ids (first tokenizer's id times the second's size, plus the second's id)."""
        figures: list[list[int]] = [[0, 0, 0, 0] for _ in texts]
        shown: list[list[bytes]] = [[] for _ in texts]
        unsound: set[int] = set()
        links: list[tuple[np.ndarray, np.ndarray]] = []
        owners: list[int] = []
        some: list[str] = []
        counts: list[int] = []

        def flush() -> None:
            which, text = self.look_up(some), np.array(owners, dtype=np.int64)
            cuts = np.append(0, np.cumsum(counts))
            sound = np.logical_and.reduceat(self.sound[which], cuts[:-1])
            unsound.update(text[~sound].tolist())
            keep = np.repeat(sound, counts)
            which, text, n_segments = which[keep], text[sound], np.array(counts)[sound]
            if not len(which):
                return
            heads = np.cumsum(n_segments) - n_segments
            (a, a_n), (b, b_n) = self.tokens(which, 0), self.tokens(which, 1)
            a_bounds, b_bounds = (np.append(0, np.cumsum(np.add.reduceat(n, heads))) for n in (a_n, b_n))
            in_a, in_b = common_ends(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_bounds, b_bounds)
            groups = np.searchsorted(in_a, a_bounds)
            flat, ends = self.spell(a, b, in_a, in_b)
            edges = np.append(0, ends)[groups].tolist()
            for k, i, x, y, u, v, g in zip(range(len(text)), text.tolist(), a_bounds[1:] - a_bounds[:-1], b_bounds[1:] - b_bounds[:-1], edges, edges[1:], np.diff(groups)):
                for j, more in enumerate((x, y, g, g)):
                    figures[i][j] += int(more)
                shown[i].append(flat[u : v - 1])
            links.append((np.repeat(text, np.diff(groups)), a[in_a] * len(self.b_bytes) + b[in_b]))

        width = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            parts = [SEGMENT.findall(" " + text)] if len(text) < UNIT else batched((m.group() for m in SEGMENT.finditer(" " + text)), UNIT)
            for part in (list(filter(None, x)) for x in parts):
                if not part:
                    continue
                some += part
                owners.append(k)
                counts.append(len(part))
                width += len(part)
                if width >= UNIT:
                    flush()
                    width = 0
                    some.clear(), owners.clear(), counts.clear()
        if some:
            flush()
        owner, pair = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, dtype=np.int64) for k in (0, 1))
        if unsound:
            for k in unsound:
                figures[k], shown[k] = [0, 0, 0, 0], []
            good = ~np.isin(owner, list(unsound))
            owner, pair = owner[good], pair[good]
        return figures, shown, owner, pair


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, batch long, which binary, times binary, wide boolean, pairs binary, pair_times binary"


def align(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and its id pairs.

    The first tokenizer reads a space and the text, the second the text. Null and empty texts, and those that either
    tokenizer's bytes do not give back, have no tokens: zeros and an empty string. Very long texts are taken in parts;
    repeated rows and null ids stay rows of their own; other columns are not read; an empty table gives no row.
    Of each ``batch`` one row lists the different id pairs (``pairs``) and how many links have each; ``which`` and
    ``times`` say which of them a document has, and how often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part = Pair(a_path, b_path), TaskContext.get().partitionId()
        for number, rows in enumerate(text_batches(batches, 1)):
            figures, shown, owner, links = pair.align([raw.decode("utf-8", "surrogatepass") for _, raw in rows])
            pairs, which, counts = np.unique(links, return_inverse=True, return_counts=True)
            held, times = np.unique(owner * max(len(pairs), 1) + which, return_counts=True)
            cuts = np.searchsorted(held, np.arange(len(rows) + 1) * max(len(pairs), 1)).tolist()
            held %= max(len(pairs), 1)
            wide = len(pairs) > 1 << 16 or bool(len(times)) and int(times.max()) >= 1 << 16
            held, times = (x.astype("<u4" if wide else "<u2") for x in (held, times))
            once = [None] * (len(rows) - 1)
            columns = [
                *(pa.array(x, pa.int64()) for x in zip(*([row[0], *f] for row, f in zip(rows, figures)))),
                pa.array([b";".join(x).decode() for x in shown], pa.string()),
                pa.array([(part << 32) + number] * len(rows), pa.int64()),
                *(pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (held, times)),
                pa.array([wide] * len(rows)),
                *(pa.array([x.astype("<i8").tobytes(), *once], pa.binary()) for x in (pairs, counts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ALIGNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, *, b_size: int) -> tuple[DataFrame, DataFrame]:
    """(batch, pair) for every id pair of a batch, and for every pair of the corpus its number of links ``n`` and whether
    none with the same second id has more (``best``)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, counts = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), number)), pa.array(pairs), pa.array(counts)], ["batch", "pair", "links"])

    uses = aligned.where("pairs is not null").select("batch", "pairs", "pair_times").mapInArrow(unpack, "batch long, pair long, links long")
    totals = uses.groupBy("pair").agg(F.sum("links").alias("n")).withColumn("b_id", F.col("pair") % b_size)
    # At most one row of sixteen bytes for each id of the second tokenizer.
    most = F.broadcast(totals.groupBy("b_id").agg(F.max("n").alias("most")))
    return uses.select("batch", "pair"), totals.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, *, b_size: int) -> DataFrame:
    """The documents of a written :func:`align` (all columns but the pairs') with n_best, the links whose pair is the
    most frequent of its second id (ties included), and count_sum, the links' counts added up."""
    uses, totals = pair_counts(aligned, b_size=b_size)
    answers = uses.join(totals, "pair")
    kept = [f for f in aligned.schema.fields if f.name not in ("batch", "which", "times", "wide", "pairs", "pair_times")]
    names = [f.name for f in kept]

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("pair")
        n, best = answers.column("n").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
        found = []
        for which, times, wide in zip(*(rows.column(c).to_pylist() for c in ("which", "times", "wide"))):
            which, times = (np.frombuffer(x, "<u4" if wide else "<u2").astype(np.int64) for x in (which, times))
            found.append((int(best[which] @ times), int(n[which] @ times)))
        return pa.table([*(rows.column(c) for c in names), *(pa.array(x, pa.int64()) for x in zip(*found))], [*names, "n_best", "count_sum"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "n_best long, count_sum long"])
    rows = aligned.select(*names, "batch", "which", "times", "wide")
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)


def op11_gallop_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the byte-level and the piece tokenizer."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    a_path, b_path = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    aligned = align(table(spark, sf_dir, "documents"), a_path=a_path, b_path=b_path)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    written = materialize(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "batch", "which", "times", "wide", "pairs", "pair_times"), "aligned")
    return scored(written, b_size=SentencePieceProcessor(model_file=b_path).vocab_size())
