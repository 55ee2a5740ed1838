"""Operator 4: benchmark decontamination with a BM25 inverted index and block-max bounds.

Test items are indexed once: every term has a posting list, its BM25 contribution to each item that holds it, and the
largest ones of each block of items. Every passage of every training text is a query. Its terms are taken from the least
largest contribution up: WAND's pivot is the first at which their sum can reach any threshold, and only blocks in the lists
from there on can hold an answer. The pivot is found once per passage, for many passages at a time, and not moved along
the lists. The block maxima of the terms from the pivot on are summed first; with them and all that the others can add, a
block stays open or not. The sum of all terms' block maxima then bounds the score of a block's items; only blocks whose
bound reaches their lowest threshold are scored. What scores above an item's threshold is retrieved, all of it, and verified: the
passage must hold enough of the question and of the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table

#: Items in a block of the index.
BLOCK = 16
#: Terms of all items in one broadcast index, and so at most its postings; more items are indexed in several runs.
INDEX_TERMS = 1 << 20
#: Block entries or lookups at a time.
BATCH = 1 << 20
#: Block entries that are read in the time of one lookup.
LOOKUP = 4
K1, B = 1.2, 0.75
TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def question_and_answer(terms: list[str]) -> tuple[list[str], list[str]]:
    """The last third of an item's terms is its answer; the rest asks."""
    cut = len(terms) - max(1, len(terms) // 3)
    return (terms[:cut], terms[cut:]) if len(terms) > 1 else (terms, terms)


@dataclass
class Index:
    """Postings as sorted keys term * (places for items) + item, block maxima as sorted keys term * blocks + block.

    ``ends[t]``: where the block entries of term t end; ``begins[e]``: where the postings of block entry e begin;
    ``tops[t]``: a term's largest contribution. The term after the last one stands for all that no item holds. ``tokens`` are the items' terms, one item after the other, cut at ``cuts``.
    """

    items: list[int | None]
    tokens: np.ndarray
    cuts: np.ndarray
    vocabulary: dict[str, int]
    postings: np.ndarray
    weights: np.ndarray
    entries: np.ndarray
    maxima: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    tops: np.ndarray
    thresholds: np.ndarray
    lowest: np.ndarray

    def parts(self, item: int) -> tuple[list[int], list[int]]:
        return question_and_answer(self.tokens[self.cuts[item] : self.cuts[item + 1]].tolist())


def build_index(items: list[tuple[int | None, list[str]]], frequency: dict[str, int], *, count: int, mean: float, share: float) -> Index | None:
    """Index of items, each with one term at least; an item is retrieved from ``share`` of its score with itself on.
    ``frequency`` of terms, ``count`` and ``mean`` length are those of all items, also of other indexes."""
    if not items:
        return None
    split = sorted(items, key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
    vocabulary: dict[str, int] = {}
    tokens = np.array([vocabulary.setdefault(t, len(vocabulary)) for _, terms in split for t in terms], dtype=np.int32)
    lengths = np.array([len(t) for _, t in split])
    blocks = -(-len(split) // BLOCK)
    places = blocks * BLOCK
    postings, n = np.unique(tokens.astype(np.int64) * places + np.repeat(np.arange(len(split)), lengths), return_counts=True)
    term, item = postings // places, postings % places
    held = np.array([frequency[t] for t in vocabulary], dtype=np.float64)
    idf = np.log(1 + (count - held + 0.5) / (held + 0.5))
    weights = (idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[item] / mean))).astype(np.float32)
    entries, first = np.unique(term * blocks + item // BLOCK, return_index=True)
    maxima = np.maximum.reduceat(weights, first)
    tops = np.zeros(len(vocabulary) + 1, dtype=np.float32)
    np.maximum.at(tops, term, weights)
    thresholds = np.full(places, np.inf)
    thresholds[: len(split)] = share * np.bincount(item, weights, len(split))
    return Index(
        [k for k, _ in split], tokens, np.concatenate([[0], np.cumsum(lengths)]), vocabulary, postings, weights, entries, maxima,
        np.append(first, len(postings)), np.searchsorted(entries, np.arange(1, len(vocabulary) + 2) * blocks), tops, thresholds, thresholds.reshape(blocks, BLOCK).min(axis=1),
    )


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of ranges of ``n`` places each."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) + (first - np.cumsum(n) + n)[which]


def _score(index: Index, rows: np.ndarray, first: np.ndarray, n: np.ndarray, leading: np.ndarray, rest: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(row, item, score) of the items that reach their thresholds. ``first``, ``n``: the block entries of each term of
    the rows; ``leading``: whether it stands from the pivot on; ``rest``: what the terms before it can add."""
    blocks = len(index.lowest)
    lowest = np.tile(index.lowest * 0.9999, len(rows))
    own, column = np.nonzero(leading)
    pair, at = _ranges(first[own, column], n[own, column])
    cell = own[pair] * blocks + index.entries[at] % blocks
    open_ = np.bincount(cell, index.maxima[at], len(lowest)) + np.repeat(rest, blocks) >= lowest
    # The lists before the pivot are read where they are short, else looked up for the blocks still open.
    own, column = np.nonzero(~leading & (n > 0))
    some = np.flatnonzero(open_)
    if n[own, column].sum() <= LOOKUP * len(some) * rows.shape[1]:
        pair, more = _ranges(first[own, column], n[own, column])
        also = own[pair] * blocks + index.entries[more] % blocks
        held = open_[also]
    else:
        keys = rows[some // blocks].astype(np.int64) * blocks + (some % blocks)[:, None]
        more = np.minimum(np.searchsorted(index.entries, keys), len(index.entries) - 1)
        also = np.broadcast_to(some[:, None], keys.shape)
        held = (index.entries[more] == keys) & ~leading[some // blocks]
    cell, at = np.concatenate([cell, also[held]]), np.concatenate([at, more[held]])
    good = open_ & (np.bincount(cell, index.maxima[at], len(lowest)) >= lowest)
    kept = good[cell]
    cell, at = cell[kept], at[kept]
    if not len(at):
        return
    pair, at = _ranges(index.begins[at], index.begins[at + 1] - index.begins[at])
    place, some = np.cumsum(good) - 1, np.flatnonzero(good)
    scores = np.bincount(place[cell[pair]] * BLOCK + index.postings[at] % BLOCK, index.weights[at], len(some) * BLOCK).reshape(-1, BLOCK)
    for k, i in zip(*(x.tolist() for x in np.nonzero(scores >= index.thresholds.reshape(-1, BLOCK)[some % blocks] * 0.9999))):
        yield int(some[k]) // blocks, int(some[k]) % blocks * BLOCK + i, float(scores[k, i])


def retrieve(index: Index, ids: np.ndarray, width: int) -> list[tuple[int, int, float]]:
    """(first term of a passage, item, score) of all passages of ``width`` terms, each beginning half a passage after the
    one before, that reach an item's threshold. ``ids``: the text's terms as terms of the index."""
    out: list[tuple[int, int, float]] = []
    none, blocks, least = len(index.tops) - 1, len(index.lowest), index.lowest.min() * 0.9999
    starts = np.arange(0, max(1, len(ids) - width // 2), width // 2)
    step = max(1, min(512, BATCH // width, BATCH // blocks))
    for k in range(0, len(starts), step):
        own = starts[k : k + step]
        at = own[:, None] + np.arange(width)
        rows = np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], none)
        rows.sort(axis=1)
        rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = none  # a term of a query counts once
        able = np.flatnonzero(index.tops[rows].sum(axis=1, dtype=np.float64) >= least)
        if not len(able):
            continue
        own, rows = own[able], rows[able]
        rows = np.take_along_axis(rows, np.argsort(index.tops[rows], axis=1), axis=1)[:, -max(1, int((rows != none).sum(axis=1).max())) :]
        summed = np.cumsum(index.tops[rows], axis=1, dtype=np.float64)
        leading = summed >= least  # from the pivot on
        rest = np.where(leading, 0, summed).max(axis=1)
        first = np.where(rows > 0, index.ends[rows - 1], 0)
        n = index.ends[rows] - first
        turn = np.cumsum(n.sum(axis=1)) // BATCH  # of each passage, whole ones together
        for t in np.unique(turn):
            here = np.flatnonzero(turn == t)
            out += [(int(own[here[p]]), i, x) for p, i, x in _score(index, rows[here], first[here], n[here], leading[here], rest[here])]
    return out


def overlap(part: list, passage: list, gram: int = 3) -> float:
    """Share of the part's runs of ``gram`` terms (fewer: of the whole part) that the passage holds."""
    n = min(gram, len(part))
    held = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
    own = [tuple(part[k : k + n]) for k in range(len(part) - n + 1)]
    return sum(g in held for g in own) / len(own)


def find_leaks(
    docs: DataFrame, items: DataFrame, *, share: float = 0.6, question_overlap: float = 0.6, answer_overlap: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Verified leaks: doc_id, item_id, score, question_overlap, answer_overlap, the best passage of each pair.

    Passages are twice as long as the longest item, so one holds every copy of an item whole. Null and empty texts and
    items leak nothing; repeated rows leak each. Items are broadcast in parts of about ``INDEX_TERMS`` terms each; lengths
    and frequencies are those of all items, so the parts find what one index would.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tests = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([terms_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], ["item_id", "terms"])

    tests = materialize(tests.mapInArrow(cut, "item_id long, terms array<string>").where(F.size("terms") > 0), "items")
    held_by = lambda own: own.select(F.explode(F.array_distinct("terms")).alias("term"))
    frequency = materialize(held_by(tests).groupBy("term").agg(F.count("*").alias("n")), "frequency")
    of_all = tests.agg(F.count("*").alias("count"), F.avg(F.size("terms")).alias("mean"), F.max(F.size("terms")).alias("longest"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    parts, width = max(1, -(-of_all["terms"] // INDEX_TERMS)), 2 * (of_all["longest"] or 1)
    out = None
    for part in range(parts):
        own = tests.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts)) == part)
        often = (frequency.join(held_by(own).distinct(), "term", "left_semi") if parts > 1 else frequency).select("term", "n").toArrow()
        often = dict(zip(often["term"].to_pylist(), often["n"].to_pylist()))
        own = own.toArrow()
        own = list(zip(own["item_id"].to_pylist(), own["terms"].to_pylist()))
        held = docs.sparkSession.sparkContext.broadcast(build_index(own, often, count=of_all["count"], mean=of_all["mean"], share=share))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches if index else ():
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    terms = terms_of(text or "")
                    if not terms:
                        continue
                    ids = np.array(list(map(index.vocabulary.get, terms, repeat(len(index.vocabulary)))), dtype=np.int64)
                    best: dict[int, tuple] = {}
                    for at, item, score in retrieve(index, ids, width):
                        passage = ids[at : at + width].tolist()
                        asked, answered = (overlap(p, passage) for p in index.parts(item))
                        if asked >= question_overlap and answered >= answer_overlap:
                            best[item] = max(best.get(item, (0.0,)), (score, asked, answered))
                    found += [(doc, index.items[i], *x) for i, x in sorted(best.items())]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        leaks = rows.mapInArrow(run, schema)
        out = leaks if out is None else out.unionByName(leaks)
    return out


def op4_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
