"""Operator 8: language identification by multilingual mixture inference.

Every word of a text has a likelihood under each learned language, the product of its character trigrams' probabilities.
Expectation-maximisation over the words estimates the text's language proportions; among the nested sets of its most
present languages the one with the highest likelihood less a penalty for each language is selected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import table

#: Trigrams are hashed to so many bins.
BINS = 1 << 16
#: Characters handled at a time.
PIECE = 1 << 20
UNKNOWN = "und"
_GAPS = re.compile(r"[\W\d_]+")


def clean(text: str) -> str:
    """The text's words of letters in lower case, each followed by one space."""
    out = _GAPS.sub(" ", text.lower()).strip(" ")
    return f"{out} " if any(map(str.isalpha, out)) else ""


def trigrams(words: str) -> tuple[np.ndarray, np.ndarray]:
    """For text as :func:`clean` gives it: the bin of the trigram around each letter, and where each word begins."""
    c = np.frombuffer(f" {words}".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA6B)) ^ (c[2:] * np.uint32(0xC2B2AE35))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    letter = c[1:-1] != 32
    begins = np.flatnonzero(letter & (c[:-2] == 32))
    return (mixed >> np.uint32(16))[letter], np.cumsum(letter)[begins] - 1


def pieces(words: str) -> Iterator[str]:
    """Cut between words into parts of about PIECE characters."""
    at = 0
    while at < len(words):
        end = words.find(" ", at + PIECE)
        end = len(words) if end < 0 else end + 1
        yield words[at:end]
        at = end


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_documents: int = 5_000, most_languages: int = 256) -> tuple[list[str], np.ndarray]:
    """Learn smoothed log probabilities of trigram bins, (BINS, languages) as float32, and the languages in order.

    ``fit_documents`` bounds the expected number of labelled documents used for each language, whole; they are picked by a
    hash of the id, so a rare language is learned at any size of the table. More than ``most_languages`` different
    labels are an error: the model takes 256 kB for each, on the driver and in every task. Rows without text or language
    are left out; without any row, and on an empty table, no language is learned.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(known) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    if not known:
        return [], np.zeros((BINS, 0), dtype=np.float32)
    bound = F.create_map(*(F.lit(x) for r in known for x in (r["lang"], int(min(1.0, fit_documents / r["n"]) * (1 << 20)))))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(8), F.col(id_col)), F.lit(1 << 20)) < F.element_at(bound, F.col(lang_col).cast("string")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = found.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                for part in pieces(clean(text)):
                    counts += np.bincount(trigrams(part)[0], minlength=BINS)
        for lang, counts in found.items():
            bins = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins), pa.array(counts[bins])], ["lang", "bin", "n"])

    counts = picked.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(count, "lang string, bin long, n long")
    learned = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(learned["lang"]))
    grid = np.full((BINS, len(langs)), 0.5)
    for k, lang in enumerate(langs):
        own = learned[learned["lang"] == lang]
        grid[own["bin"].to_numpy(dtype=np.int64), k] += own["n"].to_numpy(dtype=np.float64)
    return langs, np.log(grid / grid.sum(axis=0, keepdims=True)).astype(np.float32) if langs else grid.astype(np.float32)


def infer(texts: list[str], logs: np.ndarray, *, rounds: int = 12) -> list[tuple[int, float, int, float] | None]:
    """For each text: its language, that language's share, the size of the selected set, and the mean gain of a trigram
    over an even guess; None for a text without letters or when no language is learned."""
    out: list[tuple[int, float, int, float] | None] = [None] * len(texts)
    if not logs.shape[1]:
        return out
    cleaned = [clean(t) for t in texts]
    own = [k for k, t in enumerate(cleaned) if t]
    if not own:
        return out
    sums, grams, letters = [], [], []
    for part in pieces("".join(cleaned[k] for k in own)):
        bins, begins = trigrams(part)
        sums.append(np.add.reduceat(logs[bins], begins, axis=0))
        letters.append(np.diff(np.append(begins, len(bins))))
    words, sizes = np.concatenate(sums), np.concatenate(letters)
    n = np.array([cleaned[k].count(" ") for k in own])
    first = np.cumsum(n) - n
    grams = np.add.reduceat(sizes, first)
    best = words.max(axis=1)
    like = np.exp(words - best[:, None])

    def climb(like: np.ndarray, share: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares after so many rounds, and each text's log likelihood beside the best language of every word."""
        begin = np.cumsum(n) - n
        for _ in range(rounds):
            each = like * np.repeat(share, n, axis=0)
            each /= each.sum(axis=1, keepdims=True) + np.float32(1e-30)
            share = np.add.reduceat(each, begin, axis=0) / n[:, None].astype(np.float32)
        mixed = (like * np.repeat(share, n, axis=0)).sum(axis=1) + np.float32(1e-30)
        return share, np.add.reduceat(np.log(mixed, dtype=np.float64), begin)

    count = logs.shape[1]
    share, full = climb(like, np.full((len(own), count), 1 / count, dtype=np.float32), n, rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    chosen = order[:, 0].copy()
    alone = np.add.reduceat(np.log(like[np.arange(len(like)), np.repeat(chosen, n)] + np.float32(1e-30), dtype=np.float64), first)
    score, size, top = np.ones(len(own)), np.ones(len(own), dtype=int), alone.copy()
    fee = 0.5 * np.log(n + 1.0)
    open_ = np.flatnonzero(full - fee > alone)  # no larger set can beat one language elsewhere
    if len(open_):
        rows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in open_])
        for s in range(2, count + 1):
            kept = np.zeros((len(open_), count), dtype=np.float32)
            np.put_along_axis(kept, order[open_, :s], 1, axis=1)
            begin = share[open_] * kept + np.float32(1e-6) * kept
            mine, total = climb(like[rows], begin / begin.sum(axis=1, keepdims=True), n[open_], 4)
            value = total - (s - 1) * fee[open_]
            better = value > top[open_]
            at = open_[better]
            top[at], size[at] = value[better], s
            chosen[at], score[at] = mine[better].argmax(axis=1), mine[better].max(axis=1)
    even = np.log(BINS)
    raw = np.add.reduceat(words[np.arange(len(words)), np.repeat(chosen, n)].astype(np.float64), first)
    gain = raw / grams + even
    for j, k in enumerate(own):
        out[k] = (int(chosen[j]), float(min(1.0, score[j])), int(size[j]), float(gain[j]))
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), n_languages (size of the selected set), gain.

    The text alone decides. Null texts and texts without a letter get ``und`` with score 0; so does every text when no
    language was learned. ``gain`` tells how much better the language explains a trigram than an even guess does.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BINS rows for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = held.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found, some, width = [], [], 0
            for text in texts:
                some.append(text or "")
                width += len(some[-1])
                if width >= PIECE // 2:
                    found += infer(some, logs)
                    some, width = [], 0
            found += infer(some, logs)
            columns = [
                pa.array([langs[x[0]] if x else UNKNOWN for x in found], pa.string()),
                *(pa.array([x[k] if x else 0 for x in found], kind) for k, kind in ((1, pa.float64()), (2, pa.int32()), (3, pa.float64()))),
            ]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "lang_pred", "score", "n_languages", "gain"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, n_languages int, gain double")


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", is_held_out(F.col("doc_id")))
