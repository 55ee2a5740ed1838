"""Operator 12: grouping of spelling variants by an index of variable-length grams.

Grams of a word are as long as they must be to be rare: the dictionary holds every frequent gram's extensions and no
others, so that no list of the index is long unless its gram has full length. An edit changes the grams that cover its
place; the most that cover any one place bound how many of a word's grams can be lost, and so how many of its rarest
grams must be looked up for one that both words keep. What both words share on the edit's other side is part of the
key. Short lists are merged pair by pair and verified; the members of long lists meet by what is left of them without
one code point, never pair by pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, shuffle_partitions, table
from gleaner.llm.hashing import INVERSE, mix, powers, prefix_sums
from gleaner.llm.passages import text_batches

#: Runs of these letters are words once A-Z are in lower case.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Different words that a task counts before it hands them on.
HELD = 300_000
#: Lengths of grams, and the list length up to which a gram is not extended; at most 2 ** 17 grams have longer lists.
SHORTEST, LONGEST, LIST, FREQUENT = 2, 5, 64, 1 << 17
#: Members of an index list that are merged pair by pair.
MERGED = 32
#: Letters of such words that are hashed at a time.
TOLD = 1 << 16
BEGIN, END = "^", "$"


def _counted(counts: Counter, names: list[str]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names)
    counts.clear()
    return out


def corpus_words(docs: DataFrame, *, every: int = 199, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``shortest`` code points of all texts and how often they occur.

    Where ``every`` divides the checksum of ``<doc_id>:<word>`` the word loses the code point at that checksum modulo its
    length first; 0 leaves all words alone. A null id counts as an empty one, a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for rows in text_batches(batches, 1):
            for doc, raw in rows:
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # Other letters become question marks; bytes lower-case A-Z alone.
                text = raw.decode("utf-8", "surrogatepass").encode("latin-1", "replace").lower().decode("latin-1")
                for word, n in Counter(RUN.findall(text)).items():
                    if len(word) < shortest:
                        continue  # nor is it longer with a code point less
                    if every and (h := zlib.crc32(word.encode(), head)) % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield _counted(counts, ["word", "n"])
        if counts:
            yield _counted(counts, ["word", "n"])

    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, *, longest: int = LONGEST, list_size: int = LIST) -> dict[str, int]:
    """The grams below full length that more than ``list_size`` words' places hold, with their numbers of places.

    The dictionary of the index is every shortest gram and every gram that extends one of these. Where more than
    FREQUENT of them would be, the list size grows until at most as many can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                padded = BEGIN + word + END
                for q in range(SHORTEST, longest):
                    counts.update(padded[k : k + q] for k in range(len(padded) - q + 1))
            if len(counts) >= HELD:
                yield _counted(counts, ["gram", "n"])
        if counts:
            yield _counted(counts, ["gram", "n"])

    grams = materialize(words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    return {r["gram"]: r["n"] for r in grams.where(F.col("n") > max(list_size, total // FREQUENT)).collect()}


def decompose(word: str, frequent: dict[str, int], longest: int = LONGEST) -> tuple[list[tuple[int, int]], int]:
    """The gram at every place of the padded word (begin and end), and the most of them that one edit can change.

    A gram is extended while it is frequent, so it depends on the characters that it covers and on no others: an edit
    changes it only if it covers the changed place, or both sides of an inserted code point.
    """
    padded = BEGIN + word + END
    size = len(padded)
    grams, over = [], [0] * (size + 1)
    for begin in range(size - 1):
        end = begin + SHORTEST
        while end < size and end - begin < longest and padded[begin:end] in frequent:
            end += 1
        grams.append((begin, end))
        over[begin] += 1
        over[end] -= 1
    most = now = 0
    for k in range(size - 1):
        now += over[k]
        if k and now > most:
            most = now
    return grams, most


def index_keys(words: DataFrame, frequent: dict[str, int], *, longest: int = LONGEST) -> DataFrame:
    """(key, id, word, n): every word under its rarest grams, one more than an edit can change.

    Each has two keys: with all that is left of the gram, for an edit to its right, and with all that is right of it.
    """
    held = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids, names, counts = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), 512):
                parts, owner = [], []
                for k in range(at, min(at + 512, len(ids))):
                    padded = BEGIN + names[k] + END
                    grams, lost = decompose(names[k], known, longest)
                    # Equal grams stay in the order of their places; several may end at one.
                    rarest = sorted(grams, key=lambda g: (known.get(padded[g[0] : g[1]], 0), padded[g[0] : g[1]]))[: lost + 1]
                    own = [*(padded[:end] for end in {end for _, end in rarest}), *(padded[begin:] + END for begin, _ in rarest)]
                    parts += own
                    owner += [k] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.string()), pa.array([ids[k] for k in owner], pa.int64()), pa.array([names[k] for k in owner], pa.string()), pa.array([counts[k] for k in owner], pa.int64())], ["part", "id", "word", "n"]
                )

    return words.select("id", "word", "n").mapInArrow(run, "part string, id long, word string, n long").select(F.xxhash64("part").alias("key"), "id", "word", "n")


def _twins(members: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): the near pairs among the members (id, word, n) of long lists, each once, a < b.

    Each tells its hashes without each code point (128 bits): with the place, equal ones differ there alone; without it, the
    hash of a whole word is that of a word with one code point more.
    """

    def tell(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[1]) for r in rows], dtype=np.int64)
        begin, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        of = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(data))
        # Without any one of a run of equal code points the same word is left: the first stands for all.
        head = np.append(True, data[1:] != data[:-1]) | (place == begin[of])
        length, at = sizes.astype(np.uint64), (place - begin[of]).astype(np.uint64)
        columns = []
        for own in (data, data ^ np.uint8(0x55)):
            sums, shift = prefix_sums(own), powers(INVERSE, len(data))[begin]
            left, right = (sums[place] - sums[begin][of]) * shift[of], (sums[end][of] - sums[place + 1]) * shift[of]
            changed = mix(left + right + mix(at + (length[of] << np.uint64(32))))
            deleted = mix(left + right * np.uint64(INVERSE) + length[of] - np.uint64(1))[head]
            columns.append(pa.array(np.concatenate([changed, deleted, mix((sums[end] - sums[begin]) * shift + length)]).view(np.int64)))
        who = np.concatenate([of, of[head], np.arange(len(rows))])
        kind = np.repeat(np.array([0, 1, 2], dtype=np.int8), [len(of), int(head.sum()), len(rows)])
        ids, counts = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 2))
        return pa.RecordBatch.from_arrays([*columns, pa.array(kind), pa.array(ids[who]), pa.array(counts[who])], ["x", "y", "kind", "id", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, width = [], 0
            for k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((k, word.encode("latin-1"), n))
                width += len(word)
                if width >= TOLD:
                    yield tell(rows)
                    rows, width = [], 0
            if rows:
                yield tell(rows)

    told = materialize(members.select("id", "word", "n").mapInArrow(run, "x long, y long, kind byte, id long, n long"), "told")

    def side(kind: int, name: str) -> DataFrame:
        return told.where(F.col("kind") == kind).select("x", "y", F.col("id").alias(name), F.col("n").alias(f"{name}_n"))

    same = side(0, "a").join(side(0, "b"), ["x", "y"]).where("a < b")
    more = side(1, "a").join(side(2, "b"), ["x", "y"])
    return same.select("a", "b", "a_n", "b_n").unionByName(more.select(*(F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("a_n", "b_n"), ("b_n", "a_n")))))


def near_words(words: DataFrame, *, longest: int = LONGEST, list_size: int = LIST, merged: int = MERGED) -> DataFrame:
    """(a, b, a_n, b_n): all pairs of ``words`` (id, word, n) that one inserted, deleted or replaced code point parts, a < b."""
    keys = materialize(index_keys(words, frequent_grams(words, longest=longest, list_size=list_size), longest=longest), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("members"))
    short = keys.join(sizes.where((F.col("members") > 1) & (F.col("members") <= merged)).select("key"), "key")
    a, b = (short.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "word", "n"))) for side in "ab")
    met = a.join(b, "key").where(F.col("a_id") < F.col("b_id")).where(F.abs(F.length("a_word") - F.length("b_word")) <= 1)
    met = met.where(F.levenshtein("a_word", "b_word", 1) == 1).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_n", "b_n")
    long = keys.join(sizes.where(F.col("members") > merged).select("key"), "key").select("id", "word", "n").distinct()
    return met.unionByName(_twins(long)).distinct()


def variants(words: DataFrame, *, ratio: int = 5, longest: int = LONGEST, list_size: int = LIST, merged: int = MERGED) -> DataFrame:
    """One row per word of ``words`` (word, n): word, n, n_near (words one edit away), form (the commonest of these, ties
    to the first in code-point order, if at least ``ratio`` times as common), form_n and root (the end of the forms).

    Words hold letters up to U+00FF. Words are different rows; repeated and null ones count once and not at all. An empty table gives no row.
    """
    # Ids ascend with the words, so that the smallest id is the first word.
    words = materialize(words.where("word is not null").groupBy("word").agg(F.max("n").alias("n")).orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    words = words.repartition(shuffle_partitions(words.sparkSession), "id")  # short rows, long work
    pairs = near_words(words, longest=longest, list_size=list_size, merged=merged)
    sides = [pairs.select(F.col(x).alias("id"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")]
    best = sides[0].unionByName(sides[1]).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct(F.col("other_n"), (-F.col("other")).alias("last"))).alias("best"), F.max("n").alias("n"))
    best = best.select("id", "n_near", F.when(F.col("best.other_n") >= ratio * F.col("n"), -F.col("best.last")).alias("form"), F.when(F.col("best.other_n") >= ratio * F.col("n"), F.col("best.other_n")).alias("form_n"))
    best = materialize(best, "best")
    # Every step makes a word commoner, so forms have no cycle; their reach doubles each round.
    reach = best.where("form is not null").select("id", F.col("form").alias("root"))
    while True:
        further = reach.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        reach = materialize(reach.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if not reach.where("moved").limit(1).count():
            break
        reach = reach.drop("moved")
    # Words without a form take no part in these joins.
    names = words.select(F.col("id").alias("other"), F.col("word").alias("name"))
    led = best.where("form is not null").select("id", F.col("form").alias("other")).join(names, "other").select("id", F.col("name").alias("form_word"))
    led = led.join(reach.select("id", F.col("root").alias("other")).join(names, "other").select("id", F.col("name").alias("root_word")), "id")
    out = words.join(best.select("id", "n_near", "form_n"), "id", "left").join(led, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the corpus' words of at least 6 code points and 5 occurrences."""
    return variants(corpus_words(table(spark, sf_dir, "documents")).where("n >= 5"))
