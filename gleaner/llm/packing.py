"""Operator 2: concatenate-and-cut packing of tokenised documents into fixed windows.

Pass one tokenises each document once, in its input partition, and records where it starts in that partition; the
partitions' token totals, summed in order, give each partition's global offset. Pass two adds the two numbers and cuts
the documents at multiples of the window; a document over a boundary leaves a piece on both sides.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, table, trim
from gleaner.llm.hashing import prefix_sums, stretch_hashes
from gleaner.llm.passages import text_batches

#: Partition offsets of 16 bytes are broadcast up to this number; beyond it Spark chooses the join.
BROADCAST_PARTS = 1_000_000
#: Characters of plain text that are tokenised at a time.
PIECE = 1 << 18
#: Latin letters whose lower case is one letter that no normal form changes, ASCII and common white space.
PLAIN = re.compile(r"[\t\n\r\x20-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*")
#: Class of each byte of such a text in lower case: white space, letter, digit or mark. The vocabulary splits between
#: runs of one class, and each digit from the next; its contractions begin with an apostrophe.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _LETTER, dtype=np.int8)
_CLASS[:128] = [_SPACE if c <= 32 else _DIGIT if 48 <= c < 58 else _LETTER if 97 <= c < 123 else _MARK for c in range(128)]
#: The printable characters that stand for bytes in a byte-level vocabulary; other bytes take those from 256 on. The
#: space stays, to part the words of a batch.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE})) if b != 0x20}
WORD_END = "</w>"


class WordEncoder:
    """Token ids of whole texts from the ids of their words.

    The vocabulary splits a text into words before it merges, so a text's ids are its words' ids in order. Plain texts
    are split here and each new word is encoded once, together with others; ``keep`` words are kept at most twice.
    Other texts go through the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        shown = b" ".join(words).decode("latin-1").translate(_BYTES)
        ids = np.asarray(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, dtype="<u4")
        raw, begin = ids.tobytes(), 0
        for key, end in zip(keys, ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), strict=True):
            self.young[key] = raw[begin:end]
            begin = end

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: words are found and told apart by 64-bit hashes, all at once."""
        lower = [t.lower().encode() for t in texts]
        joined = b" ".join([*lower, b""])
        data = np.frombuffer(joined, dtype=np.uint8)
        kind = _CLASS[data]
        before = np.concatenate([[np.int8(_SPACE)], kind[:-1]])
        edge = (kind != before) | (kind == _DIGIT)
        starts = np.flatnonzero(edge & (kind != _SPACE))
        ends = np.append(np.flatnonzero(edge[1:] & (before[1:] != _SPACE)) + 1, [])[: len(starts)].astype(np.int64)
        hashes = stretch_hashes(prefix_sums(data), starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        own = keys.tolist()
        missing = []
        for k, key in enumerate(own):
            if key not in self.young:
                ids = self.old.get(key)
                if ids is None:
                    missing.append(k)
                else:
                    self.young[key] = ids
        if missing:
            at = first[missing]
            self._learn([own[k] for k in missing], [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        found = list(map(self.young.__getitem__, own))
        sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
        pool, begins = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        to = np.cumsum(each)
        out = pool[np.repeat(begins[which] - (to - each), each) + np.arange(int(to[-1]) if len(to) else 0)]
        words = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lower)]))
        cuts = np.concatenate([[0], to])[words].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Plain texts are taken about PIECE characters at a time, longer
        ones cut after a space."""
        out: list[list[bytes] | None] = [None] * len(texts)
        some: list[tuple[int, str]] = []
        width = 0

        def flush() -> None:
            for (k, _), ids in zip(some, self._plain([t for _, t in some]) if some else ()):
                out[k].append(ids)
            some.clear()

        for k, text in enumerate(texts):
            if "'" in text or "<|" in text or not PLAIN.fullmatch(text):
                continue
            out[k] = []
            for part in cut_after_spaces(text, PIECE):
                some.append((k, part))
                width += len(part)
                if width >= PIECE:
                    flush()
                    width = 0
        flush()
        return [np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if parts is None else b"".join(parts) for t, parts in zip(texts, out)]


def cut_after_spaces(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, each but the last ending with a space."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size - 1) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def tokenize(docs: DataFrame, *, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: part, local_start (ids before it in its partition), n_tokens, doc_id, ids.

    ``ids`` holds little-endian unsigned 32-bit ids, closed by ``end_id``; a null text counts as empty and an empty
    text is the closing id alone. Repeated rows are packed each; an empty table gives no row. Texts go through in batches
    by bytes, very long ones in parts. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for some in text_batches(batches, 1):
            ids = [x + end for x in encoder.encode([raw.decode("utf-8", "surrogatepass") for _, raw in some])]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            begins = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            columns = [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(begins), pa.array(sizes), pa.array([k for k, _ in some], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "local_start", "n_tokens", "doc_id", "ids"])
        del encoder
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "part int, local_start long, n_tokens long, doc_id long, ids binary"
    )


def pack(tokens: DataFrame, *, window: int = 4096) -> DataFrame:
    """Cut :func:`tokenize`'s documents, laid end to end, into windows.

    One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary). Every id lies in exactly
    one piece, every window but the last is full, and a document of any length is cut as often as needed. Whole texts' ids
    don't go through Python again.
    """
    tokens = materialize(tokens, "tokens")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each input partition, a few bytes each: the second pass of the prefix sum.
    bases = totals.select("part", F.expr("sum(total) over (order by part rows unbounded preceding) - total").alias("base"))
    bases = F.broadcast(bases) if totals.count() <= BROADCAST_PARTS else bases
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("begin"), "n_tokens", "ids")
    cut = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(begin div {window}, (begin + n_tokens - 1) div {window})")))
    first = F.greatest(F.col("begin"), F.col("sequence_id") * window)
    length = F.least(F.col("begin") + F.col("n_tokens"), (F.col("sequence_id") + 1) * window) - first
    start = first - F.col("begin")
    ids = F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * length).cast("int"))
    return cut.select(
        "doc_id", start.alias("start"), length.alias("length"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", (first - F.col("sequence_id") * window).alias("offset"), ids.alias("ids")
    )


def sequences(pieces: DataFrame, *, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """The training sequences: sequence_id, n_tokens, ids (binary, padded to the window). At most ``window`` pieces meet in a group."""

    def assemble(key: tuple, group: pa.Table) -> pa.Table:
        ids = b"".join(group.sort_by("offset").column("ids").to_pylist())
        padded = ids + np.full(window - len(ids) // 4, pad_id, dtype="<u4").tobytes()
        return pa.table({"sequence_id": [key[0].as_py()], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids": pa.array([padded], pa.binary())})

    return pieces.groupBy("sequence_id").applyInArrow(assemble, "sequence_id long, n_tokens long, ids binary")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    pieces = pack(tokenize(docs, tokenizer=tokenizer_path()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens, one row per piece."""
    return packed_digest(table(spark, sf_dir, "documents"))
