import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from gleaner.llm.common import scratch_dir
from gleaner.llm.packing import op2_pack_windows, pack, sequences, tokenize, tokenizer_path
from gleaner.llm.sharding import fisher_yates, op1_shuffle_shards, shuffle_shards

SF = "/root/testdata/sf0.001"


def test_every_document_gets_one_gapless_slot(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_shuffle_shards(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fisher_yates_is_a_uniform_permutation():
    seen = Counter(tuple(fisher_yates(3, np.random.default_rng(k))) for k in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert fisher_yates(0, np.random.default_rng(0)).tolist() == []


def test_shards_keep_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "a", 7), (1, "a", 7), (2, None, 8), (None, "b", 9), (3, "", 0), (4, "é" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = shuffle_shards(docs, scratch_dir(spark, "t"), bucket_bytes=1000).collect()
    assert Counter(tuple(r.record) for r in out) == Counter(rows)
    assert len({r.shard for r in out if r.doc_id == 1}) == 1
    assert shuffle_shards(docs.limit(0), scratch_dir(spark, "t")).count() == 0


def check_pieces(pieces, docs, tokenizer):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for sequence, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 4096 or sequence == max(by_sequence)


def test_pieces_hold_each_id_once(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces(op2_pack_windows(spark, SF).collect(), docs, Tokenizer.from_file(tokenizer_path()))


def test_odd_texts_round_trip(spark):
    texts = [None, "", " ", "\x01", "a \x01 b", "I'll <|endoftext|> x", "A\tB C　d  e", "ÅΣ é ΟΔΟΣ 12 4½ x_y", "word " * 9000, "z" * 5000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as part").repartition(3)
    tokens = tokenize(docs, tokenizer=tokenizer_path())
    pieces = pack(tokens, window=64)
    tok = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokens.collect()}
    assert got == {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    whole = sorted(sequences(pieces, window=64).collect(), key=lambda r: r.sequence_id)
    assert [r.n_tokens for r in whole[:-1]] == [64] * (len(whole) - 1) and {len(r.ids) for r in whole} == {256}
    assert sum(r.n_tokens for r in whole) == sum(map(len, got.values()))
    assert pack(tokenize(docs.limit(0), tokenizer=tokenizer_path())).count() == 0


def test_long_plain_texts_are_cut_between_words(monkeypatch):
    from gleaner.llm import packing

    encoder = packing.WordEncoder(packing.tokenizer_path())
    texts = ["The 12 quick brown foxes, jumped " * 40, "x" * 500, "", "a b", "word " * 99 + "end"]
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(packing, "PIECE", 64)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == whole
    assert "".join(packing.cut_after_spaces(texts[0], 64)) == texts[0] and max(map(len, packing.cut_after_spaces(texts[0], 64))) < 80


def test_ids_are_cut_without_python(spark):
    docs = spark.createDataFrame([(7, "word " * 700), (8, None), (9, "a b"), (9, "a b")], "doc_id long, text string").coalesce(1)
    tokens = tokenize(docs, tokenizer=tokenizer_path())
    pieces = pack(tokens, window=64)
    assert "MapInArrow" not in pieces._jdf.queryExecution().toString()
    laid = np.frombuffer(b"".join(r.ids for r in tokens.collect()), "<u4")
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    assert b"".join(r.ids for r in rows) == laid.tobytes() and [r.length for r in rows if r.doc_id == 8] == [1]
    assert all(len(r.ids) == 4 * r.length and (r.start + r.length == r.doc_tokens or r.offset + r.length == 64) for r in rows)
