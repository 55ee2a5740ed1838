"""Alignment of two tokenizers: against whole-text encoding and sets of ends, at every edge."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gleaner.llm import alignment
from gleaner.llm.alignment import Pair, align, gallop, op11_gallop_alignment, scored
from gleaner.llm.common import materialize

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "   ", "a", "  a  b\n c \t", "<|endoftext|> <s> </s>", "\x00 y", "字字 字", "ﬁ é́ \xa0z", "don't 's  's", "a\u0085b c  d ", "😀😀 ünïcode", "x" * 3000, "ab " * 3000, " ́ x", "▁ ▁▁ a▁b"]


def brute(texts):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    decode = {c: k for k, c in enumerate(sorted({c for t in a.get_vocab() for c in t if t != "<|endoftext|>"}, key=ord))}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [k for k in range(256) if k not in printable]
    decode = {c: ord(c) if ord(c) < 256 else others[ord(c) - 256] for c in decode}
    found, links = [], []
    for text in texts:
        raw = (" " + (text or "")).encode()
        x, y = a.encode(" " + text, add_special_tokens=False) if text else None, b.encode(text or "")
        i = [bytes(decode[c] for c in t) for t in x.tokens] if x else []
        j = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in y)]
        if not text or b"".join(i) != raw or b"".join(j) != raw:
            found.append((0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (i, j)]
        shown, own, p, q = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            s, t = ends[0].index(end) + 1, ends[1].index(end) + 1
            shown.append(",".join(map(str, x.ids[p:s])) + "|" + ",".join(map(str, y[q:t])))
            own.append((x.ids[s - 1], y[t - 1]))
            p, q = s, t
        found.append((len(x.ids), len(y), ";".join(shown)))
        links.append(own)
    counts = Counter(pair for own in links for pair in own)
    most = Counter()
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    return [(n_a, n_b, len(own), len(own), sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), shown) for (n_a, n_b, shown), own in zip(found, links)]


def test_gallop_finds_what_a_sort_finds():
    rng = np.random.default_rng(7)
    for n, m in ((1, 1), (3, 1000), (500, 700), (2000, 40)):
        other = np.unique(rng.integers(0, 5000, m))
        driver = np.unique(np.minimum(rng.integers(0, 5000, n), other[-1]))
        bounds = np.unique(np.append(rng.integers(0, len(driver), 5), [0, len(driver)]))
        low = np.searchsorted(other, driver[bounds[:-1]]) // 2
        assert np.array_equal(gallop(driver, bounds, other, low), np.searchsorted(other, driver))


def test_parts_batches_and_forgetting_change_nothing(monkeypatch):
    texts = [t or "" for t in ODD] + ["the cat  sat\non the mat " * k for k in (1, 50)]
    want = brute(texts)
    for unit, keep, together, lane in ((150_000, 600_000, 10_000, 128), (7, 20, 3, 2)):
        for name, value in (("UNIT", unit), ("KEEP", keep), ("TOGETHER", together), ("LANE", lane)):
            monkeypatch.setattr(alignment, name, value)
        pair = Pair(A, B)
        figures, shown, owner, links = pair.align(texts)
        assert [(*f, b";".join(s).decode()) for f, s in zip(figures, shown)] == [(*w[:4], w[6]) for w in want]
        assert np.bincount(owner, minlength=len(texts)).tolist() == [w[3] for w in want]


def test_edges_nulls_repeats_and_clashing_names(spark):
    rows = [(k if k != 3 else None, t, k, "x") for k, t in enumerate([*ODD, "a", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int, groups string").repartition(3)
    found = scored(materialize(align(docs, a_path=A, b_path=B), "aligned"), b_size=32000).collect()
    want = Counter((r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows])))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in found) == want
    none = scored(materialize(align(docs.where("false"), a_path=A, b_path=B), "aligned"), b_size=32000)
    assert none.collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table_against_brute_force(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    want = {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in zip(table["doc_id"].to_pylist(), brute(table["text"].to_pylist()))}
    found = op11_gallop_alignment(spark, f"/root/testdata/{sf}").collect()
    assert len(found) == len(want)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found} == want
