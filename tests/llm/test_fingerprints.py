"""Fingerprints: entropies and edited texts against plain versions, order and every edge."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import fingerprints
from gleaner.llm.fingerprints import LEVELS, WINDOW, Chain, compare, edited_pairs, entropy_levels, features, fingerprint, op13_improbable_digest, rarity


def ranks_of(texts):
    """Ranks from window entropies summed one by one."""
    most = sum(np.diff([round(c * math.log2(c) * (1 << 20)) if c else 0 for c in range(WINDOW + 1)]).tolist())
    counts = Counter()
    for text in texts:
        for k in range(len(text) - WINDOW + 1):
            own = sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(text[k : k + WINDOW]).values())
            counts[(most - own) * LEVELS // most] += 1
    order = sorted(range(LEVELS + 1), key=lambda x: (x < fingerprints.DULL, counts[x], -x))
    out = np.empty(LEVELS + 1, dtype=np.int64)
    out[order] = np.arange(LEVELS + 1)
    return out


def chain(text, ranks):
    return Chain.of(features([text.encode()], ranks)[0][1])


def brute(rows, ranks):
    rows = [(k, t or "") for k, t in rows]
    out = []
    for (k, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        a, b, c = (chain(t, ranks) for t in (text, edited, after))
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    return out


def test_features_are_the_winners_of_their_neighbours():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 117, 700).astype(np.uint8).tobytes() + b"a" * 60 + rng.integers(97, 105, 300).astype(np.uint8).tobytes()
    ranks = ranks_of([text])
    levels = entropy_levels(np.frombuffer(text, dtype=np.uint8))
    (places, hashes), = features([text], ranks)
    windows = {text[k : k + WINDOW]: [] for k in range(len(levels))}
    for k, h in zip(places.tolist(), hashes.tolist()):
        windows[text[k : k + WINDOW]].append(h)
        wins = 0
        for first in range(k - fingerprints.RIVALS + 1, k + 1):
            inside = [i for i in range(first, first + fingerprints.RIVALS) if 0 <= i < len(levels)]
            wins += all(ranks[levels[k]] <= ranks[levels[i]] for i in inside)
        assert wins >= fingerprints.WINS
    assert len(places) > 20 and all(len(set(h)) <= 1 for h in windows.values())


def test_pieces_and_neighbours_in_a_batch_change_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 110, n).astype(np.uint8).tobytes() for n in (0, 5, 15, 16, 17, 40, 900, 0, 3000)]
    ranks = ranks_of(texts)
    alone = [features([t], ranks)[0] for t in texts]
    for piece, strip in ((1 << 20, 1 << 16), (100, 64)):
        monkeypatch.setattr(fingerprints, "PIECE", piece)
        monkeypatch.setattr(fingerprints, "STRIP", strip)
        for one, other in zip(features(texts, ranks), alone):
            assert np.array_equal(one[0], other[0]) and np.array_equal(one[1], other[1])
    assert [len(p) for p, _ in alone[:3]] == [0, 1, 1]


def test_chains():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    whole, part, other, none = Chain.of(h[:800]), Chain.of(h[:600]), Chain.of(h[1000:]), Chain.of(h[:0])
    assert str(Chain.parse(str(whole))) == str(whole) and str(none) == "0:"
    assert whole.likeness(whole) == none.likeness(none) == 1 and whole.likeness(none) == none.likeness(whole) == 0
    assert whole.likeness(other) < 0.05 and whole.likeness(part) == part.likeness(whole) > 0.9
    assert Chain.of(np.concatenate([h[:300], h[:300]])).n == 300


def test_edges_order_and_clashing_names(spark):
    rows = [(7, "seven " * 30, 1, "x"), (3, None, 2, "y"), (5, "", 3, None), (None, "no id, some words and more of them", 4, "z"), (9, "ä" * 41, 5, "q"), (9, "ä" * 41, 5, "q"), (1, "tiny", 6, "t"), (2, "tiny", 7, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, key string").repartition(3)
    found = edited_pairs(docs).collect()
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    ranks = ranks_of([(t or "").encode() for _, t in ordered])
    assert rarity(docs)[0].tolist() == ranks.tolist()
    assert Counter(map(tuple, found)) == Counter(brute(ordered, ranks))
    assert edited_pairs(docs.where("false")).collect() == []
    one = edited_pairs(docs.where("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0 and one.n_chars == 180
    seen = {r.doc_id: r for r in fingerprint(docs, ranks).collect()}
    assert seen[1].fingerprint == seen[2].fingerprint != seen[7].fingerprint and seen[3].n_features == seen[5].n_features == 0
    pairs = spark.createDataFrame([(seen[1].fingerprint, seen[2].fingerprint), (seen[1].fingerprint, seen[7].fingerprint), (None, "0:")], "a string, b string")
    assert [r.likeness for r in compare(pairs, "a", "b").collect()] == [1.0, 0.0, None]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table_against_brute_force(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))
    ranks = ranks_of([t.encode() for _, t in rows])
    found = sorted(map(tuple, op13_improbable_digest(spark, f"/root/testdata/{sf}").collect()))
    assert found == brute(rows, ranks)
    # Three quarters stay; next documents are unrelated but for the copies in the table.
    long = [r for r in found if r[1] >= 1000]
    kept, after = (sorted(r[k] for r in long) for k in (5, 6))
    assert kept[len(long) // 20] > 0.5 and after[-len(long) // 20] < 0.05
