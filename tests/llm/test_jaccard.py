import random
import re

import numpy as np
import pytest

from gleaner.llm.components import connected_components
from gleaner.llm.hashing import word_hashes
from gleaner.llm.jaccard import Tree, first_of, join, keys_of, minima, op9_count_vector_join, tree_pairs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, width, num, den):
    sets = {}
    for k, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in docs}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op9_count_vector_join(spark, sf).collect()} == brute(docs, 3, 90, 100)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_edited_copies_of_all_sizes_equal_brute_force(spark, width, num, den):
    rng, docs = random.Random(9), {}
    for family in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 40, 90, 200, 500]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(words)
            for _ in range(int(len(copy) * rng.choice([0, 0.004, 0.01, 0.02, 0.04, 0.05]))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            copy = copy[: max(1, int(len(copy) * rng.choice([1, 1, 0.97, 0.93, 0.9])))]
            docs[len(docs) * 3 + family] = " ".join(copy)
            if rng.random() < 0.3:
                words = copy  # chains
    docs |= {9001: None, 9002: "", 9003: " \t\n", 9004: "A b", 9005: "a B", 9006: "É b", 9007: "z" * 2_000_000}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as key", "2 as sid", "3 as n").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame, width=width, num=num, den=den).collect()}
    assert got == brute(docs, width, num, den)


def test_repeats_null_ids_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in join(frame).collect()))
    assert got == [(0, 1), (1, 1), (1, 1), (2, 2)]
    assert join(frame.limit(0)).count() == 0


def test_rows_without_an_id_link(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (5, " ".join([*words, "z"])), (None, "p q r s"), (None, "p q r s")]
    got = sorted((r.doc_id or 0, r.component_id) for r in join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.component_id)
    assert got == [(0, 5), (5, 5)]


def test_blocks_of_a_large_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr("gleaner.llm.jaccard.BLOCK", 4)
    monkeypatch.setattr("gleaner.llm.jaccard.STAR_ROUNDS", 1)
    rng, docs = random.Random(3), {}
    base = [f"w{k}" for k in range(80)]
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(80)] = f"x{rng.randrange(9)}"
        docs[k] = " ".join(copy)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame).collect()} == brute(docs, 3, 90, 100)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(500, 300)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(101)}, 300: 300, 500: 300}


def test_first_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100)):
        for n in [*range(1, 60), 200, 777]:
            a = np.unique(rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
            alone = len(a) * (den - num) // (den + num)
            b = np.unique(np.concatenate([rng.choice(a, len(a) - alone, replace=False), rng.integers(0, (1 << 64) - 1, alone, dtype=np.uint64)]))
            both, order = np.intersect1d(a, b), {}
            if den * len(both) >= num * (len(a) + len(b) - len(both)):
                for s in (a, b):
                    own, more = keys_of(s, num, den)
                    assert len(own) + len(more) >= first_of(len(s), num, den)
                    for k in own.tolist():
                        order[k] = (0, int(k in both), k)
                    for k in more.tolist():
                        order[k] = (1, k)
                firsts = [set(sorted((k for x in keys_of(s, num, den) for k in x.tolist()), key=order.get)[: first_of(len(s), num, den)]) for s in (a, b)]
                assert firsts[0] & firsts[1]


def test_tree_finds_the_pairs_whose_minima_would_do():
    rng = np.random.default_rng(5)
    n = rng.integers(20, 400, 300)
    groups = [64 if k < 150 else 256 for k in n]
    counts = [np.bincount(rng.integers(0, g, k), minlength=g).astype(np.int32) for k, g in zip(n, groups)]
    for k in range(0, 300, 3):  # near copies
        n[k], counts[k] = n[k - 1] + 1, counts[k - 1] + (np.arange(len(counts[k - 1])) == 5)
    comp = rng.integers(0, 250, 300)
    tree = Tree(n, n, comp, counts)
    found = {tuple(sorted(x)) for i, j, _ in tree_pairs(tree, tree, 80, 100) for x in zip(i.tolist(), j.tolist())}
    fine = {(i, j) for i in range(300) for j in range(i + 1, 300) if comp[i] != comp[j] and min(n[i], n[j]) * 180 >= 80 * (n[i] + n[j]) and minima(counts[i][None], counts[j][None])[0] * 180 >= 80 * (n[i] + n[j])}
    assert fine <= found and len(found) < 3 * len(fine) and fine


def test_word_hashes_do_not_depend_on_cuts():
    text = " ".join(f"word{k % 977}" for k in range(200_000)).encode()
    whole, bounds = word_hashes([b"", text, b" a  b ", b"x" * (3 << 20)])
    assert np.diff(bounds).tolist() == [0, 200_000, 2, 1]
    assert len(np.unique(whole[:200_000])) == 977 and np.array_equal(whole[:977], whole[977:1954])
    assert whole[0] == whole[977] == word_hashes([b"word0"])[0][0]
