"""Spelling variants: against comparing all words, with short and long index lists."""

import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from gleaner.llm.spelling import corpus_words, decompose, near_words, op12_variable_grams, variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(words):
    shorter = {}
    for w in words:
        for part in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            shorter.setdefault(part, []).append(w)
    pairs = {(a, b) for group in shorter.values() for a in group for b in group if near(a, b)}
    close = {}
    for a, b in pairs:
        close.setdefault(a, set()).add(b)
    best = {w: min(s, key=lambda x: (-words[x], x)) for w, s in close.items()}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(close.get(w, ())), words.get(form.get(w))) for w, n in words.items()}


def rows(df):
    got = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def test_an_edit_changes_no_more_grams_than_its_bound():
    rng = random.Random(3)
    frequent = {"ab": 9, "ba": 9, "aba": 9, "^a": 9, "bab": 8, "abab": 7}
    for _ in range(500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(6, 10)))
        k = rng.randrange(len(word))
        other = rng.choice([word[:k] + word[k + 1 :], word[:k] + "c" + word[k:], word[:k] + "b" + word[k + 1 :], word + "a"])
        (grams, lost), (more, _) = decompose(word, frequent), decompose(other, frequent)
        left = Counter(f"^{word}$"[i:j] for i, j in grams) - Counter(f"^{other}$"[i:j] for i, j in more)
        assert left.total() <= lost < len(grams)


@pytest.mark.parametrize("list_size, merged", [(64, 32), (3, 2), (2, 1000)])
def test_random_words_against_all_pairs(spark, list_size, merged):
    rng = random.Random(list_size)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(6, 9))): rng.choice([5, 6, 30, 31, 200, 2000]) for _ in range(600)}
    long = "x" * 3000
    words |= {long: 7, long + "y": 70, long[:1500] + "z" + long[1500:]: 70, "aaaaaaaaaa": 5, "aaaaaaaaaaa": 25, "aaaaaaaaaaaa": 125}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(variants(df, list_size=list_size, merged=merged)) == brute(words)


def test_forms_lead_on_and_ties_go_to_the_first_word(spark):
    words = {"colour": 100, "colours": 20, "coloursz": 4, "color": 9, "abcdefg": 5, "abcdefh": 25, "abcdefi": 25}
    df = spark.createDataFrame([*words.items(), (None, 3), ("colour", 100)], "word string, n long")
    found = rows(variants(df))
    assert found == brute(words)
    assert found["coloursz"][:2] == ("colours", "colour") and found["abcdefg"][0] == "abcdefh" and found["color"][1] == "colour"


def test_words_of_texts(spark):
    docs = [(1, "Apple apple APPLE ÄPFEL äpfel xĀapples naïve×÷", 5), (None, "apple apple", 6), (2, None, 7), (3, "", 8), (1, "apple", 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n int")
    want = Counter()
    for k, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{word}".encode())
            if h % 3 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            want[word] += 1
    found = {r.word: r.n for r in corpus_words(df, every=3, shortest=1).collect()}
    assert found == {w: n for w, n in want.items() if w}
    assert corpus_words(df.where("false")).collect() == []
    assert variants(corpus_words(df.where("false"))).collect() == []


def test_no_near_words(spark):
    df = spark.createDataFrame([(1, "abcdef", 5), (2, "uvwxyz", 5)], "id long, word string, n long")
    assert near_words(df).collect() == []


def test_whole_table_against_brute_force(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    counts = Counter()
    for k, text in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert rows(op12_variable_grams(spark, "/root/testdata/sf0.01")) == brute(words)
