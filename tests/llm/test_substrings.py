import hashlib
import random

import numpy as np

from gleaner.llm.substrings import op6_sampled_names, remove_substrings, samples


def brute(docs, length):
    seen = {}
    for k, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]] = seen.get(raw[i : i + length], 0) + 1
    out = {}
    for k, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 200)
    assert as_rows(op6_sampled_names(spark, sf)) == want and sum(x[1] > 0 for x in want.values()) > 5


def test_short_strings_of_generated_texts_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(5, 90))) for _ in range(14)]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 6))) + rng.choice(["", "x", "a" * 60])) for k in range(90)]
    docs += [(901, None), (902, ""), (903, "a" * 9000), (904, "ab" * 700), (905, "".join(rng.choice("abcdefgh") for _ in range(70_000))), (906, "q" * 24), (907, "q" * 25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as places", "3 as wide").repartition(5)
    assert as_rows(remove_substrings(frame, length=25)) == brute(docs, 25)


def test_repeated_rows_and_an_empty_table(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(40)) + "end"
    rows = [(1, text), (1, text), (2, "zz" + text), (None, "alone")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=30).collect())
    assert got == [(0, 0), (1, 43), (1, 43), (2, 43)]
    assert remove_substrings(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_samples_depend_on_the_string_alone():
    data = np.frombuffer(random.Random(1).randbytes(3_000_000), dtype=np.uint8)
    places, _, first, last = samples(data, 200)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((places >= last) & (places <= first + 128)).all()
    part, _, lo, hi = samples(data[1_000_000:1_200_000], 200)
    assert {*zip(part[1:-1] + 1_000_000, lo[1:-1] + 1_000_000, hi[1:-1] + 1_000_000)} <= {*zip(places, first, last)}
