import hashlib
import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import decontamination
from gleaner.llm.decontamination import find_leaks, op4_bm25_leaks, terms_of
from gleaner.llm.language import fit, op8_language_mixture, predict
from gleaner.llm.privacy import find, op5_sanitise_terms, sanitise, span_text
from gleaner.llm.secrets import guess_cost, op7_guess_cost, scan

SF = "/root/testdata/sf0.01"


def test_held_out_languages_are_predicted(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language_mixture(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in own)
    assert right / len(own) > 0.97 and min(r.gain for r in own) > 0
    for r in rows:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id].text or "")))


def test_mixtures_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs)
    long = {r.lang: r.text for r in docs.where("n_chars > 2000").collect()}
    rows = [(1, long["de"] * 2 + " " + long["fr"]), (2, None), (3, ""), (4, "12 ²½ !"), (5, "a"), (6, long["es"] * 400), (7, "xqzj wvkq jjzx qqkw " * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as score")
    got = {r.doc_id: r for r in predict(frame, model).collect()}
    assert got[1].lang_pred == "de" and got[1].n_languages >= 2 and 0.5 < got[1].score < 0.85
    assert [got[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and got[6].lang_pred == "es" and got[6].score > 0.95
    assert got[7].gain < 0 < got[6].gain
    assert predict(docs.limit(3), fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def base_pii(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    ]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))]


def test_base_personal_data_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_sanitise_terms(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = base_pii(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base) and set(base) <= set(filter(None, r.spans.split(",")))


def test_generated_personal_data_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["1", "25", "0", ".", "-", " ", "@", "a", "é", "+", "(", "%", "x.y", "10.0.0.1", "4111 1111 1111 1111", "a@b.co", "😀"]) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += [None, "", "a" * 9_000, "1" * 5_000, "1 " * 60_000, "a.b@" * 3_000, "+1" * 5_000, "x@y.zq%w@k.lm", "000.00256.1.2 0000.1.1.255"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as base", "2 as spans").repartition(8)
    got = {r.doc_id: r.s for r in find(frame).select("doc_id", span_text("base").alias("s")).collect()}
    assert got == {k: ",".join(base_pii(t or "")) for k, t in enumerate(texts)}


def test_terms_that_reveal_an_entity_are_removed(spark):
    rows = [(k, f"plain words about Zorblax{'' if k % 2 else ','} mail jo@corp.example.org now {k}") for k in range(8)]
    rows += [(100 + k, f"plain words about nothing much mail now q{k}x") for k in range(200)] + [(900, "Zorblax alone")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = find(frame, min_texts=5)
    got = {r.doc_id: r.s for r in frame.join(found.drop("text"), "doc_id").select("doc_id", sanitise(frame.text, found.spans).alias("s")).collect()}
    assert got[1] == "plain words about  mail <email> now 1" and got[0] == "plain words about , mail <email> now 0"
    assert got[900] == "Zorblax alone" and got[101] == dict(rows)[101]


def test_terms_of_rare_entities_are_removed(spark):
    rows = [(0, "call Quillfeather under jo@corp.example.org now")]  # one document
    rows += [(1 + k, "call Brindlemoss under al@corp.example.org now") for k in range(3)] + [(9, "Brindlemoss now")]  # copies, one stray
    rows += [(10, "call Stonewhistle under bo@corp.example.org or cy@corp.example.org now"), (11, "Stonewhistle now")]  # a stray against one
    rows += [(100 + k, f"call nobody under any address now q{k}x") for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.s for r in frame.join(find(frame).drop("text"), "doc_id").select("doc_id", sanitise(frame.text, F.col("spans")).alias("s")).collect()}
    assert got[0] == "call  under <email> now" and got[1] == got[2] == got[3] == "call  under <email> now"
    assert got[9] == "Brindlemoss now" and got[100] == dict(rows)[100]
    assert got[10] == "call Stonewhistle under <email> or <email> now" and got[11] == "Stonewhistle now"


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_secrets_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_guess_cost(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = base_secrets(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= {*r.spans.split(","), ""}
        assert r.n_assign + r.n_access + r.n_hex == len(list(filter(None, base.split(","))))


def test_guess_costs_and_odd_texts(spark):
    ranks = {"correct": 200, "horse": 300}
    assert guess_cost("", ranks) == 0 and math.isclose(guess_cost("x", ranks), 1 + math.log10(2))
    strong = guess_cost("vR7$kQ2!zPw9uL", ranks)
    assert strong > 12 > max(guess_cost(v, ranks) for v in ("correcthorse", "aaaaaaaaaaaaaaaa", "qwertyuiopasdf", "abcabcabcabcabcabc", "2024-03-17", "CorrectHorse1"))
    assert guess_cost("x9" * 5000, ranks) < 20
    rows = [(1, 'pwd: "vR7$kQ2!zPw9uL"'), (2, "bearer=correctcorrect"), (3, None), (4, ""), (5, "é token = abcdefgh1 TOKEN:'short'"), (5, "ſecret=12345678"), (6, "a" * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base")
    got = {r.doc_id: r.spans for r in scan(frame.where("text not like 'ſ%' or text is null")).collect()}
    assert got[1] == "guess:6:20" and got[5] == "assign:2:19" and got[3] == got[4] == "" and got[6] == "hex:0:50000"
    assert scan(frame.limit(0)).count() == 0
    rows = [(1, "password = vR7kQ2zPw9uLmX"), (2, "secret: 'two words & 7Gq!zR'"), (3, "token=aaaaaaaaaaaa"), (3, "token=aaaaaaaaaaaa"), (4, "api_key=" + "a" * 300_000)]
    got = sorted((r.doc_id, r.spans, r.guesses) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0][1] == "assign:0:25,guess:11:25" and got[1][1] == "guess:9:27" and got[2] == got[3] and got[2][1] == "assign:0:18" and got[2][2].startswith("6:18:")
    assert got[4][1] == "assign:0:300008,hex:8:300008"


def all_prices(value, ranks):
    """The cheapest segmentation by trying every segment between every two places."""
    low, n = value.lower(), len(value)
    dates = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
    place = {c: (k, j) for k, row in enumerate(("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")) for j, c in enumerate(row)}
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            part, size = low[i:j], j - i
            costs = [size * 1.0]
            if part in ranks:
                costs.append(math.log10(ranks[part] + 1) + math.log10(2) * (value[i:j] != part))
            if dates.fullmatch(value[i:j]):
                costs.append(math.log10(36500))
            if size >= 3 and len(set(value[i:j])) == 1:
                costs.append(1 + math.log10(size))
            if size >= 4 and all(c in place for c in part):
                moves = [(place[b][0] - place[a][0], place[b][1] - place[a][1]) for a, b in zip(part, part[1:])]
                if all(m != (0, 0) and abs(m[0]) <= 1 and abs(m[1]) <= 1 for m in moves):
                    costs.append(math.log10(47) + math.log10(size) + math.log10(4) * sum(a != b for a, b in zip(moves, moves[1:])))
            best[j] = min(best[j], best[i] + math.log10(2) + min(costs))
            for block in range(2, 9):
                if i >= block and size >= block and all(low[k] == low[k - block] for k in range(i, j)):
                    best[j] = min(best[j], best[i] + math.log10(1 + size / block))
    return best[n]


def test_guess_costs_equal_all_segmentations():
    rng, ranks = random.Random(7), {"monkey": 40, "key": 90, "uio": 700, "aaa": 5, "was": 2, "mon": 9}
    parts = ["monkey", "yuiop", "uiop", "aaa", "aaaaaa", "Key", "2024", "20240317", "17.03.2024", "asdf", "fdsa", "wasd", "abab", "xyzxyz", "q", "7", "!", "1234", "MON", "ytrewq"]
    for _ in range(600):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 6)))
        assert math.isclose(guess_cost(value, ranks), all_prices(value, ranks), abs_tol=1e-9), value


def test_planted_benchmark_items_are_found(spark):
    docs = {r.doc_id: " ".join(terms_of(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: " ".join(terms_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in op4_bm25_leaks(spark, SF).collect()}
    assert whole <= got and len(got - whole) <= max(3, len(whole) // 20) and whole


def test_leaks_of_odd_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, "x " * 5000 + item + " y" * 9000), (2, None), (3, ""), (4, "alpha kappa " * 50), (1, item)], "doc_id long, text string").selectExpr("*", "1 as item_id")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item), (11, "!")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect())
    assert got == [(1, 7), (1, 7), (1, 10), (1, 10)]
    assert find_leaks(docs, items.limit(0)).count() == 0 == find_leaks(docs.limit(0), items).count()


def test_the_index_of_many_items_is_sparse_and_retrieves_all():
    rng = random.Random(8)
    items = [(k, [f"w{min(rng.randrange(1, 40_000), rng.randrange(1, 40_000))}" for _ in range(rng.randrange(5, 40))] + ["the"]) for k in range(3000)]
    often = Counter(t for _, terms in items for t in set(terms))
    mean = sum(len(t) for _, t in items) / len(items)
    index = decontamination.build_index(items, often, count=len(items), mean=mean, share=0.6)
    assert len(pickle.dumps(index)) < 8 << 20  # a dense one has 3,000 floats for each of its terms
    text = [t for k in range(0, 60) for t in (*items[k * 7][1], *(rng.choice(items)[1][:6]), "zzz")]
    ids = np.array([index.vocabulary.get(t, len(index.vocabulary)) for t in text])
    width, want = 80, set()
    for at in range(0, len(text) - width // 2, width // 2):
        passage = set(text[at : at + width])
        for k, terms in items:
            part = {t: math.log(1 + (3000 - often[t] + 0.5) / (often[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(terms) / mean)) for t, n in Counter(terms).items()}
            if sum(w for t, w in part.items() if t in passage) >= 0.6 * 0.9999 * sum(part.values()):
                want.add((at, k))
    assert {(at, index.items[i]) for at, i, _ in decontamination.retrieve(index, ids, width)} == want and len(want) > 50


def test_items_in_several_indexes_leak_alike(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 4)) for r in find_leaks(docs, items).collect())
    want = rows()
    monkeypatch.setattr(decontamination, "INDEX_TERMS", 500)
    assert rows() == want


def test_short_lists_are_read_and_long_ones_looked_up_alike(monkeypatch):
    rng = random.Random(9)
    items = [(k, [f"w{min(rng.randrange(1, 900), rng.randrange(1, 900))}" for _ in range(rng.randrange(5, 40))] + ["the"]) for k in range(400)]
    often = Counter(t for _, terms in items for t in set(terms))
    index = decontamination.build_index(items, often, count=len(items), mean=sum(len(t) for _, t in items) / len(items), share=0.3)
    ids = np.array([index.vocabulary.get(t, len(index.vocabulary)) for k in range(300) for t in (*items[k][1], "the", "zzz")])
    searches, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: searches.append(len(a[0])) or search(*a, **b))
    found, counts = [], []
    for lookup in (1 << 40, 0):
        monkeypatch.setattr(decontamination, "LOOKUP", lookup)
        found.append(decontamination.retrieve(index, ids, 80))
        counts.append(len(searches))
    assert found[0] == found[1] and len(found[0]) > 300
    assert counts[0] == 0 < counts[1]
