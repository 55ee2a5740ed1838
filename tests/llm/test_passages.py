import hashlib
import random
import re

from gleaner.llm import common
from gleaner.llm.passages import op3_block_anchors, remove_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """docs: [(doc_id, text)] with unique ids."""
    first, words = {}, {k: WORDS.findall(t or "") for k, t in docs}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), (k, i))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (k, i):
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for k, (n, gone, kept) in brute(docs, 20).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op3_block_anchors(spark, sf).collect()} == want
    assert sum(x[1] > 0 for x in want.values()) > 50


def test_overlapping_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    docs = [(k * 7 - 30, " ".join(w for _ in range(rng.randrange(0, 9)) for w in rng.choice(passages))) for k in range(120)]
    docs += [(5001, None), (5002, ""), (5003, "x " * 70_000), (5004, "x " * 30), (5005, " ".join(map(str, range(100_000)))), (5006, " ".join(map(str, range(65_530, 65_560))))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as uid", "2 as places").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed or 0, r.kept) for r in remove_repeats(frame, window=6).collect()}
    for k, (n, gone, kept) in brute(docs, 6).items():
        assert got[k][:2] == (n, gone) and got[k][2] in ((kept,) if gone else (None, kept))


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text), (None, text + " end")]
    got = sorted((r.doc_id or 0, r.n_removed or 0) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 50), (1, 50), (2, 50)]
    assert remove_repeats(spark.createDataFrame(rows[:1], "doc_id long, text string").limit(0)).count() == 0


def test_a_written_step_leaves_no_shuffle_files(spark, monkeypatch):
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    monkeypatch.setattr(common, "release", lambda spark: None)  # the driver's collector may be late
    before, setting = held(), spark.conf.get(common.CLEANUP)
    rows = common.materialize(spark.range(1000, numPartitions=4).selectExpr("id % 100 as k").groupBy("k").count(), "t")
    assert not held() - before and spark.conf.get(common.CLEANUP) == setting
    assert rows.count() == 100
