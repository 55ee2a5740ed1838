"""Import of a corpus under new ids: references follow, twice adds nothing, faults stop it."""

import struct

import pytest

from gleaner.sources import corpus as K


def corpus(spark, items, pairs=(), data=struct.pack("<2f", 1, 2), split="calibration"):
    ids = {key: k for k, key in items.items()}
    rows = {
        "items": [(k, key, split) for k, key in items.items()], "vectors": [(k, "v1", 2, data) for k in items], "labels": [(k, "quality", float(len(key))) for k, key in items.items()],
        "pairs": [(k, ids[a], ids[b], ids[a]) for k, a, b in pairs], "rounds": [(k + 100, f"{a}{b}", k) for k, a, b in pairs],
    }
    return {name: spark.createDataFrame(own, K.SCHEMAS[name]) for name, own in rows.items()}


def test_references_follow_and_twice_adds_nothing(spark, tmp_path):
    base = corpus(spark, {1: "a", 2: "b", 3: "c"}, [(1, "a", "b")])
    other = corpus(spark, {70: "c", 71: "d", 72: "b", 73: "e"}, [(9, "d", "c"), (10, "c", "b"), (11, "b", "e")])
    K.export_corpus(other, f"file://{tmp_path}/x", excluded=spark.createDataFrame([(11,)], "id long"))
    read = K.read_corpus(spark, f"file://{tmp_path}/x")
    merged, counts = K.import_corpus(base, read)
    assert counts == {"items": 2, "vectors": 2, "labels": 2, "pairs": 2, "rounds": 2}
    ids = {r.key: r.id for r in merged["items"].collect()}
    assert ids == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    assert {(r.id, r.left_id, r.right_id, r.preferred_id) for r in merged["pairs"].collect()} == {(1, 1, 2, 1), (2, 3, 2, 3), (3, 4, 3, 4)}
    assert {(r.key, r.pair_id) for r in merged["rounds"].collect()} == {("ab", 1), ("dc", 3), ("cb", 2)}
    assert {r.item_id: r.value for r in merged["labels"].collect()} == {k: 1.0 for k in range(1, 6)}
    _, again = K.import_corpus(merged, read)
    assert set(again.values()) == {0}


def test_faults_stop_an_import(spark, tmp_path):
    base = corpus(spark, {1: "a"})
    for other, fault in (
        (corpus(spark, {5: "b"}, data=b"123"), "vectors.data"), (corpus(spark, {5: "b"}, data=struct.pack("<2f", 1, float("nan"))), "vectors.data"),
        (corpus(spark, {5: "b"}, data=struct.pack("<2f", float("-inf"), 1)), "vectors.data"), (corpus(spark, {5: "a"}, split="held_out"), "items.split"),
    ):
        with pytest.raises(ValueError, match=fault):
            K.import_corpus(base, other)
    lost = corpus(spark, {5: "b"}) | {"labels": spark.createDataFrame([(6, "quality", 1.0)], K.SCHEMAS["labels"])}
    with pytest.raises(ValueError, match="labels.item_id"):
        K.import_corpus(base, lost)
    K.export_corpus(corpus(spark, {5: "b"}) | {"labels": spark.createDataFrame([(5, 1.0)], "item_id long, value double")}, f"file://{tmp_path}/y")
    with pytest.raises(ValueError, match="labels: columns"):
        K.read_corpus(spark, f"file://{tmp_path}/y")
