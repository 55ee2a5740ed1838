"""Preference accuracy by counts against all pairs."""

import random

from gleaner.operators import evaluation as E


def test_counts_give_what_all_pairs_give(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc") if k % 9 else None, rng.choice((None, -1.5, 0.0, 2.0, rng.random())), rng.choice((0, 1, 2, None))) for k in range(500)]
    out = E.preference_accuracy_within(spark.createDataFrame(rows, "g string, s double, q int"), by=["g"], score="s", label="q").first()
    pairs = [(x[1], y[1]) for x in rows for y in rows if x[0] and x[0] == y[0] and x[2] == 1 and y[2] == 0]
    won = [0.0 if None in p else 1.0 if p[0] > p[1] else 0.5 if p[0] == p[1] else 0.0 for p in pairs]
    assert out.pairs == len(pairs) and abs(out.accuracy - sum(won) / len(won)) < 1e-12


def test_pairs_are_not_made_and_none_have_no_accuracy(spark):
    side = spark.range(400_000).selectExpr("cast(id % 2 as int) q", "1 g", "id % 10 s")
    out = E.preference_accuracy_within(side, by=["g"], score="s", label="q").first()
    assert out.pairs == 40_000_000_000 and out.accuracy == 0.6
    assert tuple(E.preference_accuracy_within(side.where("q = 1"), by=["g"], score="s", label="q").first()) == (None, 0)
