"""Examples of wrong pairs are those of all pairs, without making them."""

import random

import pytest

from lodestitch.operators import evaluate as E

SCHEMA = "id long, category string, truth string, predicted string"


def brute(rows, limit):
    pairs = [(x, y) for x in rows for y in rows if x[1] == y[1] and x[0] < y[0]]
    wrong = sorted((x[0], y[0], x[3], x[2], y[2]) for x, y in pairs if x[3] is not None and x[3] == y[3] and x[2] != y[2])[:limit]
    missed = sorted((x[0], y[0], x[2], x[3], y[3]) for x, y in pairs if x[2] == y[2] and (x[3] is None or x[3] != y[3]))
    return wrong, missed[:limit]


@pytest.mark.parametrize("seed", range(3))
def test_examples_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    truths = ["x"] * (30 * seed) + [f"t{i}" for i in range(6)]
    rows = [(i, rng.choice("ab"), rng.choice(truths), rng.choice(["e1", "e2", "e3", None])) for i in rng.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (1, 4, 20):
        wrong, missed = brute(rows, limit)
        assert [tuple(r) for r in E.false_merges(df, limit).collect()] == wrong
        assert [tuple(r) for r in E.missed_pairs(df, limit).collect()] == missed


def test_a_partner_behind_very_many_of_one_label(spark):
    df = spark.range(50_000).selectExpr("id", "'c' as category", "if(id = 49999, 'late', 'early') as truth", "'e' as predicted")
    assert [(r.a, r.b) for r in E.false_merges(df, 3).collect()] == [(0, 49999), (1, 49999), (2, 49999)]
    assert E.missed_pairs(df, 3).collect() == [] and E.false_merges(df.limit(0)).collect() == []
