"""Components that grow by edges are those of all edges."""

import random

from lodestitch.operators.graph import connected_components, extend_components


def labels(df):
    return {r.node: r.component for r in df.collect()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def test_growing_equals_starting_anew(spark):
    rng = random.Random(4)
    for seed in range(3):
        old = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
        new = [(rng.randrange(90), rng.randrange(90)) for _ in range(18)] + [(70, 70), (None, 3)]
        before = connected_components(frame(spark, old))
        grown = extend_components(before, frame(spark, new))
        assert labels(grown) == labels(connected_components(frame(spark, old + new))), seed
        rows, was = grown.collect(), labels(before)
        assert len(rows) == len({r.node for r in rows})
        members = lambda of: {c: {n for n, x in of.items() if x == c} for c in set(of.values())}
        now = labels(grown)
        for r in rows:
            same = r.node in was and members(was)[was[r.node]] == members(now)[r.component]
            assert r.touched is not same


def test_nothing_new(spark):
    before = connected_components(frame(spark, [(1, 2), (5, 4)]))
    grown = extend_components(before, frame(spark, []))
    assert labels(grown) == {1: 1, 2: 1, 4: 4, 5: 4} and not any(r.touched for r in grown.collect())
    assert labels(extend_components(before.limit(0), frame(spark, [(3, 2)]))) == {2: 2, 3: 2}
