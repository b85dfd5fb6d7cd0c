"""Votes are added exactly."""

import random

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG
from lodestitch.operators import resolve


def test_equal_confidences_in_another_order_are_a_tie(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles; with equal votes and equal totals the text decides."""
    rng, rows = random.Random(5), []
    for entity in range(40):
        for value in "AB":
            sure = [i / 10 for i in range(1, 10)]
            rng.shuffle(sure)
            rows += [(len(rows) + i, R.VALVE, {"material": (value, None, "s", "rule", c)}, entity) for i, c in enumerate(sure)]
    records = spark.createDataFrame(rows, f"id long, category string, attrs {BAG}, entity_id long")
    won = resolve.survive(records, records.select("id", "entity_id")).collect()
    assert len(won) == 40 and {(w.canon, w.agreement) for w in won} == {("B", "9/18")}
