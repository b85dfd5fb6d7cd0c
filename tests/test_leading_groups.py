"""Leading pairs come from groups of like records and equal those of all pairs."""

from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG
from lodestitch.operators import blocks, resolve
from lodestitch.plans.materialize import stored


def bag(**values):
    return {k: (v, None, "s", "rule", 0.9) for k, v in values.items()}


BAGS = [
    bag(material="SS316", size="DN50", pressure_class="CL150"), bag(material="SS316", size="DN50"), bag(material="CS", size="DN50", pressure_class="CL150"),
    bag(material="SS316", size="DN80", pressure_class="PN20"), {},
]


def made(spark, n):
    rows = [(i, f"o{i % 4}", f"c{i}", R.VALVE, BAGS[i * 7 % 5], "k" if i % 9 else ("l" if i % 2 else None), i * 3 % 8, i % 3) for i in range(n)]
    return stored(spark.createDataFrame(rows, f"id long, source_org string, local_code string, category string, attrs {BAG}, key string, entity_id long, rest long"))


def test_groups_of_like_records_meet_and_lead_to_the_same_rows(spark, monkeypatch):
    records = made(spark, 240)
    found = blocks.in_blocks(records.select("id", "category", "attrs", "key", "entity_id", "rest"), ["key"])

    def rated(said):
        scored = resolve.with_score(said, F.lit(0.9), (F.col("a") % 3 + F.col("b") % 3) / 4)
        return scored.withColumn("route", resolve.route(F.col("score"), F.col("verdict")))

    every = stored(rated(blocks.pairs_of(found, resolve.said_of_blocks(found))))
    assert every.where("route = 'blocked'").count() and every.where("route = 'review'").count()
    met = []
    monkeypatch.setattr(resolve, "pairs_of", lambda b, *a, **k: met.append(b.members.count()) or blocks.pairs_of(b, *a, **k))
    entity_of = records.select("id", "entity_id")
    for alike, groups in ((["rest"], found.members.select("key", "class", "rest").distinct().count()), (None, found.members.count())):
        met.clear()
        leading = resolve.leading_pairs(found, rated, alike)
        assert groups == min(met) <= (21 if alike else 240)
        for rows in (resolve.review_rows, resolve.crosswalk):
            assert sorted(map(str, rows(records, entity_of, leading).collect())) == sorted(map(str, rows(records, entity_of, every).collect()))
