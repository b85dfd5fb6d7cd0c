"""Pairs of blocks: every pair once, compared by class, and no pair in a shuffle."""

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG
from lodestitch.operators import blocks, resolve
from lodestitch.plans import queries as Q
from lodestitch.plans.materialize import stored

DATA = "/root/testdata/sf0.001"


def bag(**values):
    return {k: (v, None, "s", "rule", 0.9) for k, v in values.items()}


@pytest.fixture(scope="module")
def records(spark):
    bags = [bag(material="X", size="DN50"), bag(material=" x", size="DN50"), bag(material="Y"), {}, None]
    rows = [(i, R.VALVE if i % 7 else None, bags[i % 5], "k" if i < 90 else ("l" if i < 99 else None), f"c{i}") for i in range(100)]
    return stored(spark.createDataFrame(rows, f"id long, category string, attrs {BAG}, key string, code string"))


@pytest.mark.parametrize("part", [7, 2048])
def test_every_pair_of_a_block_once_with_what_the_plain_join_says(records, part):
    found = blocks.in_blocks(records, ["key"], part=part)
    assert found.bags.count() < 12 and found.members.count() == 99
    sides = F.col("a_attrs"), F.col("b_attrs"), F.col("category")
    said = stored(blocks.class_pairs(found).select("x", "y", C.compare_prepared(*sides[:2], sides[2], F.array(F.lit("material"), F.lit("size"))).alias("s")))
    state = F.transform("s", lambda c: c["state"])
    got = blocks.pairs_of(found, said, of_record=["code"]).select("a", "b", "a_code", "b_code", state.alias("s")).collect()
    one, two = records.select(F.col("id").alias("a"), F.col("attrs").alias("x"), "key", "category"), records.select(F.col("id").alias("b"), F.col("attrs").alias("y"), "key")
    plain = C.compare_bags(F.col("x"), F.col("y"), F.col("category"), F.array(F.lit("material"), F.lit("size")))
    want = one.join(two, "key").where("a < b").select("a", "b", F.transform(plain, lambda c: c["state"]).alias("s")).collect()
    assert sorted((r.a, r.b, r.s) for r in got) == sorted((r.a, r.b, r.s) for r in want) and len(want) == 90 * 89 // 2 + 9 * 8 // 2
    assert all(r.a_code == f"c{r.a}" and r.b_code == f"c{r.b}" for r in got)


@pytest.mark.parametrize("name", ["pair_compare", "pair_safety_gate", "pair_score"])
def test_no_pair_is_shuffled(spark, name):
    """Above the generators that make the pairs there is no exchange; formerly all pairs went through one, with both bags."""
    text = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("Generate")]
    assert "Exchange" not in above


def test_leading_pairs_give_the_rows_of_all_pairs(spark):
    v, entity_of, leading = Q._entities_by_type(spark, DATA)
    every = Q.scored_pairs(spark, DATA)
    assert 0 < leading.count() <= 3 * v.count()
    for rows in (resolve.review_rows, resolve.crosswalk):
        assert sorted(map(str, rows(v, entity_of, leading).collect())) == sorted(map(str, rows(v, entity_of, every).collect()))
