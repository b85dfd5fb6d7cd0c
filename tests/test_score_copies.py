"""Scores of pairs come from pairs of bags, compared once."""

from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG
from lodestitch.operators import resolve
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


def test_bags_are_compared_once_for_all_pairs_of_equal_bags(spark, monkeypatch):
    records = made(spark, 60)
    pairs = records.select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("cand_id"))
    pairs = pairs.where("query_id <> cand_id").withColumns({"semantic": F.lit(0.5), "lexical": (F.col("cand_id") % 5) / 5, "channel": F.lit("x")})
    kept = []
    monkeypatch.setattr(resolve, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    scored = resolve.score_pairs(records, pairs)
    compared = [t.count() for t in kept if "comparisons" in t.columns]
    assert scored.count() == 60 * 59 // 2 and compared == [len(BAGS) ** 2]
    monkeypatch.setattr(resolve, "FEW_TEXTS", 0)
    numbered = records.withColumn("same", F.col("id") * 7 % 5)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(resolve.score_pairs(numbered, pairs, same="same")) == rows(scored)
