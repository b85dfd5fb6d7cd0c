"""Copies of a text cost a check no vector of their own and no comparison."""

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.operators import govern, nearest, resolve
from lodestitch.plans.materialize import stored

TEXTS = ["gt vlv, 6 in cl150 ss316 flgd", "gt vlv, 6 in cl300 ss316 flgd", "gt vlv, 4 in cl150 ss304 flgd", "GT VLV 6 IN CL150 SS316 FLGD", "PIPE SMLS 100 NB SCH 40; A106", "xyz", None]
COPIES = 12


def items(spark):
    return spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(COPIES * len(TEXTS))], "id long, raw_text string")


@pytest.fixture(scope="module")
def records(spark):
    return resolve.enrich_stored(items(spark), same="text")


def links(records):
    return records.select(F.col("id").alias("record_id"), F.concat(F.lit("E"), (F.col("id") % len(TEXTS)).cast("string")).alias("entity_id"))


def every_pair(queries, corpus, k, same=None):
    """Candidates without a search: all of a category, with made-up parts of the score."""
    q, c = (df.select(F.col("id").alias(i), F.coalesce("category", F.lit("unknown")).alias("part")) for df, i in ((queries, "query_id"), (corpus, "cand_id")))
    semantic, lexical = F.pmod(F.hash("query_id", "cand_id"), F.lit(11)) / 10, F.pmod(F.hash("cand_id"), F.lit(7)) / 7
    return q.join(c, "part").where("query_id <> cand_id").select("query_id", "cand_id", semantic.alias("semantic"), lexical.alias("lexical"), F.lit("both").alias("channel"))


def test_bags_are_compared_once_for_all_copies(records, monkeypatch):
    monkeypatch.setattr(govern, "hybrid_candidates", every_pair)
    found, said = govern._scored(records, records, links(records), 30, "text")
    # Two of four valves have one bag, so have both texts without a category.
    assert said.count() == 3 * 3 + 1 + 1
    side = lambda p: records.select(F.col("id").alias(f"{p}_id"), F.col("attrs").alias(f"{p}a"), F.col("category").alias(f"{p}_category"))
    joined = found.join(side("p"), F.col("query_id") == F.col("p_id")).join(side("c"), F.col("cand_id") == F.col("c_id"))
    m = C.match_score(F.col("pa"), F.col("ca"), F.col("semantic"), F.col("lexical"), F.col("p_category"))
    v = C.safety_verdict(F.col("pa"), F.col("ca"), F.col("p_category"))
    why = C.explanation(m["comparisons"], F.col("p_category"))
    rows = joined.select("query_id", "cand_id", "score", "v", "entity_id", m["score"].alias("plain"), v.alias("gate"), why.alias("why")).collect()
    n = COPIES
    assert len(rows) == 4 * n * (4 * n - 1) + n * (n - 1) + 2 * n * (2 * n - 1)
    assert all(r.entity_id == f"E{r.cand_id % len(TEXTS)}" and r.score == pytest.approx(r.plain, abs=1e-12) for r in rows)
    assert all((r.v.status, r.v.reason) == (r.gate.status, r.gate.reason) for r in rows)
    best: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, -int(r.plain * 1e9 + 0.5), r.cand_id)):
        best.setdefault(r.query_id, []).append((r.query_id, r.cand_id, r.gate.status, r.why))
    ranked = govern.ranked_candidates(records.select("id"), records, links(records), 10, same="text").collect()
    assert [(r.asked_id, r.record_id, r.verdict, r.explanation) for r in ranked] == [r for of in best.values() for r in of[:10]]


def test_a_text_that_many_have_is_stored_once(spark, monkeypatch):
    def run(few):
        kept = []
        monkeypatch.setattr(resolve, "FEW_TEXTS", few)
        monkeypatch.setattr(resolve, "stored", lambda df: kept.append(stored(df)) or kept[-1])
        rows = {r.id: r for r in resolve.enrich_stored(items(spark)).collect()}
        return rows, max(t.count() for t in kept if "embedding" in t.columns)

    rows, most = run(100)
    assert most == len(TEXTS) and len(rows) == COPIES * len(TEXTS)
    assert run(0) == (rows, COPIES * len(TEXTS))


def test_copies_told_by_a_column_are_found_as_others(spark):
    made = [(i, "a" if i % 5 else None, [[1.0, 0.0], [0.6, 0.8], [1.0, 0.0], None, [0.0, 1.0]][i % 5], i % 5) for i in range(60)]
    df = spark.createDataFrame(made, "id long, category string, embedding array<float>, same int")
    rows = lambda found: sorted((r.query_id, r.cand_id, round(r.semantic, 9)) for r in found.collect())
    asked = df.where("id % 3 = 0")
    for queries in (df, asked):
        assert rows(nearest.cosine_top_k(queries, df, 7, same="same")) == rows(nearest.cosine_top_k(queries, df, 7))
