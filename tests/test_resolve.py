"""The whole run on a seeded catalogue, and its parts on hand-made clusters."""

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG
from lodestitch.operators import evaluate, govern, reports, resolve
from lodestitch.operators.graph import connected_components
from lodestitch.operators.lexical import bm25_top_k
from lodestitch.operators.nearest import cosine_top_k
from lodestitch.operators.retrieval import hybrid_candidates
from lodestitch.plans import jobs
from lodestitch.plans.materialize import materialize
from lodestitch.sources import snapshots, synthetic


@pytest.fixture(scope="module")
def catalogue(spark):
    return materialize(synthetic.catalogue(spark))


@pytest.fixture(scope="module")
def records(catalogue):
    return materialize(resolve.enrich(catalogue))


@pytest.fixture(scope="module")
def plan(records):
    p = resolve.resolve(records)
    p.crosswalk, p.review, p.entities = map(materialize, (p.crosswalk, p.review, p.entities))
    return p


def labelled(records, catalogue, plan):
    predicted = plan.crosswalk.select(F.col("record_id").alias("id"), F.col("entity_id").alias("predicted"))
    return records.select("id", "category").join(catalogue.select("id", "truth"), "id").join(predicted, "id", "left")


def whole(df):
    return next(r for r in df.collect() if r.category is None)


def test_no_unsafe_merge_and_enough_recall(records, catalogue, plan):
    m = whole(evaluate.pair_metrics(labelled(records, catalogue, plan)))
    assert m.precision == 1.0 and m.recall >= 0.6
    groups = catalogue.where("hard_group is not null").select("truth", "hard_group").distinct()
    assert evaluate.hard_slice(labelled(records, catalogue, plan), groups).first().fp == 0
    assert evaluate.false_merges(labelled(records, catalogue, plan)).count() == 0


def test_every_record_has_one_entity_and_one_review_row(records, plan):
    n = records.count()
    assert plan.crosswalk.count() == plan.review.count() == n
    snapshots.assert_consistent(records, plan.crosswalk, plan.entities, plan.review)
    counts = plan.crosswalk.groupBy("entity_id").agg(F.count("*").cast("int").alias("n"))
    assert plan.entities.join(counts, "entity_id").where("n <> member_count").count() == 0
    spanning = plan.crosswalk.groupBy("entity_id").agg(F.count_distinct("source_org").alias("o")).where("o > 1").count()
    assert spanning >= 20


def test_records_that_arrive_later_join_what_is_there(records, catalogue):
    """Only the new records search; nothing is merged wrongly, every record has one entity, and the older clusters that are not met stay."""
    late = F.col("id") % 5 == 0
    before = resolve.resolve(materialize(records.where(~late)))
    after = resolve.resolve_more(before, materialize(records.where(late)))
    after.crosswalk = materialize(after.crosswalk)
    m = whole(evaluate.pair_metrics(labelled(records, catalogue, after)))
    assert m.precision == 1.0 and m.recall >= 0.6
    snapshots.assert_consistent(records, after.crosswalk, after.entities, after.review)
    assert after.pairs.groupBy("a", "b").count().where("count > 1").count() == 0
    was = {r.id: r.cluster for r in before.clusters.collect()}
    now = {r.id: r.cluster for r in after.clusters.collect()}
    assert len(now) == records.count()
    # Records that were together stay together.
    moved = {(was[i], now[i]) for i in was}
    assert len({a for a, _ in moved}) == len(moved)


def test_without_the_gate_items_are_merged_wrongly(records, catalogue, plan):
    loose = resolve.resolve(records, gate=False)
    m = whole(evaluate.pair_metrics(labelled(records, catalogue, loose)))
    assert m.precision < 0.9 and m.fp > 0 and loose.entities.count() < plan.entities.count()


def test_candidate_recall(records, catalogue):
    t = catalogue.select("id", "truth")
    truth = t.select(F.col("id").alias("a"), "truth").join(t.select(F.col("id").alias("b"), "truth"), "truth").where("a < b").select("a", "b")
    assert evaluate.candidate_recall(truth, hybrid_candidates(records, records)).first().recall >= 0.95


def test_two_runs_are_equal(records, plan):
    again = resolve.resolve(records)
    assert again.crosswalk.exceptAll(plan.crosswalk).count() == 0 and again.entities.count() == plan.entities.count()


@pytest.mark.parametrize("texts", [[], ["GATE VALVE 6 IN"], ["thing one", "thing one"]])
def test_degenerate_catalogues(spark, texts):
    rows = [(i, "ORG", str(i), t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, source_org string, local_code string, raw_text string, category string")
    p = resolve.resolve(materialize(resolve.enrich(df)))
    assert p.crosswalk.count() == p.review.count() == p.entities.count() == len(texts)


def test_top_k_plans_do_no_cartesian_product(records):
    for df in (cosine_top_k(records, records), bm25_top_k(records, records), hybrid_candidates(records, records)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "WindowGroupLimit" in text


# ---- parts --------------------------------------------------------------------------------


def test_components_of_small_graphs(spark):
    edges = [(1, 2), (2, 3), (5, 5), (9, 8), (8, 7), (7, 6), (3, 1), (None, 4)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).collect() == []


def members(spark, classes, key="pressure_class"):
    base = {"material": "CS", "size": "DN150", "item_type": "GATE VALVE"}
    one = lambda v: (v, None, "s", "rule", 0.9)
    rows = [(i + 1, R.VALVE, {k: one(v) for k, v in (base | ({key: c} if c else {})).items()}) for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, f"id long, category string, attrs {BAG}")


def test_contradictory_clusters_are_cut(spark):
    r = members(spark, ["CL150", "CL150", "CL300", None])
    inside = r.select("id", F.lit(1).cast("long").alias("component"))
    found = {x.id: (x.cluster, x.proposal) for x in resolve.split_clusters(r, inside).collect()}
    assert found == {1: (1, None), 2: (1, None), 3: (3, None), 4: (4, 1)}
    assert {x.cluster for x in resolve.split_clusters(r, inside, gate=False).collect()} == {1}
    assert [(x.field, x["values"]) for x in resolve.contradictions(r, inside).collect()] == [("pressure_class", ["CL150", "CL300"])]


def test_majority_wins(spark):
    r = members(spark, ["CL150", "CL300", "CL150"])
    entity = r.select("id", F.lit("E").alias("entity_id"))
    found = {x.key: x for x in resolve.survive(r, entity).collect()}
    p = found["pressure_class"]
    assert (p.value_str, p.agreement, p.agreement_ratio, p.contested, p.source_record_ids) == ("CL150", "2/3", 0.6667, ["CL300"], [1, 3])
    assert p.confidence == pytest.approx(0.9 * (0.6 + 0.4 * 2 / 3), abs=1e-4) and found["size"].contested is None
    tie = resolve.survive(members(spark, ["CL150", "CL300"]), entity).where("key = 'pressure_class'").first()
    assert tie.value_str == "CL300"
    e = spark.createDataFrame([("E", R.VALVE, 3), ("X", None, 1)], "entity_id string, category string, members int")
    golden = {x.entity_id: x.description for x in resolve.golden_records(resolve.survive(r, entity), e).collect()}
    assert golden == {"E": "GATE VALVE, DN150, CS, CL150", "X": R.NO_DESCRIPTION}


# ---- publishing and decisions -------------------------------------------------------------


def test_jobs_publish_at_once_or_not_at_all(spark, records, tmp_path):
    base = str(tmp_path / "store")
    few = records.where("id <= 12")
    first = jobs.run(spark, few, base)
    assert snapshots.current_run(spark, base) == first
    assert snapshots.read_current(spark, base, "crosswalk").count() == 12
    twice = few.unionByName(few.limit(1).withColumn("id", F.lit(99).cast("long")))  # a code that occurs twice
    with pytest.raises(ValueError, match="codes that occur twice"):
        jobs.run(spark, twice, base)
    assert snapshots.current_run(spark, base) == first
    assert sorted(r.status for r in jobs.jobs(spark, base).collect()) == ["FAILED", "SUCCEEDED"]


def test_decisions_are_replayed(spark):
    base = spark.createDataFrame([(1, "A", "ACTIVE"), (2, "A", "ACTIVE"), (3, "B", "ACTIVE")], "record_id long, entity_id string, status string")
    log = spark.createDataFrame(
        [(3, "REJECT", "x", None, "r", 1), (3, "APPROVE", "x", "A", "r", 2), (1, "REJECT", "y", None, "r", 1)],
        "record_id long, decision string, reviewer string, target_entity string, reason string, decided_at long",
    )
    now = govern.current_crosswalk(base, log)
    assert {r.record_id: (r.entity_id, r.status) for r in now.collect()} == {1: ("A", "ACTIVE"), 2: ("A", "ACTIVE"), 3: ("A", "REVIEWER_CONFIRMED")}
    entities = spark.createDataFrame([("A", 2), ("B", 1)], "entity_id string, member_count int")
    assert [(r.entity_id, r.member_count) for r in govern.recounted_entities(entities, now).collect()] == [("A", 3)]
    review = spark.createDataFrame([(1, "NEEDS_REVIEW"), (3, "BLOCKED"), (2, "APPROVED")], "record_id long, status string")
    assert {r.record_id: r.status for r in govern.review_after(review, log).collect()} == {1: "REJECTED", 2: "APPROVED", 3: "APPROVED"}
    assert govern.audit_rows(log, base).first().to_entity == "A"
    bad = spark.createDataFrame([(2, "APPROVE", "A"), (9, "APPROVE", "A"), (1, "APPROVE", "Z"), (1, "MAYBE", None), (1, "APPROVE", "A")], "record_id long, decision string, target_entity string")
    found = [r.problem for r in govern.invalid_decisions(bad, review, entities).collect()]
    assert sorted(found) == ["item is closed", "no such item", "no such target entity", "unknown decision"]


def test_new_items_are_checked(spark, records, plan):
    probes = spark.createDataFrame(
        [(-1, "GATE VALVE 6 INCH CLASS 150 SS316 FLANGED"), (-2, "XYZ"), (-3, "PIPE DN600 SCH 160")], "id long, raw_text string"
    )
    found = govern.check_new_items(probes, records, plan.crosswalk).collect()
    best = {r.probe_id: r for r in found if r.rank <= 1}
    assert best[-1].recommendation == govern.USE_EXISTING and best[-2].recommendation == govern.REVIEW
    assert best[-3].recommendation != govern.USE_EXISTING and len([r for r in found if r.probe_id == -1]) <= 5
    ranked = govern.ranked_candidates(1, records, plan.crosswalk, 5).collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5] and ranked[0].would_merge


def test_pairs_without_a_category_are_counted(spark):
    rows = [(1, None, "x", "E"), (2, None, "x", "E"), (3, "pipe", "y", "F"), (4, "pipe", "y", None)]
    found = {r.category: (r.tp, r.fp, r.fn) for r in evaluate.pair_metrics(spark.createDataFrame(rows, "id long, category string, truth string, predicted string")).collect()}
    assert found == {"unknown": (1, 0, 0), "pipe": (0, 0, 1), None: (1, 0, 1)}


def test_reviews_are_compared_anew(spark):
    r = members(spark, ["CL150", "CL300"]).withColumn("raw_text", F.lit("t"))
    review = spark.createDataFrame([(1, 2), (1, None)], "record_id long, candidate_record long")
    found = {x.candidate_record: (x.verdict, x.states and x.states.mismatched) for x in reports.review_detail(review, r).collect()}
    assert found == {2: ("BLOCK", 1), None: (None, None)}


def test_prepared_bags_give_the_same_verdicts(records):
    from lodestitch.functions import compare as C

    pairs = records.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("cand_id"), F.lit(0.5).alias("semantic"), F.lit(0.5).alias("lexical"), F.lit("x").alias("channel"))
    scored = resolve.score_pairs(records, pairs)
    side = lambda p: records.select(F.col("id").alias(p), F.col("attrs").alias(f"{p}_attrs"), F.col("category").alias(f"{p}_category"))
    joined = scored.join(side("a"), "a").join(side("b"), "b")
    v = C.safety_verdict(F.col("a_attrs"), F.col("b_attrs"), F.col("a_category"))
    m = C.match_score(F.col("a_attrs"), F.col("b_attrs"), F.lit(0.5), F.lit(0.5), F.col("a_category"))
    rows = joined.select("verdict", "blocked_field", "score", v.alias("v"), m.alias("m")).collect()
    assert rows and all((r.verdict, r.blocked_field) == (r.v.status, r.v.blocked_field) and r.score == pytest.approx(r.m.score) for r in rows)


def test_previews_vectors_and_consistency(spark):
    from lodestitch.functions.compare import is_consistent
    from lodestitch.operators.lexical import pair_lexical
    from lodestitch.operators.retrieval import backfill_vectors, hashed_vector, index_stats, records_of

    row = resolve.preview(spark.createDataFrame([("GT VLV 6 IN",)], "raw_text string")).first()
    assert (row.category, row.norm_text, row.tokens) == (R.VALVE, "GATE VALVE DN150", ["GATE", "VALVE", "DN150"])
    assert "size" in row.attrs and len(row.trace) == 3
    df = spark.createDataFrame([(1, None, "a b", None), (2, "pipe", "c", [1.0]), (3, None, None, None)], "id long, category string, raw_text string, embedding array<float>")
    df = df.withColumn("norm_text", F.lit(None).cast("string"))
    found = {r.id: r.embedding for r in backfill_vectors(df).collect()}
    assert found[2] == [1.0] and len(found[1]) == 256 and sum(x * x for x in found[1]) == pytest.approx(1.0) and set(found[3]) == {0.0}
    two = spark.range(1).select(hashed_vector(F.lit("A B")).alias("x"), hashed_vector(F.lit("a, b")).alias("y")).first()
    assert two.x == two.y
    assert records_of(df, None).count() == 2
    assert {(r.category, r.records, r.with_vector) for r in index_stats(df).collect()} == {("unknown", 2, 0), ("pipe", 1, 1)}
    values = members(spark, ["x", " X "]).agg(F.collect_list(F.col("attrs")["pressure_class"]).alias("v"))
    assert values.select(is_consistent(F.col("v")).alias("c")).first().c
    corpus = spark.createDataFrame([(i, None, t.split()) for i, t in enumerate(("a b", "a c", "d e", "f g", "h i"))], "id long, category string, tokens array<string>")
    pair = pair_lexical(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"), corpus)
    lexical = {(r.a, r.b): r.lexical for r in pair.collect()}
    assert 0 < lexical[0, 1] < 1 and lexical[0, 2] == 0.0


def test_texts_are_enriched_once_for_all_records_that_have_them(spark, tmp_path):
    """300 records with two texts and none at all, and a given category: five rows are read, and each record gets what it would get by itself."""
    texts = ["gt vlv 6 in cl150", "HEX BLT M16 X 100", None]
    rows = [(i, texts[i % 3], R.PIPE if i % 4 == 0 and i % 3 != 2 else None) for i in range(300)]
    records = spark.createDataFrame(rows, "id long, raw_text string, category string")
    seen = tmp_path / "seen"

    def encoder(batch):
        with seen.open("a") as f:
            f.writelines("x\n" for _ in batch)
        return [[1.0, float(len(t))] for t in batch]

    columns = ["id", "raw_text", "category", "norm_text", "tokens", "attrs", "embedding"]
    found = resolve.enrich_stored(records, encoder).select(columns).orderBy("id").collect()
    assert len(seen.read_text().split()) == 5
    assert found == resolve.enrich(records, encoder).select(columns).orderBy("id").collect()
