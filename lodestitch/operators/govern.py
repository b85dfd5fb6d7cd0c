"""Checks before a new item is created, explained candidates, evidence, and reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.functions import rules as R
from lodestitch.functions.attributes import value_text
from lodestitch.operators.resolve import bag_classes, enrich_stored
from lodestitch.operators.nearest import TIES
from lodestitch.operators.retrieval import hybrid_candidates
from lodestitch.plans.materialize import stored

#: Pairs that one task scores.
TASK_PAIRS = 100_000
USE_EXISTING, CREATE_NEW, REVIEW = "USE_EXISTING", "CREATE_NEW", "REVIEW"


def _said(met: DataFrame, probes: DataFrame, listed: DataFrame) -> DataFrame:
    """x, y, category, w, agreement, v, comparisons of the pairs of classes (x, y) that met; ``probes``, ``listed``: the classes."""
    x = probes.select(F.col("class").alias("x"), "category", F.col("attrs").alias("pa"))
    y = listed.select(F.col("class").alias("y"), F.col("attrs").alias("ca"))
    # Comparing takes far longer than its bytes tell, so the pairs are dealt by row and not by size.
    joined = met.join(x, "x").join(y, "y").repartition(max(met.sparkSession.sparkContext.defaultParallelism, met.count() // TASK_PAIRS), "x", "y")
    attrs, category = (F.col("pa"), F.col("ca")), F.col("category")
    joined = joined.withColumn("comparisons", C.compare_prepared(*attrs, category, C.schema_keys(category, *attrs)))
    return joined.select(
        "x", "y", "category", C.component_weights(category).alias("w"), C.agreement(F.col("comparisons"), category)["agreement"].alias("agreement"),
        C.verdict_of(C.critical_of(F.col("comparisons"), *attrs, category), category).alias("v"), "comparisons",
    ).withColumn("v", F.struct("v.status", "v.reason"))


def _scored(probes: DataFrame, catalogue: DataFrame, crosswalk: DataFrame, k: int, same: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(Candidates of the probes among the catalogue with their entity, score and verdict, the rows of a probe in one task; what was ``_said``).

    Only what was found of the catalogue meets the pairs: it is picked out where it lies, since most of it was not. Bags are
    compared once for all pairs of a probe and a candidate of equal bags.
    """
    found = stored(hybrid_candidates(probes, catalogue, k, same))
    listed = stored(found.select(F.col("cand_id").alias("id")).distinct())
    p, probe_bags = bag_classes(probes)
    c, listed_bags = bag_classes(catalogue.join(listed, "id", "left_semi"))
    links = stored(crosswalk.select(F.col("record_id").alias("id"), "entity_id").join(listed, "id", "left_semi").withColumnRenamed("id", "cand_id"))
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, found.count() // TASK_PAIRS)
    pairs = found.join(c.toDF("cand_id", "y"), "cand_id").join(links, "cand_id", "left").join(p.toDF("query_id", "x"), "query_id")
    pairs = stored(pairs)
    said = stored(_said(stored(pairs.select("x", "y").distinct()), probe_bags, listed_bags))
    joined = pairs.join(said.drop("category", "comparisons"), ["x", "y"]).repartition(tasks, "query_id")
    score = C.weighed(F.col("w"), C.clipped(F.col("semantic")), C.clipped(F.col("lexical")), F.col("agreement"))
    return joined.withColumn("score", score).drop("w", "agreement"), said


def _place(score: Column) -> Column:
    """What scores are ordered by: equal to nine decimals is a tie, since sums differ in the last bits between runs."""
    return F.floor(score * TIES + 0.5)


def check_new_items(
    probes: DataFrame, catalogue: DataFrame, crosswalk: DataFrame, *, top_n: int = 5, merge_at: float = R.MERGE_AT, review_at: float = R.REVIEW_AT,
    same: str | None = None,
) -> DataFrame:
    """probe_id, rank, entity_id, record_id, score, verdict, recommendation; batch of descriptions.

    probes: id, raw_text, and category if known; ids must not occur in the catalogue. The best
    record speaks for its entity; the recommendation looks at rank 1 only. A probe of unknown
    category, or without candidates, still has one row. ``same``: a column of the catalogue as for ``cosine_top_k``.
    """
    enriched = enrich_stored(probes, same=same)
    found = _scored(enriched.where("category is not null"), catalogue, crosswalk, R.CANDIDATES, same)[0].where("entity_id is not null")
    best = found.groupBy("query_id", "entity_id").agg(
        F.max_by(F.struct("cand_id", "score", "v"), F.struct(_place(F.col("score")), -F.col("cand_id"))).alias("b")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(_place(F.col("b.score"))), "entity_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    rows = enriched.select(F.col("id").alias("probe_id"), "category").join(
        ranked.withColumnRenamed("query_id", "probe_id"), "probe_id", "left"
    )
    top = F.first(F.struct("b.score", "b.v.status"), ignorenulls=False).over(Window.partitionBy("probe_id").orderBy("rank"))
    score, status = top["score"], top["status"]
    advice = (
        F.when(F.col("category").isNull(), REVIEW)
        .when(score.isNull() | (score < review_at), CREATE_NEW)
        .when((score >= merge_at) & (status == C.PASS), USE_EXISTING)
        .when((score >= merge_at) & (status == C.BLOCK), CREATE_NEW)
        .otherwise(REVIEW)
    )
    return rows.select(
        "probe_id", "category", F.coalesce("rank", F.lit(0)).alias("rank"), "entity_id", F.col("b.cand_id").alias("record_id"),
        F.col("b.score").alias("score"), F.col("b.v.status").alias("verdict"), F.col("b.v.reason").alias("reason"),
        advice.alias("recommendation"),
    )


def ranked_candidates(
    asked: int | DataFrame, records: DataFrame, crosswalk: DataFrame, k: int = 10, merge_at: float = R.MERGE_AT, same: str | None = None
) -> DataFrame:
    """The k best candidates of every asked record: asked_id, rank, score, verdict, explanation, would_merge.

    ``asked``: one id, or a table of them (id). Depth is max(3 k, 30). ``same``: a column of the records as for ``cosine_top_k``.
    """
    if isinstance(asked, int):
        wanted = records.where(F.col("id") == asked)
    else:
        wanted = records.join(asked.select("id"), "id", "left_semi")
    found, said = _scored(stored(wanted), records, crosswalk, max(3 * k, 30), same)
    order = Window.partitionBy("query_id").orderBy(F.desc(_place(F.col("score"))), "cand_id")
    # Sorting runs what it sorts twice, first for a sample.
    ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    explained = said.select("x", "y", C.explanation(F.col("comparisons"), F.col("category")).alias("explanation"))
    return ranked.join(explained, ["x", "y"]).select(
        F.col("query_id").alias("asked_id"), "rank", F.col("cand_id").alias("record_id"), "entity_id", "score", "semantic", "lexical", "channel",
        F.col("v.status").alias("verdict"), "explanation", ((F.col("score") >= merge_at) & (F.col("v.status") == C.PASS)).alias("would_merge"),
    ).orderBy("asked_id", "rank")


def evidence_matrix(records: DataFrame, crosswalk: DataFrame, golden: DataFrame) -> DataFrame:
    """entity_id, key, golden_value, members: each member's value and whether it agrees with the golden one."""
    members = crosswalk.select("entity_id", F.col("record_id").alias("id")).join(records.select("id", "source_org", "category", "attrs"), "id")
    cells = members.select("entity_id", "id", "source_org", "category", "attrs", F.explode(C.schema_keys(F.col("category"))).alias("key"))
    best = golden.select("entity_id", F.explode("attrs").alias("key", "g")).select("entity_id", "key", value_text(F.col("g")).alias("golden_value"))
    joined = cells.join(best, ["entity_id", "key"], "left")
    value = value_text(F.try_element_at("attrs", F.col("key")))
    cell = F.struct(
        F.col("id").alias("record_id"), "source_org", value.alias("value"), (value == F.col("golden_value")).alias("agrees")
    )
    return joined.groupBy("entity_id", "key").agg(
        F.first("golden_value").alias("golden_value"), F.array_sort(F.collect_list(cell)).alias("members")
    )


# ---- decisions: an append-only log, and the state that follows from it ---------------------


def latest(log: DataFrame, key: str, at: str = "decided_at") -> DataFrame:
    """The last row per key; ties by the whole row."""
    row = F.struct(*[F.col(c) for c in log.columns if c not in (key, at)])
    last = log.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), row.alias("row"))).alias("last"))
    return last.select(key, F.col("last.at").alias(at), "last.row.*")


def invalid_decisions(decisions: DataFrame, review: DataFrame, entities: DataFrame) -> DataFrame:
    """Decisions that may not be taken, with the problem: unknown item, closed item, no such target, unknown verb."""
    known = review.select("record_id", F.col("status").alias("item_status"))
    targets = entities.select(F.col("entity_id").alias("target_entity"), F.lit(True).alias("exists"))
    joined = decisions.join(known, "record_id", "left").join(targets, "target_entity", "left")
    problem = (
        F.when(~F.col("decision").isin("APPROVE", "REJECT"), "unknown decision")
        .when(F.col("item_status").isNull(), "no such item")
        .when(F.col("item_status").isin("APPROVED", "REJECTED"), "item is closed")
        .when((F.col("decision") == "APPROVE") & F.col("exists").isNull(), "no such target entity")
    )
    return joined.withColumn("problem", problem).where("problem is not null").select(*decisions.columns, "problem")


def current_crosswalk(base: DataFrame, decisions: DataFrame) -> DataFrame:
    """The crosswalk after the latest approvals: record_id, entity_id and status of each link."""
    moves = latest(decisions, "record_id").where("decision = 'APPROVE'").select("record_id", "target_entity")
    joined = base.join(moves, "record_id", "left")
    return joined.select(
        *[
            F.coalesce("target_entity", "entity_id").alias(c) if c == "entity_id"
            else F.when(F.col("target_entity").isNotNull(), "REVIEWER_CONFIRMED").otherwise(F.col("status")).alias(c) if c == "status"
            else F.col(c)
            for c in base.columns
        ]
    )


def recounted_entities(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Entities with their member counts from the links; emptied ones are gone."""
    counts = links.groupBy("entity_id").agg(F.count("*").cast("int").alias("n"))
    return entities.join(counts, "entity_id").withColumn("member_count", F.col("n")).drop("n")


def review_after(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review rows with the status of their latest decision; one for an item that is gone is ignored."""
    done = latest(decisions, "record_id").select("record_id", "decision", "reviewer", "decided_at")
    status = F.when(F.col("decision") == "APPROVE", "APPROVED").when(F.col("decision") == "REJECT", "REJECTED").otherwise(F.col("status"))
    joined = review.join(done, "record_id", "left").withColumn("status", status)
    return joined.drop("decision")


def audit_rows(decisions: DataFrame, base: DataFrame) -> DataFrame:
    """One audit row per approval that moved a record: record_id, from_entity, to_entity, reviewer, decided_at."""
    moved = latest(decisions, "record_id").where("decision = 'APPROVE'").join(base.select("record_id", "entity_id"), "record_id")
    return moved.where("entity_id <> target_entity").select(
        "record_id", F.col("entity_id").alias("from_entity"), F.col("target_entity").alias("to_entity"), "reviewer", "decided_at"
    )


def valid_override(decision: Column, entity_id: Column, exists: Column) -> Column:
    """Whether a governance override may be logged: one of three verbs, and an existing entity where one is named or needed."""
    named = entity_id.isNotNull()
    return decision.isin(USE_EXISTING, CREATE_NEW, REVIEW) & (~named | exists) & ((decision != USE_EXISTING) | named)


def logged_overrides(requests: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append to the override log, refused requests with their problem, audit rows to append).

    requests: request_id, decision, entity_id, reviewer, decided_at; an entity must exist where one is named.
    """
    known = entities.select("entity_id", F.lit(True).alias("_exists")).distinct()
    joined = requests.join(known, "entity_id", "left").withColumn("_exists", F.coalesce("_exists", F.lit(False)))
    problem = (
        F.when(~F.coalesce(F.col("decision").isin(USE_EXISTING, CREATE_NEW, REVIEW), F.lit(False)), "unknown decision")
        .when((F.col("decision") == USE_EXISTING) & F.col("entity_id").isNull(), "an entity is needed")
        .when(~valid_override(F.col("decision"), F.col("entity_id"), F.col("_exists")), "no such entity")
    )
    checked = joined.withColumn("problem", problem)
    valid = checked.where("problem is null").select(*requests.columns)
    audit = valid.select(
        "request_id", F.concat(F.lit("override:"), "decision").alias("action"), "entity_id", F.col("reviewer").alias("actor"), F.col("decided_at").alias("at")
    )
    return valid, checked.where("problem is not null").select(*requests.columns, "problem"), audit


def available_quantities(inventory: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """entity_id, source_org, available: what every organisation holds of every entity."""
    held = inventory.join(crosswalk.select("record_id", "entity_id", "source_org"), "record_id")
    return held.groupBy("entity_id", "source_org").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("available"))


def available_quantity(inventory: DataFrame, crosswalk: DataFrame, entity_id: str, org: str) -> DataFrame:
    """One row, available: what an organisation holds of an entity; 0 without stock."""
    own = (F.col("entity_id") == entity_id) & (F.col("source_org") == org)
    return available_quantities(inventory, crosswalk.where(own)).agg(F.coalesce(F.sum("available"), F.lit(0)).alias("available"))


def checked_transfers(requests: DataFrame, entities: DataFrame, stock: DataFrame) -> DataFrame:
    """Transfer requests with a problem or null; stock: entity_id, source_org, available."""
    known = entities.select("entity_id", F.lit(True).alias("exists"))
    have = stock.select("entity_id", F.col("source_org").alias("from_org"), "available")
    joined = requests.join(known, "entity_id", "left").join(have, ["entity_id", "from_org"], "left")
    problem = (
        F.when(F.col("exists").isNull(), "no such entity")
        .when(F.coalesce("quantity", F.lit(0)) <= 0, "quantity must be positive")
        .when(F.col("from_org") == F.col("to_org"), "organisations must differ")
        .when(F.col("quantity") > F.coalesce("available", F.lit(0)), "not enough stock")
    )
    return joined.withColumn("problem", problem).select(*requests.columns, F.coalesce("available", F.lit(0)).alias("available"), "problem")
