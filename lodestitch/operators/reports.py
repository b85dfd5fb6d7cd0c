"""Read queries over records, crosswalk, entities, review rows, inventory and logs.

Every report is a lazy DataFrame over these tables:
records(id, source_org, local_code, raw_text, norm_text, category), crosswalk(entity_id, record_id,
match_score, relationship), entities(entity_id, description, category, member_count),
review(record_id, status, score, candidate_record, candidate_entity), inventory(record_id,
quantity, uom, unit_value). Sorts put nulls last and end with a key, so pages are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.operators.substring import GramIndex, contains_any, find_rows

STATUSES = ("BLOCKED", "INSUFFICIENT_EVIDENCE", "NEEDS_REVIEW", "AUTO_MATCHED", "APPROVED", "REJECTED")
OPEN = ("BLOCKED", "INSUFFICIENT_EVIDENCE", "NEEDS_REVIEW")


# ---- joins --------------------------------------------------------------------------------


def material_view(records: DataFrame, crosswalk: DataFrame, entities: DataFrame, review: DataFrame) -> DataFrame:
    """Records with their link, entity and review status, as far as they have them."""
    links = crosswalk.select(F.col("record_id").alias("id"), "entity_id", "match_score", "relationship")
    names = entities.select("entity_id", F.col("description").alias("entity_description"), "member_count")
    states = review.select(F.col("record_id").alias("id"), F.col("status").alias("review_status"), F.col("score").alias("review_score"))
    # What is joined by id first, so that records are shuffled by it once.
    view = records.join(links, "id", "left").join(states, "id", "left").join(names, "entity_id", "left")
    return view.select("id", *[c for c in view.columns if c != "id"])


#: What a search of the material view looks into.
SEARCHED = ("raw_text", "norm_text", "local_code", "entity_id")


def list_materials(
    view: DataFrame, *, search: str | None = None, org: str | None = None, category: str | None = None,
    status: str | None = None, sort: str = "id", descending: bool = False, limit: int = 50, offset: int = 0, grams: GramIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total) of the material view. ``grams``: trigrams of ``SEARCHED`` by id, for a search that does not scan."""
    rows = find_rows(view, grams, search) if grams else view.where(contains_any(search, *SEARCHED))
    for column, value in (("source_org", org.upper() if org else None), ("category", category), ("review_status", status)):
        if value:
            rows = rows.where(F.col(column) == value)
    if sort not in ("id", "source_org", "local_code", "category", "match_score", "entity_id"):
        raise ValueError(f"cannot sort by {sort}")
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, "id").offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))


def siblings(records: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """id, sibling_id: the other records of the same entity."""
    a = crosswalk.select("entity_id", F.col("record_id").alias("id"))
    b = crosswalk.select("entity_id", F.col("record_id").alias("sibling_id"))
    pairs = a.join(b, "entity_id").where("id <> sibling_id")
    return pairs.join(records.select(F.col("id").alias("sibling_id"), "source_org", "local_code"), "sibling_id")


def sibling_numbers(crosswalk: DataFrame) -> DataFrame:
    """id, siblings: how many other records of the same entity there are, from the sizes of entities; records without any are left out."""
    sizes = crosswalk.where("entity_id is not null").groupBy("entity_id").agg((F.count("*") - 1).alias("siblings")).where("siblings > 0")
    return crosswalk.select("entity_id", F.col("record_id").alias("id")).join(sizes, "entity_id").select("id", "siblings")


def entity_members(records: DataFrame, crosswalk: DataFrame, review: DataFrame) -> DataFrame:
    """The records of every entity with their status."""
    return (
        crosswalk.select("entity_id", F.col("record_id").alias("id"), "match_score", "relationship")
        .join(records.select("id", "source_org", "local_code", "raw_text"), "id")
        .join(review.select(F.col("record_id").alias("id"), F.col("status").alias("review_status")), "id", "left")
    )


def list_entities(
    entities: DataFrame, members: DataFrame, search: str | None = None, category: str | None = None, grams: GramIndex | None = None
) -> DataFrame:
    """Entities with how many organisations use them; members: entity_id, source_org.

    ``grams``: trigrams of entity_id and description by entity_id, for a search that does not scan.
    """
    rows = find_rows(entities, grams, search, "entity_id") if grams else entities.where(contains_any(search, "entity_id", "description"))
    rows = rows.where(F.col("category") == category) if category else rows
    orgs = members.groupBy("entity_id").agg(F.count_distinct("source_org").alias("orgs"))
    return rows.join(orgs, "entity_id", "left").withColumn("orgs", F.coalesce("orgs", F.lit(0)))


def shared_entities(members: DataFrame) -> DataFrame:
    """source_org, entity_id, other_orgs: entities that other organisations use too."""
    pairs = members.select("entity_id", "source_org").distinct()
    other = pairs.select("entity_id", F.col("source_org").alias("other_org"))
    return (
        pairs.join(other, "entity_id")
        .where("source_org <> other_org")
        .groupBy("source_org", "entity_id")
        .agg(F.array_sort(F.collect_set("other_org")).alias("other_orgs"))
    )


def org_overlap(members: DataFrame) -> DataFrame:
    """org_a, org_b, entities: how many entities two organisations share."""
    one = members.select("entity_id", F.col("source_org").alias("org_a")).distinct()
    two = members.select("entity_id", F.col("source_org").alias("org_b")).distinct()
    return one.join(two, "entity_id").where("org_a < org_b").groupBy("org_a", "org_b").agg(F.count("*").alias("entities"))


def surplus(members: DataFrame, inventory: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities held by more than one organisation: stock, value, lowest and mean price, holders."""
    held = members.select("entity_id", F.col("id").alias("record_id"), "source_org", "local_code").join(inventory, "record_id")
    holder = F.struct((-F.col("quantity")).alias("minus"), "local_code", "source_org", "quantity", "unit_value")
    grouped = held.groupBy("entity_id").agg(
        F.count_distinct("source_org").alias("orgs"),
        F.sum("quantity").alias("quantity"),
        F.sum(F.col("quantity") * F.col("unit_value")).alias("value"),
        F.min("unit_value").alias("lowest_price"),
        F.avg("unit_value").alias("mean_price"),
        F.array_sort(F.collect_list(holder)).alias("ordered"),
    )
    holders = F.transform("ordered", lambda h: F.struct(h["source_org"].alias("source_org"), h["local_code"].alias("local_code"), h["quantity"].alias("quantity"), h["unit_value"].alias("unit_value")))
    return grouped.where("orgs > 1").join(entities.select("entity_id", "description"), "entity_id").withColumn("holders", holders).drop("ordered")


def review_list(review: DataFrame, records: DataFrame, entities: DataFrame, status: str | None = None, org: str | None = None) -> DataFrame:
    """Review rows with record and candidate entity: open ones first, by status rank, then score."""
    rows = review.join(records.select(F.col("id").alias("record_id"), "source_org", "local_code", "raw_text"), "record_id")
    rows = rows.join(entities.select(F.col("entity_id").alias("candidate_entity"), F.col("description").alias("entity_description")), "candidate_entity", "left")
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("source_org") == org.upper()) if org else rows
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rows.withColumn("rank", rank).orderBy("rank", F.desc_nulls_last("score"), "record_id")


def review_counts(review: DataFrame) -> DataFrame:
    """status, records: every status, zero where there is none."""
    all_ = review.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    have = review.groupBy("status").agg(F.count("*").alias("records"))
    return all_.join(have, "status", "left").fillna(0, ["records"])


def records_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose id is in a list; repeated and unknown ids do no harm. ids: id."""
    return records.join(ids.select("id"), "id", "left_semi")


def review_detail(review: DataFrame, records: DataFrame) -> DataFrame:
    """Review rows with their record, the record that they were compared with, and the comparison as it is now.

    comparisons, states (counts), verdict and reason are null where one of the two is missing.
    """
    own = records.select(F.col("id").alias("record_id"), F.col("raw_text").alias("text"), F.col("attrs").alias("attrs"), "category")
    other = records.select(F.col("id").alias("candidate_record"), F.col("raw_text").alias("candidate_text"), F.col("attrs").alias("candidate_attrs"))
    joined = review.join(own, "record_id", "left").join(other, "candidate_record", "left")
    both = F.col("attrs").isNotNull() & F.col("candidate_attrs").isNotNull()
    sides = F.col("attrs"), F.col("candidate_attrs")
    compared = C.compare_bags(*sides, F.col("category"), C.schema_keys(F.col("category"), *sides))
    joined = joined.withColumn("comparisons", F.when(both, compared)).withColumn("_v", F.when(both, C.safety_verdict(*sides, F.col("category"))))
    states = F.when(both, C.state_counts(F.col("comparisons")))
    return joined.withColumns({"states": states, "verdict": F.col("_v.status"), "reason_now": F.col("_v.reason")}).drop("_v")


def decision_log(decisions: DataFrame, records: DataFrame, limit: int = 100) -> DataFrame:
    named = decisions.join(records.select(F.col("id").alias("record_id"), "source_org", "local_code"), "record_id", "left")
    return named.orderBy(F.desc_nulls_last("decided_at"), "record_id").limit(limit)


def block_list(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Blocked pairs with both records; those that carry the records' columns already are left as they are."""
    if {"a_org", "a_code", "b_org", "b_code"} <= set(blocks.columns):
        return blocks
    side = lambda p: records.select(F.col("id").alias(p), F.col("source_org").alias(f"{p}_org"), F.col("local_code").alias(f"{p}_code"))
    return blocks.join(side("a"), "a").join(side("b"), "b")


def labelled_records(records: DataFrame, truth: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """id, category, truth, predicted: for the evaluation. truth: id, truth."""
    links = crosswalk.select(F.col("record_id").alias("id"), F.col("entity_id").alias("predicted"))
    return records.select("id", "category").join(truth, "id").join(links, "id", "left")


def transfers_view(transfers: DataFrame, entities: DataFrame) -> DataFrame:
    return transfers.join(entities.select("entity_id", "description"), "entity_id", "left")


# ---- aggregates ---------------------------------------------------------------------------


def dashboard_totals(records: DataFrame, entities: DataFrame, review: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row of totals; each table is aggregated once."""
    r = records.agg(F.count("*").alias("records"), F.count_distinct("source_org").alias("orgs"))
    e = entities.agg(
        F.count("*").alias("entities"), F.coalesce(F.sum(F.col("member_count") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("member_count") > 1).alias("merged_entities"),
    )
    v = review.agg(F.count_if(F.col("status").isin(*OPEN)).alias("open_reviews"), F.count_if(F.col("status") == "APPROVED").alias("approved"))
    b = blocks.agg(F.count("*").alias("blocks"))
    cells = [df.select(c).scalar().alias(c) for df in (r, e, v, b) for c in df.columns]
    return records.sparkSession.range(1).select(*cells)


def category_breakdown(view: DataFrame) -> DataFrame:
    """category, records, entities, consolidated."""
    rows = view.groupBy("category").agg(F.count("*").alias("records"), F.count_distinct("entity_id").alias("entities"))
    return rows.withColumn("consolidated", F.col("records") - F.col("entities"))


def org_overview(view: DataFrame) -> DataFrame:
    """Per organisation: records, entities, matched, open and mean link score."""
    return view.groupBy("source_org").agg(
        F.count("*").alias("records"),
        F.count_distinct("entity_id").alias("entities"),
        F.count_if(F.col("review_status") == "AUTO_MATCHED").alias("matched"),
        F.count_if(F.col("review_status").isin(*OPEN)).alias("open"),
        F.avg("match_score").alias("mean_score"),
    )


def recent(records: DataFrame, at: str, key: str, n: int = 12) -> DataFrame:
    """The newest rows."""
    return records.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(n)


def confidence_histogram(scores: DataFrame, column: str = "match_score", buckets: int = 10) -> DataFrame:
    """bucket, n: tenths of 0..1; exactly 1 falls into the bucket after the last."""
    bucket = F.width_bucket(F.col(column), F.lit(0.0), F.lit(1.0), F.lit(buckets)).cast("int")
    return scores.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def confidence_bands(scores: DataFrame, column: str = "match_score") -> DataFrame:
    """band, n: 0.90 and above, 0.75 to 0.90, 0.60 to 0.75, below 0.60; sorted by the band's text, last first."""
    c = F.col(column)
    band = F.when(c >= 0.9, "0.90 - 1.00").when(c >= 0.75, "0.75 - 0.90").when(c >= 0.6, "0.60 - 0.75").otherwise("below 0.60")
    return scores.groupBy(band.alias("band")).agg(F.count("*").alias("n")).orderBy(F.desc("band"))


def blocked_fields(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("blocked_field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "blocked_field")


def last_per(log: DataFrame, at: str) -> DataFrame:
    """The newest row of a log."""
    return log.orderBy(F.desc_nulls_last(at)).limit(1)


def duplicates(members: DataFrame, limit: int = 25) -> DataFrame:
    """The entities with the most records from the most organisations."""
    rows = members.groupBy("entity_id").agg(
        F.count("*").alias("records"), F.count_distinct("source_org").alias("n_orgs"), F.array_sort(F.collect_set("source_org")).alias("orgs")
    )
    return rows.where("records > 1").orderBy(F.desc("records"), F.desc("n_orgs"), "entity_id").limit(limit)


def inventory_by_org(members: DataFrame, inventory: DataFrame) -> DataFrame:
    """entity_id, source_org, quantity, lowest_price, mean_price."""
    held = members.select("entity_id", F.col("id").alias("record_id"), "source_org").join(inventory, "record_id")
    return held.groupBy("entity_id", "source_org").agg(
        F.sum("quantity").alias("quantity"), F.min("unit_value").alias("lowest_price"), F.avg("unit_value").alias("mean_price")
    )


def category_list(records: DataFrame) -> DataFrame:
    """Every known category with its records, zero where there is none."""
    from lodestitch.functions import rules as R

    all_ = records.sparkSession.createDataFrame(list(R.CATEGORY_LABELS.items()), "category string, label string")
    have = records.groupBy(F.coalesce("category", F.lit(R.UNKNOWN)).alias("category")).agg(F.count("*").alias("records"))
    return all_.join(have, "category", "left").fillna(0, ["records"])


def newest(log: DataFrame, at: str, key: str, limit: int = 50) -> DataFrame:
    """Log readers: jobs, audit, overrides, evaluations."""
    return log.orderBy(F.desc_nulls_last(at), key).limit(limit)
