"""From records to entities: pairs, routes, clusters, golden records, crosswalk, review rows.

Everything is a lazy DataFrame until the plan is published; the only loop is the one of the
connected components.

records: id long, source_org, local_code, raw_text, category, norm_text, tokens, attrs, embedding.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.functions import rules as R
from lodestitch.functions.attributes import extract_attributes, value_text
from lodestitch.functions.text import detect_category, is_known, normalize, rule_trace, tokenize
from lodestitch.operators.blocks import Blocks, class_pairs, pairs_of, redealt
from lodestitch.operators.graph import connected_components, extend_components
from lodestitch.operators.retrieval import embed, hybrid_candidates
from lodestitch.plans.materialize import materialize, stored
from lodestitch.plans.numbering import row_numbers

EDGE, BLOCKED, REVIEW, DROP = "edge", "blocked", "review", "drop"
AUTO_MATCHED, NEEDS_REVIEW, INSUFFICIENT = "AUTO_MATCHED", "NEEDS_REVIEW", "INSUFFICIENT_EVIDENCE"


def enrich(records: DataFrame, encoder=None) -> DataFrame:
    """Records with category (given, else detected; unknown is null), norm_text, tokens, attrs, embedding."""
    found = detect_category(F.col("raw_text"))
    given = F.col("category") if "category" in records.columns else F.lit(None).cast("string")
    category = F.coalesce(F.when(is_known(given), given), F.when(is_known(found), found))
    out = records.withColumn("category", category)
    out = out.withColumn("norm_text", normalize(F.col("raw_text"), F.col("category")))
    out = out.withColumn("tokens", tokenize(F.col("norm_text")))
    out = out.withColumn("attrs", extract_attributes(F.col("norm_text"), F.col("category")))
    return embed(out, "norm_text", encoder)


#: Texts whose attributes and vectors are sent to the records instead of being stored with each of them; the same for what is said of pairs of bags.
FEW_TEXTS = 8192
#: Pairs of bags that one task compares.
TASK_PAIRS = 100_000


def enrich_stored(records: DataFrame, encoder=None, same: str | None = None) -> DataFrame:
    """``enrich``, computed once and stored; a text that several records have is read once for all of them.

    Of few texts (counted) a record is stored with the number of its text, and what was read comes to it where it is asked for.
    ``same``: a column to keep that number in.
    """
    given = F.col("category") if "category" in records.columns else F.lit(None).cast("string")
    asked = records.withColumns({"_text": F.col("raw_text"), "_given": given}).drop("category")
    texts = asked.select("_text", "_given").distinct().repartition(records.sparkSession.sparkContext.defaultParallelism)
    read = enrich(texts.withColumns({"raw_text": F.col("_text"), "category": F.col("_given")}), encoder).drop("raw_text")
    read = stored(read.withColumn("_same", F.monotonically_increasing_id()))
    # Renamed, the columns of both sides are told apart.
    names = read.select(F.col("_text").alias("_text_read"), F.col("_given").alias("_given_read"), "_same")
    equal = F.col("_text").eqNullSafe(F.col("_text_read")) & F.col("_given").eqNullSafe(F.col("_given_read"))
    facts = read.drop("_text", "_given")
    few = read.count() <= FEW_TEXTS
    rows = asked.join(F.broadcast(names) if few else names, equal).drop("_text", "_given", "_text_read", "_given_read")
    # Many are shuffled: vectors are mostly zeros, so what lies in a small file may be far too much to be sent.
    out = stored(rows).join(F.broadcast(facts), "_same") if few else stored(rows.join(facts.hint("merge"), "_same"))
    return out.withColumnRenamed("_same", same) if same else out.drop("_same")


# ---- pairs --------------------------------------------------------------------------------


def once_per_pair(candidates: DataFrame) -> DataFrame:
    """a, b, semantic, lexical, channel with a < b: of the two directions the one that the lower id asked."""
    a, b = F.least("query_id", "cand_id"), F.greatest("query_id", "cand_id")
    best = F.min_by(F.struct("semantic", "lexical", "channel"), F.col("query_id"))
    return candidates.groupBy(a.alias("a"), b.alias("b")).agg(best.alias("s")).select("a", "b", "s.*")


def bag_classes(records: DataFrame, same: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, class: every record; class, category, attrs (prepared): the first record of each class of equal category and bag).

    ``same``: a column, if there is one, in which only records of one category and bag are equal; a bag is read once for each of its values.
    """
    bag = F.array_sort(F.map_entries("attrs")).alias("bag")
    if same is not None:
        named = stored(records.select("id", F.col(same).alias("same")))
        firsts = stored(named.groupBy("same").agg(F.min("id").alias("id")))
        records = records.join(firsts.select("id"), "id", "left_semi")
    rows = stored(records.select("id", "category", bag))
    found = stored(rows.groupBy("category", "bag").agg(F.min("id").alias("class")))
    # Renamed, the columns of both sides are told apart.
    known = found.toDF("_category", "_bag", "class")
    equal = F.col("category").eqNullSafe(F.col("_category")) & F.col("bag").eqNullSafe(F.col("_bag"))
    members = stored(rows.join(known, equal).select("id", "class"))
    if same is not None:
        members = stored(named.join(firsts.join(members, "id").select("same", "class"), "same").select("id", "class"))
    return members, found.select("class", "category", C.prepared(F.map_from_entries("bag")).alias("attrs"))


def _said(met: DataFrame, weights: dict | None = None) -> DataFrame:
    """What is said of pairs of classes that met: x, y, category (of x), a_attrs, b_attrs (prepared)."""
    attrs, category = (F.col("a_attrs"), F.col("b_attrs")), F.col("category")
    said = met.withColumn("comparisons", C.compare_prepared(*attrs, category, C.schema_keys(category, *attrs)))
    said = said.select(
        "x", "y", "category", "comparisons", C.component_weights(category, weights).alias("w"),
        C.agreement(F.col("comparisons"), category, weights).alias("g"),
        C.verdict_of(C.critical_of(F.col("comparisons"), *attrs, category), category).alias("v"),
    ).select(
        "x", "y", "category", "w", "g.agreement", "g.coverage", F.col("v.status").alias("verdict"), "v.blocked_field", "v.blocked_a", "v.blocked_b",
        "v.unknown_fields", "v.reason", "comparisons",
    )
    return stored(said)


def with_score(pairs: DataFrame, semantic: Column, lexical: Column) -> DataFrame:
    """Pairs of which all is ``_said`` with both channels and the score."""
    pairs = pairs.withColumns({"semantic": C.clipped(semantic), "lexical": C.clipped(lexical)})
    return pairs.withColumn("score", C.weighed(F.col("w"), F.col("semantic"), F.col("lexical"), F.col("agreement"))).drop("w")


def score_pairs(records: DataFrame, candidates: DataFrame, weights: dict | None = None, same: str | None = None) -> DataFrame:
    """a, b, category, the parts of the score, and the safety verdict, oriented from a to b; stored.

    Bags are compared once for all pairs of equal bags. A pair is stored with the classes of its bags; what was said of few pairs of
    classes (counted) comes to it where it is read. ``same``: as for ``bag_classes``.
    """
    known, bags = bag_classes(records, same)
    pairs = stored(once_per_pair(candidates).join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b"))
    met = stored(pairs.select("x", "y").distinct())
    one = bags.select(F.col("class").alias("x"), "category", F.col("attrs").alias("a_attrs"))
    two = bags.select(F.col("class").alias("y"), F.col("attrs").alias("b_attrs"))
    # Comparing takes far longer than its bytes tell, so the pairs are dealt by row and not by size.
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, met.count() // TASK_PAIRS)
    said = _said(met.join(one, "x").join(two, "y").repartition(tasks, "x", "y"), weights)
    few = said.count() <= FEW_TEXTS
    joined = pairs.join(F.broadcast(said) if few else said.hint("merge"), ["x", "y"])
    scored = with_score(joined, F.col("semantic"), F.col("lexical")).select(
        "a", "b", "category", "channel", "semantic", "lexical", "agreement", "coverage", "score", "verdict", "blocked_field", "blocked_a", "blocked_b",
        "unknown_fields", "reason", "comparisons",
    )
    return scored if few else stored(scored)


def said_of_blocks(blocks: Blocks, weights: dict | None = None) -> DataFrame:
    """What is said of the classes that meet in a block, in both orders."""
    return _said(class_pairs(blocks), weights)


def score_blocks(
    blocks: Blocks, semantic: Column, lexical: Column, weights: dict | None = None, *, of_class: Sequence[str] = (), of_record: Sequence[str] = ()
) -> DataFrame:
    """As ``score_pairs``, of all pairs of records of a block; ``semantic`` and ``lexical`` are columns of a and b.

    Attributes and the gate are compared once per pair of classes of equal bags. ``of_class``, ``of_record``: columns to come along as a_... and b_...
    """
    return with_score(pairs_of(blocks, said_of_blocks(blocks, weights), of_class, of_record), semantic, lexical)


def route(score: Column, verdict: Column, gate: bool = True, merge_at: float = R.MERGE_AT, review_at: float = R.REVIEW_AT) -> Column:
    """Where a pair goes."""
    if not gate:
        return F.when(score >= merge_at, EDGE).when(score >= review_at, REVIEW).otherwise(DROP)
    high = score >= merge_at
    return (
        F.when(high & (verdict == C.PASS), EDGE)
        .when(high & (verdict == C.BLOCK), BLOCKED)
        .when(high | (score >= review_at), REVIEW)
        .otherwise(DROP)
    )


# ---- clusters -----------------------------------------------------------------------------


def components(records: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component for every record; one without an edge is alone."""
    found = connected_components(edges, "a", "b").select(F.col("node").alias("id"), "component")
    return records.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def signature(attrs: Column, fields: Column) -> Column:
    """The critical values of a record as one text; null if one of them is not stated."""
    values = F.transform(fields, lambda k: value_text(F.try_element_at(attrs, k)))
    return F.when(~F.exists(values, lambda v: v.isNull()), F.array_join(values, "\u0001"))


def split_clusters(records: DataFrame, members: DataFrame, gate: bool = True) -> DataFrame:
    """id, component, cluster, signature, proposal: components cut where critical values differ.

    The fields of a component are the critical ones of its category; a conditional one counts
    when any member is of its kinds. Complete members with equal values stay together; an
    incomplete one is a cluster of its own, with the largest group as a proposal. The cluster
    is named by its smallest member.
    """
    joined = members.join(records.select("id", "category", "attrs"), "id")
    sizes = members.groupBy("component").agg(F.count("*").alias("members"))
    kind = C.canonical(F.try_element_at("attrs", F.lit("item_type")))
    bound = joined.groupBy("component").agg(
        *[F.max(F.coalesce(kind.isin(*kinds), F.lit(False))).alias(f"has_{key}") for key, kinds in R.CONDITIONAL.items()]
    )
    joined = joined.join(sizes, "component").join(bound, "component")
    counts = lambda k: ~F.exists(F.array(*[F.struct(F.lit(key).alias("k"), F.col(f"has_{key}").alias("h")) for key in R.CONDITIONAL]), lambda c: (c["k"] == k) & ~c["h"])
    fields = F.filter(C.critical_fields(F.col("category")), counts)
    cut = F.lit(gate) & (F.col("members") > 1)
    mark = F.when(~cut, F.lit("")).otherwise(signature(F.col("attrs"), fields))
    marked = joined.select("id", "component", mark.alias("signature"))
    groups = marked.where("signature is not null").groupBy("component", "signature").agg(
        F.min("id").alias("cluster"), F.count("*").alias("size")
    )
    largest = groups.groupBy("component").agg(F.max_by("cluster", F.struct("size", -F.col("cluster"))).alias("largest"))
    return (
        marked.join(groups.select("component", "signature", "cluster"), ["component", "signature"], "left")
        .join(largest, "component", "left")
        .select(
            "id",
            "component",
            F.coalesce("cluster", "id").alias("cluster"),
            "signature",
            F.when(F.col("signature").isNull(), F.col("largest")).alias("proposal"),
        )
    )


def contradictions(records: DataFrame, members: DataFrame) -> DataFrame:
    """component, field, values: critical fields that have several values in a component."""
    joined = members.join(records.select("id", "category", "attrs"), "id")
    stated = joined.select("component", F.explode(C.critical_fields(F.col("category"))).alias("field"), "attrs").select(
        "component", "field", C.canonical(F.try_element_at("attrs", F.col("field"))).alias("value")
    )
    values = stated.where("value is not null").groupBy("component", "field").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return values.where(F.size("values") > 1)


def number_entities(records: DataFrame, clusters: DataFrame, prefix: str = "ENT") -> DataFrame:
    """cluster, category, members, entity_id: numbered by category rank, then smallest member."""
    rank = C.by_category(F.col("category"), {c: F.lit(i) for i, c in enumerate(R.CATEGORIES)}, F.lit(len(R.CATEGORIES)))
    groups = (
        clusters.join(records.select("id", "category"), "id")
        .groupBy("cluster")
        .agg(F.min("category").alias("category"), F.count("*").cast("int").alias("members"))
    )
    numbered = row_numbers(groups, rank, F.col("cluster"))
    name = F.concat(F.lit(f"{prefix}-"), F.format_string("%06d", "number"))
    return numbered.select("cluster", "category", "members", name.alias("entity_id"))


# ---- golden records -----------------------------------------------------------------------


def survive(records: DataFrame, entity_of: DataFrame) -> DataFrame:
    """entity_id, key and the winning value with confidence, agreement, sources and contested values.

    ``entity_of``: id, entity_id. Most votes win, then the higher total confidence, then the text.
    """
    votes = (
        entity_of.join(records.select("id", "category", "attrs"), "id")
        .select("entity_id", "id", "category", F.explode("attrs").alias("key", "v"))
        .withColumn("canon", value_text(F.col("v")))
        .where("canon is not null")
    )
    keys = C.schema_keys(F.col("category"))
    votes = votes.where((F.size(keys) == 0) | F.array_contains(keys, F.col("key")))
    # Exact sums: doubles added in another order differ in the last bits, which would decide between equal votes.
    total = F.sum(F.col("v.confidence").cast("decimal(18,12)"))
    by_value = votes.groupBy("entity_id", "key", "canon").agg(
        F.count("*").alias("n"),
        total.alias("total"),
        (total.cast("double") / F.count("v.confidence")).alias("mean"),
        F.min_by(F.struct("v.value_str", "v.value_num"), F.col("id")).alias("first"),
        F.array_sort(F.collect_list("id")).alias("ids"),
    )
    by_key = by_value.groupBy("entity_id", "key").agg(
        F.max(F.struct("n", "total", "canon", "mean", "first", "ids")).alias("w"),
        F.sum("n").alias("all"),
        F.array_sort(F.collect_set("canon")).alias("values"),
    )
    ratio = F.col("w.n") / F.col("all")
    four = lambda x: F.floor(x * 10000 + 0.5) / 10000
    return by_key.select(
        "entity_id",
        "key",
        F.col("w.first.value_str").alias("value_str"),
        F.col("w.first.value_num").alias("value_num"),
        F.col("w.canon").alias("canon"),
        four(F.col("w.mean") * (0.6 + 0.4 * ratio)).alias("confidence"),
        F.concat_ws("/", F.col("w.n").cast("string"), F.col("all").cast("string")).alias("agreement"),
        four(ratio).alias("agreement_ratio"),
        F.col("w.ids").alias("source_record_ids"),
        F.nullif(F.array_except("values", F.array("w.canon")), F.array().cast("array<string>")).alias("contested"),
    )


def description(values: Column, category: Column) -> Column:
    """The surviving values in the category's order with their units; ``values``: map of key to text."""
    suffix = F.create_map(*[F.lit(x) for pair in R.DESCRIPTION_SUFFIX.items() for x in pair])
    order = C.by_category(category, {c: F.array(*map(F.lit, k)) for c, k in R.DESCRIPTION_KEYS.items()}, F.array_sort(F.map_keys(values)))
    parts = F.transform(order, lambda k: F.concat(F.try_element_at(values, k), F.coalesce(suffix[k], F.lit(""))))
    text = F.array_join(parts, ", ")
    return F.when(F.coalesce(text, F.lit("")) == "", R.NO_DESCRIPTION).otherwise(text)


def golden_records(survived: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, version, description, category_code, category, member_count, attrs."""
    value = F.struct(
        "value_str", "value_num", "confidence", "agreement", "agreement_ratio", "source_record_ids", "contested"
    )
    bags = survived.groupBy("entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("key"), value.alias("value"))))).alias("attrs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.col("canon"))))).alias("texts"),
    )
    code = F.create_map(*[F.lit(x) for pair in R.CATEGORY_CODES.items() for x in pair])[F.col("category")]
    text = F.when(F.col("texts").isNull(), R.NO_DESCRIPTION).otherwise(description(F.col("texts"), F.col("category")))
    return entities.join(bags, "entity_id", "left").select(
        "entity_id", F.lit(1).alias("version"), text.alias("description"), code.alias("category_code"), "category",
        F.col("members").alias("member_count"), "attrs",
    )


# ---- crosswalk and review -----------------------------------------------------------------


def per_record(pairs: DataFrame) -> DataFrame:
    """Every pair from the view of both its records: id, other, and the pair's columns."""
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    one = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), *keep)
    return one.unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), *keep))


def best_inside(pairs: DataFrame, entity_of: DataFrame) -> DataFrame:
    """id, best: the best score to another record of the same entity, over all scored pairs."""
    own = lambda side: entity_of.select(F.col("id").alias(side), F.col("entity_id").alias(f"{side}_of"))
    inside = pairs.select("a", "b", "score").join(own("a"), "a").join(own("b"), "b").where("a_of = b_of")
    return inside.select(F.explode(F.array("a", "b")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("best"))


#: Of which pairs a record has a leading one.
INSIDE, STOPPED, NEAR = "inside", "stopped", "near"


def _same_both_ways(said: DataFrame) -> bool:
    """Whether of two classes the same is said in both orders, as far as scores and routes go."""
    looked_at = ["w", "agreement", "verdict"]
    other = said.select(F.col("x").alias("y"), F.col("y").alias("x"), F.struct(*looked_at).alias("back"))
    return said.join(other, ["x", "y"]).where(~F.struct(*looked_at).eqNullSafe(F.col("back"))).isEmpty()


def _leaders(blocks: Blocks, keys: Sequence[str], said: DataFrame, rated: Callable[[DataFrame], DataFrame], kinds: dict[str, Column], alike: Sequence[str]) -> DataFrame:
    """id, other: for each record and each of ``kinds`` the other record of its best pair in a block of ``keys``, the smallest of equal scores.

    Records of a block that are equal in class and ``alike`` are a group. All that holds of a pair of groups holds of their records, so pairs of groups
    are made, named by their least records; a group with itself is the pair of its two least ones.
    """
    names, of_group = list(kinds), list(dict.fromkeys([*keys, "class", *alike]))
    marked = lambda pairs: rated(pairs).select("*", *[F.when(is_kind, F.col("score")).alias(f"{k}_score") for k, is_kind in kinds.items()])
    nth = F.row_number().over(Window.partitionBy(*of_group).orderBy("id"))
    heads = blocks.members.select(F.col("id").alias("_id"), *of_group, nth.alias("nth")).where("nth <= 2")
    groups = stored(heads.groupBy(*of_group).agg(F.min("_id").alias("least"), F.max("_id").alias("next")))
    own = groups.where("least < next").select(F.col("least").alias("a"), F.col("next").alias("b"), F.col("class").alias("x"), F.col("class").alias("y"))
    own = stored(marked(own.join(said, ["x", "y"])).select(F.col("a").alias("id"), *[F.col(f"{k}_score").alias(k) for k in names]))
    met = redealt(blocks, groups.select(*keys, "class", F.col("least").alias("id")), keys)
    # The best score of each kind first, then the least of those that have it: only numbers are added up, and the pairs are made anew.
    scores = F.struct(*[F.col(f"{k}_score").alias(k) for k in names])
    sides = marked(pairs_of(met, said)).select(F.explode(F.array(*[F.struct(F.col(s).alias("id"), scores.alias("s")) for s in "ab"])).alias("e"))
    best = sides.select("e.id", "e.s.*").unionByName(own).groupBy("id").agg(*[F.max(k).alias(k) for k in names])
    best = stored(best)
    pairs = marked(pairs_of(replace(met, members=stored(met.members.join(best, "id", "left"))), said, of_record=names))
    top = lambda side, other: F.struct(F.col(side).alias("id"), *[F.when(F.col(f"{k}_score") >= F.col(f"{side}_{k}"), F.col(other)).alias(k) for k in names])
    # A filter before the explode would work out the score anew for each comparison in it.
    ties = pairs.select(F.explode(F.array(top("a", "b"), top("b", "a"))).alias("e")).select("e.*").where(F.coalesce(*names).isNotNull())
    chosen = ties.groupBy("id").agg(*[F.min(k).alias(k) for k in names])
    inner = own.join(best.toDF("id", *[f"{k}_best" for k in names]), "id").select("id", *[(F.col(k) >= F.col(f"{k}_best")).alias(f"{k}_own") for k in names])
    led = groups.join(chosen.withColumnRenamed("id", "least"), "least", "left").join(inner.withColumnRenamed("id", "least"), "least", "left")
    records = blocks.members.select(F.col("id").alias("_id"), *of_group)
    equal = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in of_group])
    records = records.join(stored(led).withColumnsRenamed({c: f"_{c}_" for c in of_group}), equal)
    partner = F.when(F.col("_id") == F.col("least"), F.col("next")).otherwise(F.col("least"))
    others = [F.least(k, F.when(F.col(f"{k}_own"), partner)) for k in names]
    return records.select(F.col("_id").alias("id"), F.explode(F.array_distinct(F.array(*others))).alias("other")).where("other is not null")


def leading_pairs(blocks: Blocks, rated: Callable[[DataFrame], DataFrame], alike: Sequence[str] | None = None) -> DataFrame:
    """Of all pairs of blocks those that the crosswalk and the review rows of a record come from, three a record at most.

    They are the best one inside its entity, the best blocked one and the best one for review; of equal scores the one with the smallest other id.
    The members have an entity_id. ``rated``: adds score and route to pairs (a, b) of which all is said. ``alike``: columns of the members such that
    scores look at nothing else of a record but these and its bag; where there are such, groups of like records meet instead of records, so pairs
    grow as the square of the groups of a block and not of its records. They serve if what is said of two bags is the same in both orders (checked).
    """
    said = said_of_blocks(blocks)
    alike = ["id"] if alike is None or not _same_both_ways(said) else list(alike)
    routes = {STOPPED: F.col("route") == BLOCKED, NEAR: F.col("route") == REVIEW}
    few = said.drop("comparisons", "unknown_fields")
    found = _leaders(blocks, blocks.keys, few, rated, routes, alike)
    found = found.unionByName(_leaders(blocks, [*blocks.keys, "entity_id"], few, rated, {INSIDE: F.lit(True)}, alike))
    pairs = found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    class_of = blocks.members.select("id", "class")
    pairs = pairs.join(class_of.toDF("a", "x"), "a").join(class_of.toDF("b", "y"), "b").join(said, ["x", "y"])
    return stored(rated(pairs).drop("x", "y", "w"))


def crosswalk(records: DataFrame, entity_of: DataFrame, pairs: DataFrame) -> DataFrame:
    """entity_id, record_id, source_org, local_code, match_score, relationship, status."""
    size = entity_of.groupBy("entity_id").agg(F.count("*").alias("size"))
    joined = entity_of.join(size, "entity_id").join(best_inside(pairs, entity_of), "id", "left").join(
        records.select("id", "source_org", "local_code"), "id"
    )
    score = F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "entity_id", F.col("id").alias("record_id"), "source_org", "local_code",
        (F.floor(score * 10000 + 0.5) / 10000).alias("match_score"),
        F.when(F.col("size") == 1, "SINGLETON").otherwise("EXACT").alias("relationship"),
        F.lit("ACTIVE").alias("status"),
    )


def review_rows(records: DataFrame, entity_of: DataFrame, routed: DataFrame, gate: bool = True, merge_at: float = R.MERGE_AT) -> DataFrame:
    """One row per record: candidate_entity, candidate_record, score, reason, blocked_field, status.

    A record with company is matched; else its best blocked pair, else its best pair for review
    decides; else it is alone and done.
    """
    def best(where: str, name: str) -> DataFrame:
        rows = per_record(routed.where(F.col("route") == where).select("a", "b", "score", "verdict", "reason", "blocked_field"))
        top = F.max_by(F.struct("other", "score", "verdict", "reason", "blocked_field"), F.struct("score", -F.col("other")))
        return rows.groupBy("id").agg(top.alias(name))

    size = entity_of.groupBy("entity_id").agg(F.count("*").alias("size"))
    base = entity_of.join(size, "entity_id").join(best_inside(routed, entity_of), "id", "left")
    base = base.join(best(BLOCKED, "x"), "id", "left").join(best(REVIEW, "y"), "id", "left")
    matched, blocked = F.col("size") > 1, F.col("x").isNotNull() & F.lit(gate)
    near = F.col("y").isNotNull()
    by_gate = F.col("y.verdict") == C.INSUFFICIENT
    chosen = F.when(matched, None).when(blocked, F.col("x.other")).when(near, F.col("y.other"))
    below = F.format_string("Scored %.2f; records are merged from %.2f on.", F.col("y.score"), F.lit(merge_at))
    rows = base.select(
        F.col("id").alias("record_id"),
        "entity_id",
        chosen.alias("candidate_record"),
        F.when(matched, F.floor(F.coalesce("best", F.lit(0.0)) * 10000 + 0.5) / 10000)
        .when(blocked, F.col("x.score")).when(near, F.col("y.score")).otherwise(1.0).alias("score"),
        F.when(matched, F.format_string("Linked with %d other record(s).", F.col("size") - 1))
        .when(blocked, F.col("x.reason")).when(near & by_gate, F.col("y.reason")).when(near, below)
        .otherwise("Nothing else resembles it.").alias("reason"),
        F.when(~matched & blocked, F.col("x.blocked_field")).alias("blocked_field"),
        F.when(matched, AUTO_MATCHED).when(blocked, "BLOCKED")
        .when(near & by_gate, INSUFFICIENT).when(near, NEEDS_REVIEW).otherwise(AUTO_MATCHED).alias("status"),
    )
    other = entity_of.select(F.col("id").alias("candidate_record"), F.col("entity_id").alias("other_entity"))
    return rows.join(other, "candidate_record", "left").select(
        "record_id", F.coalesce("other_entity", "entity_id").alias("candidate_entity"), "candidate_record", "score", "reason",
        "blocked_field", "status",
    )


# ---- the whole run ------------------------------------------------------------------------


@dataclass
class Plan:
    """All decisions of a run, before anything is published."""

    records: DataFrame
    pairs: DataFrame
    clusters: DataFrame
    entities: DataFrame
    crosswalk: DataFrame
    review: DataFrame
    proposals: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "pairs": self.pairs,
            "entities": self.entities,
            "crosswalk": self.crosswalk,
            "review": self.review,
            "blocks": self.pairs.where(F.col("route") == BLOCKED),
            "proposals": self.proposals,
        }


def resolve(
    records: DataFrame,
    *,
    gate: bool = True,
    merge_at: float = R.MERGE_AT,
    review_at: float = R.REVIEW_AT,
    k: int = R.CANDIDATES,
    weights: dict | None = None,
    same: str | None = None,
) -> Plan:
    """Enriched records to a plan; ``same``: a column as for ``bag_classes`` and ``cosine_top_k``."""
    candidates = hybrid_candidates(records, records, k, same)
    scored = score_pairs(records, candidates, weights, same)
    routed = scored.withColumn("route", route(F.col("score"), F.col("verdict"), gate, merge_at, review_at))
    members = components(records, routed.where(F.col("route") == EDGE))
    return _planned(records, routed, materialize(split_clusters(records, members, gate)), gate, merge_at)


def _planned(records: DataFrame, routed: DataFrame, clusters: DataFrame, gate: bool, merge_at: float) -> Plan:
    entities = number_entities(records, clusters)
    entity_of = materialize(clusters.join(entities.select("cluster", "entity_id"), "cluster").select("id", "entity_id"))
    golden = golden_records(survive(records, entity_of), entities)
    return Plan(
        records=records,
        pairs=routed,
        clusters=clusters,
        entities=golden,
        crosswalk=crosswalk(records, entity_of, routed),
        review=review_rows(records, entity_of, routed, gate, merge_at),
        proposals=clusters.where("signature is null").select("id", "component", "proposal"),
    )


def resolve_more(
    before: Plan,
    arrived: DataFrame,
    *,
    gate: bool = True,
    merge_at: float = R.MERGE_AT,
    review_at: float = R.REVIEW_AT,
    k: int = R.CANDIDATES,
    weights: dict | None = None,
    same: str | None = None,
) -> Plan:
    """The plan after enriched records have ``arrived`` (ids that ``before`` does not have), on top of a plan.

    Only the new records search, among all; only their pairs are compared. Components grow from the stored ones by the new
    edges, and only components that changed are cut anew. Pairs of older records keep the scores that they got; a
    full run would weigh their words by all records, so its scores may differ from these. ``same``: as for ``resolve``, over both.
    """
    records = before.records.unionByName(arrived, allowMissingColumns=True)
    # With such a column both were read together and lie stored.
    records = materialize(records) if same is None else records
    scored = score_pairs(records, hybrid_candidates(arrived, records, k, same), weights, same)
    fresh = scored.withColumn("route", route(F.col("score"), F.col("verdict"), gate, merge_at, review_at))
    known = before.clusters.select(F.col("id").alias("node"), "component")
    edges = fresh.where(F.col("route") == EDGE).select("a", "b").unionByName(arrived.select(F.col("id").alias("a"), F.col("id").alias("b")))
    grown = materialize(extend_components(known, edges))
    members = grown.select(F.col("node").alias("id"), "component", "touched")
    cut = split_clusters(records, members.where("touched").drop("touched"), gate)
    untouched = before.clusters.join(members.where("touched").select("id"), "id", "left_anti")
    clusters = materialize(untouched.unionByName(cut.select(untouched.columns)))
    pairs = before.pairs.unionByName(fresh.select(before.pairs.columns))
    return _planned(records, pairs, clusters, gate, merge_at)


def run_statistics(plan: Plan) -> DataFrame:
    """One row: records, pairs, edges, blocked, review, entities, merged records."""
    by_route = lambda r: F.count_if(F.col("route") == r).alias(r)
    pairs = plan.pairs.agg(F.count("*").alias("pairs"), by_route(EDGE), by_route(BLOCKED), by_route(REVIEW))
    entities = plan.entities.agg(
        F.count("*").alias("entities"), F.coalesce(F.sum("member_count"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(F.col("member_count") - 1), F.lit(0)).alias("merged"),
    )
    one = lambda df, c: df.select(c).scalar().alias(c)
    spark = plan.records.sparkSession
    return spark.range(1).select(*[one(pairs, c) for c in pairs.columns], *[one(entities, c) for c in entities.columns])


def status_histogram(review: DataFrame) -> DataFrame:
    return review.groupBy("status").agg(F.count("*").alias("records"))


def preview(texts: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """What the rules make of texts, without storing anything: category, norm_text, trace, tokens, attrs."""
    text = F.col(text_col)
    out = texts.withColumn("category", detect_category(text)).withColumn("norm_text", normalize(text, F.col("category")))
    return out.select(
        "*",
        rule_trace(text, F.col("category")).alias("trace"),
        tokenize(F.col("norm_text")).alias("tokens"),
        extract_attributes(F.col("norm_text"), F.col("category")).alias("attrs"),
    )
