"""Pair metrics against labels, candidate recall, hard-negative groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestitch.operators.retrieval import partition_key


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list:
    """precision, recall and f1 of three counts; 0 where nothing is to divide."""
    p = F.when(F.col(tp) + F.col(fp) > 0, F.col(tp) / (F.col(tp) + F.col(fp))).otherwise(0.0)
    r = F.when(F.col(tp) + F.col(fn) > 0, F.col(tp) / (F.col(tp) + F.col(fn))).otherwise(0.0)
    f1 = F.when(2 * F.col(tp) + F.col(fp) + F.col(fn) > 0, 2 * F.col(tp) / (2 * F.col(tp) + F.col(fp) + F.col(fn)))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(f1, F.lit(0.0)).alias("f1")]


def _pairs_in(groups: DataFrame) -> DataFrame:
    """Unordered pairs inside groups of given sizes: n (n - 1) / 2."""
    return groups.withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)


def pair_metrics(labelled: DataFrame) -> DataFrame:
    """category, tp, fp, fn, precision, recall, f1; labelled: id, category, truth, predicted.

    Pairs are those of one category. They are counted from group sizes, never enumerated: true
    pairs from (category, truth), predicted from (category, predicted), hits from all three.
    The row with a null category sums over all; records without a category are in ``unknown``.
    """
    labelled = labelled.withColumn("category", partition_key(F.col("category")))

    def count(*keys: str) -> DataFrame:
        rows = labelled.where("predicted is not null") if "predicted" in keys else labelled
        groups = rows.groupBy("category", *keys).agg(F.count("*").alias("n"))
        return _pairs_in(groups).groupBy("category").agg(F.sum("pairs").alias("_".join(keys)))

    all_ = count("truth").join(count("predicted"), "category", "left").join(count("truth", "predicted"), "category", "left")
    hits = F.coalesce("truth_predicted", F.lit(0.0))
    counts = all_.select(
        "category", hits.alias("tp"), (F.coalesce("predicted", F.lit(0.0)) - hits).alias("fp"), (F.col("truth") - hits).alias("fn")
    )
    whole = counts.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    rows = counts.unionByName(whole.select(F.lit(None).cast("string").alias("category"), "tp", "fp", "fn"))
    return rows.select("category", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *rates())


def hard_slice(labelled: DataFrame, groups: DataFrame) -> DataFrame:
    """tp, fp, fn and rates on the confusable items; groups: truth, hard_group.

    True pairs of items that are in a group, and false pairs inside one group.
    """
    tagged = labelled.join(groups, "truth")
    count = lambda *k: _pairs_in(tagged.groupBy("category", *k).agg(F.count("*").alias("n"))).agg(
        F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")
    ).scalar()
    known = tagged.where("predicted is not null")
    among = lambda *k: _pairs_in(known.groupBy("category", *k).agg(F.count("*").alias("n"))).agg(
        F.coalesce(F.sum("pairs"), F.lit(0.0)).alias("pairs")
    ).scalar()
    row = labelled.sparkSession.range(1).select(
        among("truth", "predicted").alias("tp"),
        (among("hard_group", "predicted") - among("truth", "predicted")).alias("fp"),
        (count("truth") - among("truth", "predicted")).alias("fn"),
    )
    return row.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")], *rates())


def hard_negative_groups(items: DataFrame) -> DataFrame:
    """hard_group, truths: groups with more than one true item. ``items``: truth, hard_group."""
    groups = items.where("hard_group is not null").groupBy("hard_group").agg(F.array_sort(F.collect_set("truth")).alias("truths"))
    return groups.where(F.size("truths") > 1)


def least_contradictions(rows: DataFrame, groups: list[str], label: str, limit: int) -> DataFrame:
    """The group's columns, a, b, label_a, label_b: the ``limit`` least pairs (a < b) of one group and different labels; ``rows``: id and these.

    Not all pairs are made. The first of a group's ids has a partner wherever there are two labels, so only the ``limit`` groups of
    smallest first id count; in a group only its ``limit`` first ids can be a, and their partners are among the ``2 * limit`` first
    ids of each label, and of those among the ``4 * limit`` first. What is joined does not grow with a group.
    """
    rows = rows.select(*groups, "id", F.col(label).alias("label"))
    # A group of one label has none; the smallest and the largest label tell.
    mixed = rows.groupBy(*groups).agg(F.min("id").alias("first"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    mixed = mixed.orderBy("first", *groups).limit(limit).select(*groups)
    inside = rows.join(mixed, groups, "left_semi")
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    inside = inside.withColumn("nth", nth(*groups, "label")).where(F.col("nth") <= 2 * limit)
    inside = inside.withColumn("nth", nth(*groups)).where(F.col("nth") <= 4 * limit)
    a = inside.where(F.col("nth") <= limit).select(*groups, F.col("id").alias("a"), F.col("label").alias("label_a"))
    b = inside.select(*groups, F.col("id").alias("b"), F.col("label").alias("label_b"))
    return a.join(b, groups).where("a < b and label_a <> label_b").orderBy("a", "b").limit(limit)


def false_merges(labelled: DataFrame, limit: int = 20) -> DataFrame:
    """a, b, predicted, truth_a, truth_b: examples of different items under one entity, smallest ids first."""
    rows = labelled.withColumn("category", partition_key(F.col("category"))).where("predicted is not null")
    found = least_contradictions(rows, ["category", "predicted"], "truth", limit)
    return found.select("a", "b", "predicted", F.col("label_a").alias("truth_a"), F.col("label_b").alias("truth_b")).orderBy("a", "b")


def missed_pairs(labelled: DataFrame, limit: int = 20) -> DataFrame:
    """a, b, truth, predicted_a, predicted_b: examples of one item under different entities, or under none, smallest ids first."""
    # Records without an entity are together with nobody.
    own = F.coalesce(F.concat(F.lit("+"), F.col("predicted")), F.concat(F.lit("-"), F.col("id").cast("string")))
    rows = labelled.withColumn("category", partition_key(F.col("category"))).where("truth is not null").withColumn("own", own)
    found = least_contradictions(rows, ["category", "truth"], "own", limit)
    entity = lambda c: F.when(F.col(c).startswith("+"), F.substring(F.col(c), 2, 2**31 - 1))
    return found.select("a", "b", "truth", entity("label_a").alias("predicted_a"), entity("label_b").alias("predicted_b")).orderBy("a", "b")


def candidate_recall(truth_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """true_pairs, found, recall: truth pairs (a < b) that the candidates list in either direction."""
    seen = candidates.select(F.least("query_id", "cand_id").alias("a"), F.greatest("query_id", "cand_id").alias("b")).distinct()
    all_ = truth_pairs.agg(F.count("*").alias("n")).scalar()
    hit = truth_pairs.join(seen, ["a", "b"], "left_semi").agg(F.count("*").alias("n")).scalar()
    row = truth_pairs.sparkSession.range(1).select(all_.alias("true_pairs"), hit.alias("found"))
    return row.withColumn("recall", F.when(F.col("true_pairs") > 0, F.col("found") / F.col("true_pairs")).otherwise(1.0))


def group_recall(labelled: DataFrame, candidates: DataFrame) -> DataFrame:
    """true_pairs, found, recall: as ``candidate_recall`` where true pairs are those of equal ``truth``; labelled: id, truth.

    True pairs are counted from group sizes and found ones from the candidates, so no pair of a group is made.
    """
    sizes = labelled.where("truth is not null").groupBy("truth").agg(F.count("*").alias("n"))
    all_ = _pairs_in(sizes).agg(F.coalesce(F.sum("pairs"), F.lit(0.0)).cast("long").alias("n")).scalar()
    seen = candidates.select(F.least("query_id", "cand_id").alias("a"), F.greatest("query_id", "cand_id").alias("b")).where("a <> b").distinct()
    side = lambda p: labelled.select(F.col("id").alias(p), F.col("truth").alias(f"{p}_truth"))
    hit = seen.join(side("a"), "a").join(side("b"), "b").where("a_truth = b_truth").agg(F.count("*").alias("n")).scalar()
    row = labelled.sparkSession.range(1).select(all_.alias("true_pairs"), hit.alias("found"))
    return row.withColumn("recall", F.when(F.col("true_pairs") > 0, F.col("found") / F.col("true_pairs")).otherwise(1.0))


def evaluation_rows(labelled: DataFrame, job_id: str) -> DataFrame:
    """The metrics of one run as rows to append to the evaluation log: job_id, category, counts, rates, at."""
    return pair_metrics(labelled).select(F.lit(job_id).alias("job_id"), "*", F.current_timestamp().alias("at"))
