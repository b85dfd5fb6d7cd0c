"""All pairs of records that share a block, compared once per pair of equal attribute bags.

Records of one category whose bags look alike to a comparison are a class, and what a comparison says of two classes it
says of all their pairs. So classes are compared, and pairs come from joining lists of ids: no pair is shuffled, and
filters on what was said of the classes apply before their pairs are made. The members of a large block are dealt to
parts that meet pairwise, so a task holds lists of bounded length, however large a block is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.plans.materialize import stored

#: Records of a part of a block; pairs that a task makes.
PART, TASK_PAIRS = 2048, 1 << 24


@dataclass(frozen=True)
class Blocks:
    """``members``: the records with their ``class`` and the ``parts`` of their block; ``bags``: class, category, attrs (prepared)."""

    keys: list[str]
    members: DataFrame
    bags: DataFrame
    tasks: int


def in_blocks(records: DataFrame, keys: Sequence[str], part: int = PART) -> Blocks:
    """Records (id, category, attrs, ``keys`` and what is carried along) by block; a record without one of the keys is in none."""
    keys = list(keys)
    entries = lambda bag: F.array_sort(F.map_entries(bag))
    rows = records.dropna(subset=keys).withColumn("bag", entries(F.col("attrs"))).drop("attrs")
    # Bags are prepared once each; several may look alike afterwards.
    given = rows.groupBy("category", "bag").agg(F.min("id").alias("first"))
    given = stored(given.withColumn("alike", entries(C.prepared(F.map_from_entries("bag")))))
    found = stored(given.groupBy("category", "alike").agg(F.min("first").alias("class")))
    alike = found.toDF("_category", "_alike", "class")
    known = given.join(alike, F.col("category").eqNullSafe(F.col("_category")) & F.col("alike").eqNullSafe(F.col("_alike"))).select(
        F.col("category").alias("_category"), F.col("bag").alias("_bag"), "class"
    )
    same = F.col("category").eqNullSafe(F.col("_category")) & F.col("bag").eqNullSafe(F.col("_bag"))
    members, tasks = _dealt(rows.join(known, same).drop("_category", "_bag", "bag"), rows, keys, part)
    return Blocks(keys, members, found.select("class", "category", F.map_from_entries("alike").alias("attrs")), tasks)


def _dealt(members: DataFrame, rows: DataFrame, keys: list[str], part: int) -> tuple[DataFrame, int]:
    """(``members`` with the ``parts`` of their block, as its ``rows`` are many; how many tasks its pairs are dealt to)."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = sizes.select(*keys, "n", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    members = stored(members.join(parts, keys))
    pairs = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return members.drop("n"), int(max(members.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)))


def redealt(blocks: Blocks, members: DataFrame, keys: Sequence[str], part: int = PART) -> Blocks:
    """``members`` (id, class, ``keys``) in blocks of ``keys``, with the classes of ``blocks``; one without one of the keys is in none."""
    rows = members.dropna(subset=list(keys))
    dealt, tasks = _dealt(rows, rows, list(keys), part)
    return Blocks(list(keys), dealt, blocks.bags, tasks)


def class_pairs(blocks: Blocks) -> DataFrame:
    """x, y, category (of x), a_attrs, b_attrs: the classes that meet in a block, in both orders, with their prepared bags."""
    there = blocks.members.select(*blocks.keys, F.col("class").alias("x")).distinct()
    met = there.join(there.withColumnRenamed("x", "y"), blocks.keys).select("x", "y").distinct()
    one = blocks.bags.select(F.col("class").alias("x"), "category", F.col("attrs").alias("a_attrs"))
    two = blocks.bags.select(F.col("class").alias("y"), F.col("attrs").alias("b_attrs"))
    # Comparing takes far longer than its bytes tell, so the pairs are dealt by row and not by size.
    dealt = stored(met).repartition(4 * met.sparkSession.sparkContext.defaultParallelism, "x", "y")
    return dealt.join(F.broadcast(one) if _few(blocks) else one, "x").join(F.broadcast(two) if _few(blocks) else two, "y")


def _few(blocks: Blocks, most: int = 4096) -> bool:
    """Whether there are few classes, counted."""
    return blocks.bags.limit(most + 1).count() <= most


def pairs_of(blocks: Blocks, said: DataFrame, of_class: Sequence[str] = (), of_record: Sequence[str] = ()) -> DataFrame:
    """a, b and what is ``said`` (x, y, ...) of their classes, once for each two records a < b of a block.

    Columns of the members that are named come along as a_... and b_...; those ``of_class`` split the classes, so that
    filters on them, too, apply before pairs are made.
    """
    keys, n = blocks.keys, blocks.tasks
    record = F.struct("id", *of_record) if of_record else F.col("id")
    lists = blocks.members.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy(*keys, "parts", "part", "class", *of_class)
    lists = lists.agg(F.collect_list(record).alias("ids"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = lists.select(*keys, F.col("part").alias("i"), every.alias("j"), F.col("class").alias("x"), F.col("ids").alias("one"), *[F.col(c).alias(f"a_{c}") for c in of_class])
    b = lists.select(*keys, every.alias("i"), F.col("part").alias("j"), F.col("class").alias("y"), F.col("ids").alias("two"), *[F.col(c).alias(f"b_{c}") for c in of_class])
    cell = [*keys, "i", "j"]
    met = a.repartition(n, *cell).join(b.repartition(n, *cell), cell).drop(*cell)
    rows = met.join(said, ["x", "y"]).drop("x", "y").withColumn("one", F.explode("one")).withColumn("two", F.explode("two"))
    if not of_record:
        return rows.withColumnsRenamed({"one": "a", "two": "b"}).where("a < b")
    rows = rows.where("one.id < two.id").withColumns({"a": F.col("one.id"), "b": F.col("two.id")})
    rows = rows.withColumns({f"{s}_{c}": F.col(f"{side}.{c}") for s, side in (("a", "one"), ("b", "two")) for c in of_record})
    return rows.drop("one", "two")
