"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.plans.materialize import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of an edge; the component is its least node.

    Alternating large-star and small-star steps: each links a node's neighbours to the least
    neighbour, once for the larger and once for the smaller ones, until only stars remain. The
    least neighbour is a partial aggregate and the join back is an equi-join that adaptive
    execution can split, so a node with very many neighbours is not collected anywhere. Rounds
    grow as the logarithm of the graph; each round is kept in the shared checkpoint folder.
    """
    base = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    now = materialize(base.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = base.where("x = y").select(F.col("x").alias("node")).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    lonely = alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(lonely)


def extend_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component, touched: components ``labels`` (node, component) after more edges.

    An edge between known nodes is one between their components, so the graph that is searched has the new
    edges only, however large the known part is; a known label is read once, for a join. ``touched``: the component is
    not one of ``labels``, with the same nodes. A label is the least node of its component, as in ``connected_components``.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    known = labels.select("node", "component")
    named = lambda df, end: df.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root")), end, "left")
    rooted = materialize(named(named(ends, "x"), "y"))
    root = lambda end: F.coalesce(f"{end}_root", end)
    merged = materialize(connected_components(rooted.select(root("x").alias("a"), root("y").alias("b"))))
    # Roots that only meet themselves change nothing; nodes that are met first do.
    fresh = rooted.select(F.explode(F.array(*[F.struct(F.col(e).alias("node"), F.col(f"{e}_root").alias("root")) for e in "xy"])).alias("e"))
    fresh = fresh.select("e.*").where("root is null").select("node").distinct()
    joined = merged.join(fresh.select(F.col("node"), F.lit(True).alias("new")), "node", "left")
    several = joined.groupBy("component").agg((F.count("*") > 1).alias("many"), F.coalesce(F.max("new"), F.lit(False)).alias("new"))
    renamed = joined.select(F.col("node").alias("old"), "component").join(several, "component").select(
        "old", F.col("component").alias("now"), (F.col("many") | F.col("new")).alias("changed")
    )
    kept = known.join(renamed, F.col("component") == F.col("old"), "left").select(
        "node", F.coalesce("now", "component").alias("component"), F.coalesce("changed", F.lit(False)).alias("touched")
    )
    added = fresh.join(renamed, F.col("node") == F.col("old")).select("node", F.col("now").alias("component"), F.lit(True).alias("touched"))
    return kept.unionByName(added)
