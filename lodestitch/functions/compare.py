"""Comparing two attribute bags: three states, the safety gate, and an explained score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import value_text
from lodestitch.functions.text import collapsed, let, number_text

MATCH, MISMATCH, UNKNOWN = "MATCH", "MISMATCH", "UNKNOWN"
PASS, BLOCK, INSUFFICIENT = "PASS", "BLOCK", "INSUFFICIENT_EVIDENCE"


def by_category(category: Column, values: dict[str, Column], other: Column) -> Column:
    """The value of the row's category, else ``other``."""
    out = other
    for name, value in values.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# ---- one attribute ------------------------------------------------------------------------


def canonical(value: Column) -> Column:
    """The text that equality looks at: upper case, single blanks; null when empty or missing."""
    return F.nullif(F.upper(collapsed(value_text(value))), F.lit(""))


def numeric(value: Column) -> Column:
    """The value as a number, read from its text if it must."""
    return F.coalesce(value["value_num"], F.trim(value["value_str"]).try_cast("double"))


def equivalence(a: Column, b: Column, category: Column) -> Column:
    """Confidence that two pressure notations mean the same: 1 when equal, 0 when unrelated."""
    pairs = {f"{x}={y}": c for x, y, c in R.EQUIVALENCES} | {f"{y}={x}": c for x, y, c in R.EQUIVALENCES}
    known = _map(pairs)[F.concat(a, F.lit("="), b)]
    return F.when(a == b, 1.0).when(category.isin(*R.SIZED), F.coalesce(known, F.lit(0.0))).otherwise(0.0)


def all_equivalences() -> list[dict]:
    """The table of equivalences, for reports."""
    return [
        {"left": a, "right": b, "confidence": c, "categories": list(R.SIZED)} for a, b, c in R.EQUIVALENCES
    ]


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(text, " "))


def _broader(a: Column, b: Column) -> Column:
    """Whether the words of ``a`` are a proper part of those of ``b``."""
    return (F.size(F.array_except(_words(a), _words(b))) == 0) & (F.size(_words(b)) > F.size(_words(a)))


def prepared(bag: Column) -> Column:
    """map<key, struct<c, n>>: what comparisons look at, to be computed once per record and not once per pair."""
    return F.transform_values(bag, lambda _, v: F.struct(canonical(v).alias("c"), numeric(v).alias("n")))


def _compared(key: Column, sides: Column, category: Column) -> Column:
    """struct<key, state, a, b, equivalence, reason>; ``sides``: struct<ca, cb, na, nb>."""

    def of(x: Column) -> Column:
        ca, cb, na, nb = x["ca"], x["cb"], x["na"], x["nb"]
        tolerance = _map(R.TOLERANCE)[key]
        as_numbers = tolerance.isNotNull() & na.isNotNull() & nb.isNotNull()
        nested = key.isin(*R.HIERARCHICAL) & (_broader(ca, cb) | _broader(cb, ca))
        alike = F.when(key == R.EQUIVALENT_KEY, equivalence(ca, cb, category)).otherwise(0.0)
        missing = ca.isNull() | cb.isNull()
        state = (
            F.when(missing, UNKNOWN)
            .when(as_numbers, F.when(F.abs(na - nb) <= tolerance, MATCH).otherwise(MISMATCH))
            .when((ca == cb) | nested | (alike >= R.EQUIVALENCE_FLOOR), MATCH)
            .otherwise(MISMATCH)
        )
        against = lambda p, q: F.concat_ws(" <> ", p, q)
        without = F.when(ca.isNull() & cb.isNull(), "a and b").when(ca.isNull(), "a").otherwise("b")
        reason = (
            F.when(missing, F.concat(F.lit("no value in "), without))
            .when(as_numbers & (F.abs(na - nb) <= tolerance), "same number")
            .when(as_numbers, against(number_text(na), number_text(nb)))
            .when(ca == cb, "same value")
            .when(nested & _broader(ca, cb), F.format_string("%s covers %s", ca, cb))
            .when(nested, F.format_string("%s covers %s", cb, ca))
            .when(alike >= R.EQUIVALENCE_FLOOR, "one value, two notations")
            .when(alike > 0, F.format_string("%s <> %s, though close (%.2f)", ca, cb, alike))
            .otherwise(against(ca, cb))
        )
        softened = F.when(missing | as_numbers | (ca == cb) | nested, 0.0).otherwise(alike)
        return F.struct(
            key.alias("key"), state.alias("state"), ca.alias("a"), cb.alias("b"), softened.alias("equivalence"), reason.alias("reason")
        )

    return let(sides, of)


def compare_values(key: Column, a: Column, b: Column, category: Column) -> Column:
    """struct<key, state, a, b, equivalence, reason> of one attribute on both sides."""
    sides = F.struct(canonical(a).alias("ca"), canonical(b).alias("cb"), numeric(a).alias("na"), numeric(b).alias("nb"))
    return _compared(key, sides, category)


def compare_prepared(a: Column, b: Column, category: Column, keys: Column) -> Column:
    """As ``compare_bags``, of two prepared bags."""

    def one(k: Column) -> Column:
        x, y = F.try_element_at(a, k), F.try_element_at(b, k)
        return _compared(k, F.struct(x["c"].alias("ca"), y["c"].alias("cb"), x["n"].alias("na"), y["n"].alias("nb")), category)

    return F.transform(keys, one)


def compare_bags(a: Column, b: Column, category: Column, keys: Column) -> Column:
    """One comparison per key, in the order of the keys."""
    return F.transform(keys, lambda k: compare_values(k, F.try_element_at(a, k), F.try_element_at(b, k), category))


def all_keys(a: Column, b: Column) -> Column:
    """The sorted union of the keys of both bags."""
    return F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))


def schema_keys(category: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The attribute keys of a category; for an unknown one those that either bag has."""
    other = _strings(()) if a is None or b is None else all_keys(a, b)
    return by_category(category, {c: _strings(k) for c, k in R.SCHEMAS.items()}, other)


def state_keys(comparisons: Column, state: str) -> Column:
    """The keys that are in a state."""
    return F.transform(F.filter(comparisons, lambda c: c["state"] == state), lambda c: c["key"])


def state_counts(comparisons: Column) -> Column:
    """struct<matched, mismatched, unknown>."""
    count = lambda s: F.size(F.filter(comparisons, lambda c: c["state"] == s))
    return F.struct(count(MATCH).alias("matched"), count(MISMATCH).alias("mismatched"), count(UNKNOWN).alias("unknown"))


def distinct_values(values: Column) -> Column:
    """Distinct canonical values in order, without nulls."""
    return F.array_distinct(F.filter(F.transform(values, canonical), lambda v: v.isNotNull()))


# ---- the safety gate ----------------------------------------------------------------------


def critical_fields(category: Column) -> Column:
    return by_category(category, {c: _strings(k) for c, k in R.CRITICAL.items()}, _strings(()))


def applicable_fields(category: Column, a: Column, b: Column) -> Column:
    """The critical fields of a pair: a conditional one counts if either item is of its kinds."""
    kind = lambda bag: canonical(F.try_element_at(bag, F.lit("item_type")))
    return fields_of_kinds(category, kind(a), kind(b))


def fields_of_kinds(category: Column, kind_a: Column, kind_b: Column) -> Column:
    """The critical fields of a pair of items of these kinds."""

    def counts(key: Column) -> Column:
        out = F.lit(True)
        for name, kinds in R.CONDITIONAL.items():
            either = F.coalesce(kind_a.isin(*kinds), F.lit(False)) | F.coalesce(kind_b.isin(*kinds), F.lit(False))
            out = F.when(key == name, either).otherwise(out)
        return out

    return F.filter(critical_fields(category), counts)


def safety_verdict(a: Column, b: Column, category: Column) -> Column:
    """struct<status, blocked_field, blocked_a, blocked_b, unknown_fields, reason, critical>."""
    return verdict_of(compare_bags(a, b, category, applicable_fields(category, a, b)), category)


def critical_of(comparisons: Column, a: Column, b: Column, category: Column) -> Column:
    """Of all comparisons of a pair those of its critical fields, in their order; a, b: prepared bags."""
    kind = lambda bag: F.try_element_at(bag, F.lit("item_type"))["c"]
    of_key = lambda k: F.get(F.filter(comparisons, lambda c: c["key"] == k), F.lit(0))
    return F.transform(fields_of_kinds(category, kind(a), kind(b)), of_key)


def verdict_of(critical: Column, category: Column) -> Column:
    """The verdict from the comparisons of the critical fields."""

    def of(critical: Column) -> Column:
        first = F.get(F.filter(critical, lambda c: c["state"] == MISMATCH), F.lit(0))
        unknown = state_keys(critical, UNKNOWN)
        no_set = F.size(critical_fields(category)) == 0
        status = (
            F.when(no_set, INSUFFICIENT)
            .when(first.isNotNull(), BLOCK)
            .when(F.size(unknown) > 0, INSUFFICIENT)
            .otherwise(PASS)
        )
        reason = (
            F.when(no_set, "No critical fields are defined for this category.")
            .when(first.isNotNull(), F.format_string("%s differs: %s vs %s.", first["key"], first["a"], first["b"]))
            .when(F.size(unknown) > 0, F.concat(F.lit("Not stated on both sides: "), F.array_join(unknown, ", "), F.lit(".")))
            .otherwise("All critical attributes are stated and agree.")
        )
        return F.struct(
            status.alias("status"),
            first["key"].alias("blocked_field"),
            first["a"].alias("blocked_a"),
            first["b"].alias("blocked_b"),
            F.when(first.isNull(), unknown).otherwise(_strings(())).alias("unknown_fields"),
            reason.alias("reason"),
            critical.alias("critical"),
        )

    return let(critical, of)


# ---- the score ----------------------------------------------------------------------------


def component_weights(category: Column, weights: dict | None = None) -> Column:
    """struct<semantic, lexical, attributes> summing to 1."""
    table = weights or R.WEIGHTS

    def shares(ws: float, wl: float, wa: float) -> Column:
        if ws + wl + wa <= 0:
            ws, wl, wa = R.ZERO_SUM_WEIGHTS
        total = ws + wl + wa
        names = ("semantic", "lexical", "attributes")
        return F.struct(*[F.lit(w / total).alias(n) for n, w in zip(names, (ws, wl, wa), strict=True)])

    return by_category(category, {c: shares(*w[:3]) for c, w in table.items()}, shares(*R.FALLBACK_WEIGHTS))


def key_weight(key: Column, category: Column, weights: dict | None = None) -> Column:
    table = {c: _map(w[3])[key] if w[3] else F.lit(None) for c, w in (weights or R.WEIGHTS).items()}
    return F.coalesce(by_category(category, table, F.lit(None).cast("double")), F.lit(R.KEY_WEIGHT))


def agreement(comparisons: Column, category: Column, weights: dict | None = None) -> Column:
    """struct<agreement, coverage>: weighted agreement on what is known, pulled to 0.5 by what is not."""
    critical = critical_fields(category)

    def total(of: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(comparisons, F.lit(0.0), lambda s, c: s + of(c, key_weight(c["key"], category, weights)))

    def contribution(c: Column, w: Column) -> Column:
        penalty = F.when(F.array_contains(critical, c["key"]), R.PENALTY_CRITICAL).otherwise(R.PENALTY_OTHER)
        soft = penalty * (1.0 - R.SOFTENING * c["equivalence"])
        return F.when(c["state"] == MATCH, w).when(c["state"] == MISMATCH, -w * soft).otherwise(0.0)

    sums = F.struct(
        total(contribution).alias("sum"),
        total(lambda c, w: F.when(c["state"] != UNKNOWN, w).otherwise(0.0)).alias("known"),
        total(lambda c, w: w).alias("all"),
    )

    def of(s: Column) -> Column:
        some = s["known"] > 0
        known = F.when(some, s["known"]).otherwise(1.0)
        raw = F.least(F.greatest(s["sum"] / known, F.lit(-1.0)), F.lit(1.0))
        coverage = F.when(s["all"] > 0, s["known"] / F.when(s["all"] > 0, s["all"]).otherwise(1.0)).otherwise(0.0)
        trust = R.LEAST_TRUST + (1.0 - R.LEAST_TRUST) * coverage
        value = 0.5 + ((raw + 1.0) / 2.0 - 0.5) * trust
        return F.struct(F.when(some, value).otherwise(0.5).alias("agreement"), F.when(some, coverage).otherwise(0.0).alias("coverage"))

    return let(sums, of)


def clipped(value: Column) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def weighed(weights: Column, semantic: Column, lexical: Column, agreement: Column) -> Column:
    """The score of three parts in [0, 1]; ``weights``: struct<semantic, lexical, attributes>."""
    return clipped(weights["semantic"] * semantic + weights["lexical"] * lexical + weights["attributes"] * agreement)


def match_score(a: Column, b: Column, semantic: Column, lexical: Column, category: Column, weights: dict | None = None) -> Column:
    """struct<score, semantic, lexical, agreement, coverage, comparisons>."""
    return score_of(compare_bags(a, b, category, schema_keys(category, a, b)), semantic, lexical, category, weights)


def score_of(comparisons: Column, semantic: Column, lexical: Column, category: Column, weights: dict | None = None) -> Column:
    """The score from the comparisons of all keys."""

    def of(comparisons: Column) -> Column:
        def scored(g: Column) -> Column:
            w = component_weights(category, weights)
            s, x = clipped(semantic), clipped(lexical)
            return F.struct(
                weighed(w, s, x, g["agreement"]).alias("score"),
                s.alias("semantic"),
                x.alias("lexical"),
                g["agreement"].alias("agreement"),
                g["coverage"].alias("coverage"),
                comparisons.alias("comparisons"),
            )

        return let(agreement(comparisons, category, weights), scored)

    return let(comparisons, of)


def explanation(comparisons: Column, category: Column) -> Column:
    """The comparisons with critical and weight, critical first, then by weight and key."""
    critical = critical_fields(category)
    rows = F.transform(
        comparisons,
        lambda c: F.struct(
            (~F.array_contains(critical, c["key"])).alias("other"),
            (-key_weight(c["key"], category)).alias("minus_weight"),
            c["key"].alias("key"),
            c.alias("comparison"),
        ),
    )
    return F.transform(
        F.sort_array(rows),
        lambda r: F.struct(
            r["key"].alias("key"),
            r["comparison"]["state"].alias("state"),
            r["comparison"]["a"].alias("a"),
            r["comparison"]["b"].alias("b"),
            (~r["other"]).alias("critical"),
            (-r["minus_weight"]).alias("weight"),
            r["comparison"]["reason"].alias("reason"),
        ),
    )


def is_consistent(values: Column) -> Column:
    """Whether the stated values of one field in a cluster are one value at most."""
    return F.size(distinct_values(values)) <= 1
