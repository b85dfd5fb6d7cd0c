"""Three-state comparison, the gate, and relations of the score."""

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import compare as C
from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG

VALVE = {"item_type": "GATE VALVE", "size": "DN150", "material": "CARBON STEEL", "pressure_class": "CL150", "end_connection": "FLANGED", "standard": "API 600"}
BOLT = {"item_type": "HEXAGON HEAD BOLT", "thread_size": "M16", "length_mm": 100.0, "property_class": "8.8"}
NUT = {"item_type": "HEXAGON NUT", "thread_size": "M16", "property_class": "8.8"}


def bag(values):
    return {k: (v if isinstance(v, str) else None, v if isinstance(v, float) else None, "s", "rule", 0.99) for k, v in values.items()}


def pairs(spark, rows):
    return spark.createDataFrame([(i, c, bag(a), bag(b)) for i, (c, a, b) in enumerate(rows)], f"i int, c string, a {BAG}, b {BAG}")


VALUES = [
    ("bore_mm", 25.0, 25.0, C.MATCH), ("bore_mm", 25.0, 25.5, C.MISMATCH), ("bore_mm", 25.0, 25.005, C.MATCH), ("bore_mm", None, 25.0, C.UNKNOWN),
    ("cross_section_sqmm", "95", 95.0, C.MATCH), ("material", " carbon  steel", "CARBON STEEL", C.MATCH), ("pressure_class", "PN20", "CL150", C.MATCH),
    ("pressure_class", "CL150", "PN16", C.MISMATCH), ("item_type", "BALL BEARING", "DEEP GROOVE BALL BEARING", C.MATCH), ("item_type", "BOLT", "NUT", C.MISMATCH),
    ("material", "STAINLESS STEEL", "STAINLESS STEEL 316", C.MISMATCH), ("finish", "ZINC PLATED", "ZINC", C.MATCH), ("material", "", "X", C.UNKNOWN), ("cores", 3.0, 4.0, C.MISMATCH),
]


def test_states(spark):
    rows = [(R.VALVE, {k: a} if a is not None else {}, {k: b} if b is not None else {}) for k, a, b, _ in VALUES]
    df = pairs(spark, rows).join(spark.createDataFrame([(i, v[0]) for i, v in enumerate(VALUES)], "i int, k string"), "i")
    one = C.compare_bags(F.col("a"), F.col("b"), F.col("c"), F.array("k"))[0]
    found = {r.i: r.s for r in df.select("i", one["state"].alias("s")).collect()}
    assert [(*v[:3], found[i]) for i, v in enumerate(VALUES)] == VALUES


GATE = [
    (R.VALVE, VALVE, VALVE, C.PASS, None), (R.VALVE, VALVE, VALVE | {"pressure_class": "PN20"}, C.PASS, None),
    (R.VALVE, VALVE, VALVE | {"pressure_class": "CL300"}, C.BLOCK, "pressure_class"), (R.VALVE, VALVE, VALVE | {"material": "X", "size": "DN100"}, C.BLOCK, "material"),
    (R.VALVE, VALVE, {k: v for k, v in VALVE.items() if k != "size"}, C.INSUFFICIENT, None), (R.VALVE, VALVE, {"material": "X"}, C.BLOCK, "material"),
    (R.FASTENER, NUT, NUT, C.PASS, None), (R.FASTENER, BOLT, NUT, C.INSUFFICIENT, None), (R.FASTENER, BOLT, BOLT | {"length_mm": 80.0}, C.BLOCK, "length_mm"),
    (R.UNKNOWN, VALVE, VALVE, C.INSUFFICIENT, None), (None, VALVE, VALVE, C.INSUFFICIENT, None),
]


def test_gate(spark):
    v = C.safety_verdict(F.col("a"), F.col("b"), F.col("c"))
    found = {r.i: (r.v.status, r.v.blocked_field) for r in pairs(spark, [g[:3] for g in GATE]).select("i", v.alias("v")).collect()}
    assert [found[i] for i in range(len(GATE))] == [g[3:] for g in GATE]


def test_scores(spark):
    other = VALVE | {"pressure_class": "CL300"}
    thin = {"item_type": "GATE VALVE"}
    rows = [(R.VALVE, VALVE, VALVE), (R.VALVE, VALVE, other), (R.VALVE, thin, thin), (R.VALVE, {}, {}), (None, {"x": "1"}, {"x": "1"})]
    m = C.match_score(F.col("a"), F.col("b"), F.lit(0.98), F.lit(0.95), F.col("c"))
    found = {r.i: r.m for r in pairs(spark, rows).select("i", m.alias("m")).collect()}
    assert found[0].score == pytest.approx(0.982309, abs=1e-6) and found[0].coverage == pytest.approx(0.978723, abs=1e-6)
    assert found[1].score == pytest.approx(0.794520, abs=1e-6) and found[1].score < found[0].score
    assert found[2].agreement < found[0].agreement  # thin evidence is pulled to neutral
    assert (found[3].agreement, found[3].coverage) == (0.5, 0.0)
    assert [c.key for c in found[4].comparisons] == ["x"]
    w = R.WEIGHTS[R.VALVE]
    assert found[0].score == pytest.approx((w[0] * 0.98 + w[1] * 0.95 + w[2] * found[0].agreement) / sum(w[:3]))


def test_explanation_puts_critical_keys_first(spark):
    df = pairs(spark, [(R.VALVE, VALVE, VALVE)])
    m = C.match_score(F.col("a"), F.col("b"), F.lit(5.0), F.lit(-1.0), F.col("c"))
    row = df.select(m.alias("m"), "c").select("m", C.explanation(F.col("m.comparisons"), F.col("c")).alias("e")).first()
    assert [x.key for x in row.e][:3] == ["material", "pressure_class", "size"] and row.e[0].critical
    assert (row.m.semantic, row.m.lexical) == (1.0, 0.0)
