"""Golden values of attribute extraction."""

from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.attributes import BAG, extract_attributes, fill_gaps

L316, P316, L304, P304 = (f"STAINLESS STEEL {g}" for g in ("316L", "316", "304L", "304"))
CASES = [
    *[(R.VALVE, t, {"material": m}) for t, m in (
        ("SS316", P316), ("SS 316", P316), ("AISI 316", P316), ("CF8M", P316), ("SS316L", L316), ("SS 316 L", L316), ("CF3M", L316), ("SS304", P304),
        ("SS304L", L304), ("CF3", L304), ("SS316 LONG PATTERN", P316), ("WCB", "CARBON STEEL"), ("A106", "CARBON STEEL"), ("STAINLESS STEEL", "STAINLESS STEEL"))],
    *[(R.VALVE, t, {"pressure_class": c}) for t, c in (
        ("CL150", "CL150"), ("CLASS 150", "CL150"), ("ANSI 150", "CL150"), ("150#", "CL150"), ("#150", "CL150"), ("CL 150", "CL150"), ("DN150", None), ("PN20", "PN20"))],
    *[(R.BEARING, f"BEARING {d}", {"bore_mm": b}) for d, b in (
        ("6205", 25.0), ("6306", 30.0), ("6204", 20.0), ("6305", 25.0), ("22220", 100.0), ("NU210", 50.0), ("6200", 10.0), ("6202", 15.0))],
    (R.BEARING, "6205 25MM BORE 52MM OD 15MM WIDTH", {"bore_mm": 25.0, "outer_diameter_mm": 52.0, "width_mm": 15.0}),
    (R.BEARING, "6205 BORE 25 MM OD 52 MM", {"bore_mm": 25.0, "outer_diameter_mm": 52.0}),
    (R.BEARING, "6205 BORE 25 MM OD 52", {"bore_mm": 25.0, "outer_diameter_mm": None}),
    (R.BEARING, "6205-2RS", {"designation": "6205", "seal_type": "2RS"}), (R.BEARING, "6205", {"seal_type": "OPEN"}), (R.BEARING, "X", {"item_type": "BEARING", "seal_type": None}),
    (R.CABLE, "2CX2.5 MM2", {"cores": 2.0, "cross_section_sqmm": 2.5}), (R.CABLE, "650/1100 V", {"voltage_grade": "1.1KV"}), (R.CABLE, "1100 V", {"voltage_grade": "1.1KV"}),
    (R.CABLE, "11100 V", {"voltage_grade": None}), (R.CABLE, "3.3 KV", {"voltage_grade": "3.3KV"}), (R.CABLE, "3 CORE 95 SQ MM ARMOURED", {"cores": 3.0, "armour": "ARMOURED"}),
    (R.FASTENER, "HEXAGON BOLT M16 X 100 8.8 ZINC PLATED", {"item_type": "HEXAGON HEAD BOLT", "thread_size": "M16", "length_mm": 100.0, "property_class": "8.8", "finish": "ZINC PLATED"}),
    (R.FASTENER, "M16X100", {"thread_size": "M16", "length_mm": 100.0}), (R.FASTENER, "A4-80", {"property_class": "A4-80"}), (R.FASTENER, "LENGTH 80 MM", {"length_mm": 80.0}),
    (R.PIPE, "PIPE DN150 SCHEDULE 40 SEAMLESS ASTM A106 GRADE B", {"size": "DN150", "schedule": "SCH40", "manufacture": "SEAMLESS", "standard": "ASTM A106 GRADE B"}),
    (R.PIPE, "PIPE XXS", {"schedule": "XXS"}), (R.VALVE, "KSB PN16", {"oem": "KSB", "pressure_class": "PN16"}), (R.VALVE, "FLANGE", {"end_connection": "FLANGED"}),
    (R.UNKNOWN, "SS316", {"material": None}), (None, None, {"material": None}),
]


def test_extracted_values(spark):
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(CASES)], "i int, c string, t string")
    bags = {r.i: r.a for r in df.select("i", extract_attributes(F.col("t"), F.col("c")).alias("a")).collect()}
    for i, (category, text, expected) in enumerate(CASES):
        value = {k: (v.value_num if v.value_str is None else v.value_str) for k, v in bags[i].items()}
        assert {k: value.get(k) for k in expected} == expected, (category, text)
        for v in bags[i].values():
            assert (v.value_str is None) != (v.value_num is None)
            assert 0 < v.confidence <= 1 and v.method in ("rule", "derived") and v.source


def test_extra_attributes_fill_gaps_only(spark):
    one = lambda v, m: (v, None, "s", m, 0.9)
    df = spark.createDataFrame([({"a": one("x", "rule")}, {"a": one("y", "llm"), "b": one("z", "llm")}), ({"a": one("x", "rule")}, None)], f"f {BAG}, e {BAG}")
    found = [{k: v.value_str for k, v in r.o.items()} for r in df.select(fill_gaps(F.col("f"), F.col("e")).alias("o")).collect()]
    assert found == [{"a": "x", "b": "z"}, {"a": "x"}]
