"""Golden values of category detection, normalization and tokens, each module as one small job."""

import re

import pytest
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.text import ascii_tokens, detect_category, normalize, number_text, rule_trace, sizes_canonical, tokenize
from lodestitch.plans import queries as Q

CATEGORY = {
    "GATE VALVE 6 IN CL150": R.VALVE, "GATE, VALVE, 6 IN": R.VALVE, "gt vlv 4in": R.VALVE, "GATE V/V 150 NB": R.VALVE,
    "SEAMLESS PIPE 6 IN SCH 40": R.PIPE, "BRG 6205-2RS": R.BEARING, "CABLE 3C X 95 SQMM": R.CABLE, "HEX BOLT M16 X 100": R.FASTENER,
    "GATE VALEV 6 IN": R.VALVE, "BEARLNG 25": R.BEARING, "CABEL 3": R.CABLE, "VALEV 6": R.UNKNOWN, "PAINT RED 5L": R.UNKNOWN, "": R.UNKNOWN,
    None: R.UNKNOWN, "M16X100": R.FASTENER, "NU210": R.BEARING,
}
TEXTS = [
    *[(t, R.VALVE, "DN150") for t in ('6"', "6 IN", "6 INCH", "150 MM", "150MM", "DN150", "150 NB", "DN 150")],
    *[(f'{a}"', R.PIPE, f"DN{n}") for a, n in (("1/2", 15), ("3/4", 20), ("1", 25), ("1-1/2", 40), ("2", 50), ("4", 100), ("8", 200), ("12", 300))],
    *[("150MM", c, "150MM") for c in (R.BEARING, R.CABLE, R.FASTENER, R.UNKNOWN)],
    ("137 MM", R.VALVE, "137 MM"), ("PN20", R.VALVE, "PN20"), ("CL150", R.VALVE, "CL150"), ("7\"", R.VALVE, '7"'), ("1/0 IN", R.PIPE, "1 0 IN"),
    ("VLV GT", R.VALVE, "VALVE GATE"), ("CS FLGD", R.VALVE, "CARBON STEEL FLANGED"), ("SMLS", R.PIPE, "SEAMLESS"), ("SS316 CSX100", R.VALVE, "SS316 CSX100"),
    ("3 C", R.CABLE, "3 CORE"), ("3 C", R.VALVE, "3 C"), ("HD SCR", R.FASTENER, "HEAD SCREW"), ("HD SCR", R.PIPE, "HD SCR"), ("  a,b;(c)  ", None, "A B C"),
    ("6”", R.VALVE, "DN150"), (None, R.VALVE, ""), ("", None, ""),
]


def test_categories(spark):
    rows = list(CATEGORY.items())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    found = {r.i: r.c for r in df.select("i", detect_category(F.col("t")).alias("c")).collect()}
    assert {rows[i][0]: c for i, c in found.items()} == CATEGORY


def test_normalized_texts(spark):
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(TEXTS)], "i int, t string, c string")
    found = {r.i: r.n for r in df.select("i", normalize(F.col("t"), F.col("c")).alias("n")).collect()}
    assert [(TEXTS[i][0], TEXTS[i][1], found[i]) for i in range(len(TEXTS))] == TEXTS


def test_no_expansion_holds_another_abbreviation():
    held = {k for e in R.ABBREVIATIONS.values() for k in R.ABBREVIATIONS if k in e.split()}
    assert not held


def test_sizes_in_spelled_fractions(spark):
    df = spark.createDataFrame([('1-1/2"',), ("1/2 IN",), ('0.75"',), ('6.0"',)], "t string")
    found = [r.n for r in df.select(sizes_canonical(F.col("t"), F.lit(R.PIPE)).alias("n")).collect()]
    assert found == ["DN40", "DN15", "DN20", "DN150"]


def test_trace_tokens_and_numbers(spark):
    df = spark.createDataFrame([('PIPE SMLS 1-1/2" SCH 40',)], "t string")
    row = df.select(rule_trace(F.col("t"), F.lit(R.PIPE)).alias("t"), tokenize(F.lit("a-1/b.2 #c")).alias("k")).first()
    assert row.t == ["fraction:1-1/2->1.5", 'dim:inch:1.5"->DN40', "abbrev:SMLS->SEAMLESS", "abbrev:SCH->SCHEDULE"]
    assert row.k == ["A-1", "B.2", "#C"]
    values = [1.0, 1.5, 0.333333333, 11.0, 6.6, 0.65, 132.0, 100000.0, 12345.678]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(number_text(F.col("v")).alias("t")).collect()] == [f"{v:g}" for v in values]


@pytest.mark.parametrize("category", R.CATEGORIES)
def test_every_category_is_complete(category):
    assert set(R.CRITICAL[category]) <= set(R.SCHEMAS[category]) and set(R.DESCRIPTION_KEYS[category]) <= set(R.SCHEMAS[category])
    assert set(R.WEIGHTS[category][3]) == set(R.SCHEMAS[category]) and category in R.CATEGORY_CODES


def test_ascii_tokens_are_those_of_a_text_with_spaces_for_the_rest(spark):
    """Also of what upper case makes ASCII (the dotless i, the long s, the sharp s); and a document counts once for a term, however many rows it has."""
    texts = ["a-1/b.2 #c", "ı ſ ß straße Köln x", "", " ,; ", None, "a\tB\nc D😀e", "x" * 3 + "-.#"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: None if t is None else [x for x in re.split(r"[^A-Z0-9.\-#]+", re.sub("[^ -~]", " ", t).upper()) if x]
    assert [r.k for r in df.select(ascii_tokens(F.col("t")).alias("k")).collect()] == [plain(t) for t in texts]


def test_terms_are_counted_where_their_document_is(spark, tmp_path):
    """Rows of one document are counted as one, documents without a number not at all, and no row of (term, document) is shuffled."""
    rows = [(1, "a b a"), (1, "a c"), (2, "A"), (None, "b"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = Q.tokenize_counts(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("A", 4, 2), ("B", 2, 1), ("C", 1, 1)]
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not [line for line in exchanges if "term" in line and "doc_id" in line]
