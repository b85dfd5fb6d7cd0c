"""Search through trigrams gives what the scan gives."""

import random

import pytest
from pyspark.sql import functions as F

from lodestitch.operators import reports
from lodestitch.operators import substring as S

SCHEMA = "id long, a string, b string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcxyÄé%_0") for _ in range(rng.choice([1, 3, 6])))
    data = [(i, " ".join(word() for _ in range(4)), rng.choice([None, word().upper(), ""])) for i in range(300)]
    data += [(400, None, None), (401, "100% Stahl_Rohr", "x"), (402, "STRASSE straße İstanbul", None), (None, "abc abc", "abc"), (401, "Rohr", "stahl_rohr")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("pattern", ["abc", "ABC", "Äéx", "b%c", "a_c", "abx%yÄ", "Stahl\\_Rohr", "100\\% s", "straße", "zzzzz", "ab", "%", None, "", "İst"])
def test_equals_the_scan(rows, pattern):
    index = S.build_grams(rows, "id", "a", "b") if not hasattr(test_equals_the_scan, "index") else test_equals_the_scan.index
    test_equals_the_scan.index = index
    scan = rows.where(S.contains_any(pattern, "a", "b"))
    listed = scan.where("id is not null") if pattern and S.candidate_ids(index, pattern) is not None else scan
    assert sorted(map(str, S.find_rows(rows, index, pattern).collect())) == sorted(map(str, listed.collect()))


def test_parts_between_wildcards():
    assert S.literal_parts("ab%c_d\\%e") == ["ab", "c", "d%e"] and S.literal_parts("%%") == [] and S.literal_parts("a\\") == ["a\\"]


def test_only_rows_with_the_trigrams_are_checked(spark):
    rows = spark.range(2000).select("id", F.format_string("part %05d", "id").alias("a"), F.lit(None).cast("string").alias("b"))
    index = S.build_grams(rows, "id", "a", "b")
    assert S.candidate_ids(index, "part 01234").count() <= 3
    assert [r.id for r in S.find_rows(rows, index, "t 01234").collect()] == [1234]
    assert S.build_grams(rows.limit(0), "id", "a").postings.count() == 0


def test_listings_take_an_index(spark):
    view = spark.createDataFrame([(i, f"ball bearing {i}", None, f"C{i}", None, "X", "bearing", None, float(i)) for i in range(30)],
        "id long, raw_text string, norm_text string, local_code string, entity_id string, source_org string, category string, review_status string, match_score double")
    index = S.build_grams(view, "id", *reports.SEARCHED)
    for search in ("bearing 1", "c2", None):
        plain = [[tuple(r) for r in df.collect()] for df in reports.list_materials(view, search=search, limit=5)]
        assert plain == [[tuple(r) for r in df.collect()] for df in reports.list_materials(view, search=search, limit=5, grams=index)]
    assert [r.id for r in reports.list_materials(view, search="BEARING 17", grams=index)[0].collect()] == [17]


def test_texts_that_repeat_are_cut_once(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("ball bearing of kind "), (F.col("id") % 5).cast("string")).alias("a"), F.format_string("C%05d", "id").alias("b"))
    index = S.build_grams(rows, "id", "a", "b")
    assert index.shared.count() < 200 and index.postings.count() == 4 * 2000 and index.holders.count() == 2000
    assert S.candidate_ids(index, "kind 3").count() == 400 and S.find_rows(rows, index, "c0123").count() == 10
