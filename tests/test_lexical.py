"""BM25 with upper bounds gives what scoring every pair gives, and opens no list that can't matter."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestitch.operators import lexical as L
from lodestitch.plans.materialize import stored

SCHEMA = "id long, category string, tokens array<string>"


def records(rng, n, words, kinds=("a", None), start=0):
    """Zipf-like records; the first word is in every one."""
    pick = lambda: words[min(int(len(words) * rng.random() ** 3), len(words) - 1)]
    return [(start + i, rng.choice(kinds), [words[0]] + [pick() for _ in range(rng.choice([0, 1, 5, 30]))]) for i in range(n)]


def best(rows):
    return sorted((r[0], r[1], round(r[2], 5)) for r in rows)


def plainly(queries, corpus, k):
    scores = L.every_score(queries, corpus)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.floor(F.col("raw") * L.TIES + 0.5)), "cand_id")
    return best(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank").collect())


@pytest.mark.parametrize(("seed", "k", "blocks"), [(1, 1, 1024), (2, 5, 8)])
def test_equals_every_pair(spark, monkeypatch, seed, k, blocks):
    monkeypatch.setattr(L, "BLOCK_RECORDS", blocks)
    monkeypatch.setattr(L, "MOST_SENT", L.MOST_SENT if k == 1 else 0)
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)]
    corpus = spark.createDataFrame(records(rng, 250, words), SCHEMA)
    queries = spark.createDataFrame(records(rng, 40, [*words, "ABSENT"], start=1000) + [(2000, "a", []), (2001, "none", ["W1"])], SCHEMA)
    found = L.search_index(queries, L.build_index(corpus), k)
    assert best(found.drop("rank").collect()) == plainly(queries, corpus, k)
    with pytest.raises(ValueError, match="deep"):
        L.search_index(queries, L.build_index(corpus, depth=k - 1), k)
    top = {(q, c): s for q, c, s in plainly(queries, corpus, k)}
    peak = {}
    for (q, _), s in top.items():
        peak[q] = max(s, peak.get(q, 0))
    shares = {(r.query_id, r.cand_id): r.lexical for r in L.bm25_top_k(queries, corpus, k).collect()}
    assert shares == {key: pytest.approx(s / peak[key[0]], abs=1e-4) for key, s in top.items()}


def test_tiny_categories_have_negative_weights(spark):
    rows = [(1, "a", ["X", "Y"]), (2, "a", ["X", "Y", "Y"]), (3, "b", ["X"]), (4, "c", ["P", "Q"]), (5, "c", ["P", "R", "S", "T", "U"]), (6, "c", ["P", "P", "V"])]
    corpus = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 2, 9):
        assert best(L.search_index(corpus, L.build_index(corpus), k).drop("rank").collect()) == plainly(corpus, corpus, k)


def test_pairs_are_scored_against_the_best_of_their_query(spark):
    rng = random.Random(9)
    corpus = spark.createDataFrame(records(rng, 80, [f"W{i}" for i in range(25)]), SCHEMA)
    wanted = [(i, (7 * i) % 80) for i in range(60)] + [(3, 3), (3, 3)]
    found = L.pair_lexical(spark.createDataFrame(wanted, "a long, b long"), corpus).collect()
    scores = {(r.query_id, r.cand_id): r.raw for r in L.every_score(corpus, corpus).collect()}
    peak = {}
    for (q, _), s in scores.items():
        peak[q] = max(s, peak.get(q, 0))
    assert len(found) == len(wanted)
    for r in found:
        assert r.lexical == pytest.approx(scores[r.a, r.b] / peak[r.a] if (r.a, r.b) in scores else 0.0, abs=1e-9)


def test_work_per_query_does_not_grow_with_a_term_of_all_records(spark):
    """Ten times the records with the common term: as many candidates per query, none by the common term alone.

    One class of four records holds each query's rare term, so it fills the three places."""
    pairs = []
    for n in (300, 3000):
        rows = [(i, None, ["ALL", "SOME" if i % 2 else "OTHER", f"RARE{i % (n // 4)}"]) for i in range(n)]
        corpus = spark.createDataFrame(rows, SCHEMA)
        queries = corpus.where("id < 20")
        asked = stored(L.asked_terms(L.tagged(queries)))
        index = L.build_index(corpus)
        found = L.candidates(asked, index, 3).groupBy("query_id").count().collect()
        assert len(found) == 20
        pairs.append(max(r["count"] for r in found))
        assert best(L.search_index(queries, index, 3).drop("rank").collect()) == plainly(queries, corpus, 3)
    assert pairs[1] <= pairs[0] <= 2


def test_copies_cost_a_place_only(spark):
    """A third of all records are copies of one text, shuffled; the candidates of a search are classes."""
    rows = [(i, "a", ["A", "B", "C", "B"] if i % 2 else ["B", "C", "B", "A"]) for i in range(100, 0, -1)]
    rows += [(200 + i, "a", ["A", f"X{i % 50}", "B"]) for i in range(200)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    queries = L.tagged(corpus)
    asked, index = stored(L.asked_terms(queries)), L.build_index(corpus)
    assert L.class_of(queries).select("class").distinct().count() == 51
    assert L.candidates(asked, index, 4).count() <= 51 * 51
    assert best(L.search_index(corpus, index, 4).drop("rank").collect()) == plainly(corpus, corpus, 4)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", ["X"]), (2, "a", None)], SCHEMA)
    for q, c in ((none, one), (one, none), (none, none)):
        assert L.bm25_top_k(q, c).collect() == []


def test_many_queries_are_dealt_to_tasks(spark, monkeypatch):
    rows = [(i, "c", [f"T{i % 7}", f"U{i % 11}", "ALL", f"X{i}"]) for i in range(300)]
    records = spark.createDataFrame(rows, "id long, category string, tokens array<string>")
    index = L.build_index(records, depth=5)
    # As many files as the session has cores, however few the rows are.
    assert len(index.postings.inputFiles()) >= 4
    plain = sorted((r.query_id, r.cand_id, r.rank, round(r.raw, 9)) for r in L.search_index(records, index, 5).collect())
    monkeypatch.setattr(L, "MANY", 10)
    monkeypatch.setattr(L, "TASK_HITS", 100)
    assert plain == sorted((r.query_id, r.cand_id, r.rank, round(r.raw, 9)) for r in L.search_index(records, index, 5).collect())
