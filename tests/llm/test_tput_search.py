"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import pytest

from lodestitch.llm import tput_search as S

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, doc_id string"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by scoring every document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in bags:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def held(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS).repartition(3)
    found = S.search(d, spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS), **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(rng, n, words):
    pick = lambda m: " ".join(rng.choice(words[: rng.choice([5, 30, len(words)])]) for _ in range(m))
    return [(i, pick(rng.choice([1, 4, 20, 60]))) for i in range(n)], [(i, pick(rng.choice([1, 3, 12]))) for i in range(8)]


@pytest.mark.parametrize("most_terms", [S.MOST_TERMS, 0])
def test_equals_scores_of_all_documents(spark, most_terms):
    rng = random.Random(3)
    docs, items = corpus(rng, 300, [f"W{i}x" for i in range(200)])
    docs += [(1000 + i, docs[7][1]) for i in range(25)] + [(2000 + i, items[2][1] + " tail") for i in range(3)]
    assert held(spark, docs, items, most_terms=most_terms) == brute(docs, items)


def test_small_sides_may_also_be_shuffled(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_SENT", 0)
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    rng = random.Random(4)
    docs, items = corpus(rng, 120, [f"w{i}" for i in range(60)])
    assert held(spark, docs, items, k=3) == brute(docs, items, 3)


def test_letters_nulls_and_repeats(spark):
    docs = [
        (1, "Straße café-CAFÉ x_y 10.5"), (2, None), (3, ""), (4, "... --"), (5, "CAFÉ straße"), (None, "café 10"), (7, "éÉ 中文 5"),
        (8, "word " * 5000), (8, "word " * 5000), (9, "10 5"),
    ]
    items = [(1, "café CAFé straße"), (1, "café CAFé straße"), (None, "10 word"), (3, None), (4, ""), (5, "absent"), (6, "中文"), (7, "x y 5")]
    assert held(spark, docs, items) == brute(docs, items)
    assert held(spark, [], items) == [] and held(spark, docs, []) == [] and held(spark, [(1, None)], [(1, "a")]) == []


def test_ties_beyond_k_go_by_id(spark):
    docs = [(i, "same text here") for i in range(200, 0, -1)] + [(0, "other words")]
    found = held(spark, docs, [(1, "text here")], k=4)
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == [1, 2, 3, 4]


def test_frequent_words_stay_closed(spark):
    """A query with a rare match opens no list of a word that all documents hold."""
    docs = [(i, f"the of and filler{i % 50} common{i % 3}") for i in range(2000)] + [(3000 + i, f"the rare{i} gem{i} of jewel") for i in range(30)]
    items = [(1, "the rare3 gem3 of and jewel")]
    assert held(spark, docs, items, k=1) == brute(docs, items, 1)
