"""Exact-substring, near-document and near-line operators against brute force, with the edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestitch.llm.line_dedup import remove_near_lines
from lodestitch.llm.ngram_join import similar_components, similar_pairs
from lodestitch.llm.suffix_dedup import bucket_pointers, remove_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# ---- suffix dedup -------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            k = b[p : p + 50]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_repeats(df, **how):
    n = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (a, b) -> a + b)")
    rows = remove_repeats(df, groups=5, **how).select("doc_id", "n_bytes", n, F.size("starts"), F.sha2("kept", 256)).collect()
    return sorted(tuple(r) for r in rows)


def repeat_rows():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = []
    for i in range(60):
        k = rng.randrange(5)
        if k == 0:
            t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))
        elif k == 1:
            a = rng.randint(0, 700)
            t = base[a : a + rng.randint(30, 200)]
        elif k == 2:
            x = list(base[:300])
            x[rng.randint(0, 299)] = "é"
            t = "".join(x)
        elif k == 3:
            t = "a" * rng.randint(0, 150)
        else:
            noise = "".join(rng.choice("abcdefghij klm") for _ in range(100))
            t = None if rng.random() < 0.3 else noise + base[100 : 160 + rng.randint(0, 30)]
        rows.append((i - 1 if i and i % 7 == 0 else i, t))  # some ids occur twice
    return rows


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    assert found_repeats(spark.createDataFrame(rows, DOC)) == brute_repeats(rows)


@pytest.mark.parametrize("crowd", [1, 16, 32])
def test_repeats_in_crowded_buckets(spark, crowd):
    # A passage between other words each time: its bucket falls into as many parts as there are documents.
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    passage = "a short passage that very many documents share word by word"
    rows = [(i, f"{word()} {word()} {passage[: rng.randint(28, 59)]} {word()} {word()}") for i in range(150)]
    rows += repeat_rows()
    assert found_repeats(spark.createDataFrame(rows, DOC), crowd=crowd) == brute_repeats(rows)


def test_bucket_pointers_are_equal_for_equal_windows_only():
    rng = random.Random(1)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    entries = []
    for _ in range(300):
        a = rng.randint(0, 300)
        e = bytearray(base[a : a + 49 + rng.randint(1, 26)])
        if rng.random() < 0.5:
            e[rng.randrange(len(e))] = rng.choice(b"abc")
        entries.append(b"a" * len(e) if rng.random() < 0.1 else bytes(e))
    count = np.array([len(e) - 49 for e in entries])
    found = bucket_pointers(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(count + 49) - count - 49, count)
    windows = [e[j : j + 50] for e in entries for j in range(len(e) - 49)]
    assert len(set(zip(found.tolist(), windows, strict=True))) == len(set(found.tolist())) == len(set(windows))


def test_repeats_of_a_text_longer_than_a_piece(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300_000))
    rows = [(1, long[140_000:140_200]), (2, long), (3, long[262_000:262_400])]
    assert found_repeats(spark.createDataFrame(rows, DOC)) == brute_repeats(rows)


def test_repeats_edges(spark):
    assert found_repeats(spark.createDataFrame([], DOC)) == []
    text = "x" * 10 + "0123456789" * 6
    df = spark.createDataFrame([(None, text, 1), (5, text, 2), (6, "", 3), (7, None, 4)], DOC + ", starts long")
    rows = {r.doc_id: r for r in remove_repeats(df, groups=3).collect()}
    assert bytes(rows[5].kept) == text.encode() and bytes(rows[None].kept) == b""
    assert rows[6].n_bytes == rows[7].n_bytes == 0 and rows[7].starts == []


# ---- n-gram join --------------------------------------------------------------------------


def brute_links(rows, percent=90, width=3):
    """Shingle sets of the rows and the places of linked rows."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set())
    return sets, [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if (both := len(sets[a] & sets[b])) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)
    ]


def brute_components(rows, percent=90, width=3):
    sets, links = brute_links(rows, percent, width)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        r = find(k)
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows)))


def similar_rows():
    rng = random.Random(5)
    v = [f"w{i}" for i in range(60)]
    base, rows = [rng.choice(v) for _ in range(150)], []
    for i in range(200):
        k = rng.randrange(4)
        if k == 0:
            t = [rng.choice(v) for _ in range(rng.randint(0, 12))]
        elif k == 1:
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(v) + "x" * rng.randrange(2)
        elif k == 2:
            t = base[: rng.randint(1, 6)] + base[20:40]
        else:
            t = base[50:100] + ([str(i)] if rng.random() < 0.5 else [])
            t = [x.upper() if rng.random() < 0.1 else x for x in t]
        rows.append((i, None if rng.random() < 0.03 else (" ", "\n", "\t ")[i % 3].join(t)))
    return rows


@pytest.mark.parametrize("block_bytes", [16 << 20, 4000])
def test_components_equal_brute_force(spark, block_bytes):
    rows = similar_rows()
    found = similar_components(spark.createDataFrame(rows, DOC), groups=5, block_bytes=block_bytes).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows)


def test_components_with_wider_shingles(spark):
    rows = similar_rows()
    found = similar_components(spark.createDataFrame(rows, DOC), groups=5, width=5, percent=80).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows, 80, 5)


@pytest.mark.parametrize("block_bytes", [16 << 20, 4000])
def test_link_counts_and_pairs_equal_brute_force(spark, block_bytes):
    rows = similar_rows()
    _, links = brute_links(rows)
    df = spark.createDataFrame(rows, DOC)
    found = similar_components(df, groups=5, block_bytes=block_bytes, links=True).collect()
    degree = Counter(i for pair in links for i in pair)
    assert {r.doc_id: r.n_links for r in found} == {i: degree[i] for i in range(len(rows))}
    pairs, members = similar_pairs(df, groups=5, block_bytes=block_bytes)
    of = {}
    for r in members.collect():
        of.setdefault(r.class_id, []).append(r.doc_id)
    listed = {(max(x, y), min(x, y)) for r in pairs.collect() for x in of[r.class_a] for y in of[r.class_b]}
    listed |= {(max(x, y), min(x, y)) for m in of.values() for x in m for y in m if x != y}
    assert listed == set(links)


def test_equal_ids_lose_no_link(spark):
    a, b = ([f"{c}{k}" for k in range(40)] for c in "ab")
    near = lambda t: " ".join([*t[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, near(a)), (3, near(b)), (7, " ".join(a))]
    found = similar_components(spark.createDataFrame(rows, DOC), groups=3, links=True).collect()
    assert sorted(tuple(r) for r in found) == [(2, 38, 2, 2), (3, 38, 3, 1), (5, 38, 2, 2), (5, 38, 3, 1), (7, 38, 2, 2)]


def test_components_edges(spark):
    assert similar_components(spark.createDataFrame([], DOC), groups=3).collect() == []
    rows = [(None, "a b c d"), (3, "a b c d"), (4, "A b c d"), (None, None), (5, " ")]
    found = similar_components(spark.createDataFrame(rows, DOC), groups=3).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(
        [(3, 2, 3), (4, 2, 3), (5, 0, 5), (None, 2, None), (None, 0, None)], key=str
    )


# ---- line dedup ---------------------------------------------------------------------------


def near(a, b):
    if a == b:
        return True
    if max(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(rows):
    lines = [
        (i, n, r, words(x)) for r, (i, t) in enumerate(rows) for n, x in enumerate(t.split("\n") if t else []) if words(x)
    ]
    gone = {}
    for x in lines:
        if any((y[0], y[1]) < (x[0], x[1]) and near(x[3], y[3]) for y in lines):
            gone.setdefault(x[2], set()).add(x[1])
    out = []
    for r, (i, t) in enumerate(rows):
        s = gone.get(r, set())
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in s), tuple(sorted(s))))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    v = ["a", "b", "c", "D", "é"]
    base, rows = [[rng.choice(v) for _ in range(rng.randint(1, 12))] for _ in range(15)], []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 5)):
            b, k = list(rng.choice(base)), rng.randrange(5)
            if k == 0:
                b[rng.randrange(len(b))] = str(rng.randrange(50))
            elif k == 1:
                del b[rng.randrange(len(b))]  # may leave a blank line, which is no line
            elif k == 2:
                b.insert(rng.randrange(len(b) + 1), rng.choice(v))
            elif k == 3:
                b = [str(rng.randrange(10**6)) for _ in b]
            lines.append(" ".join(b))
        rows.append((i // 2 if i < 20 else i, None if rng.random() < 0.05 else "\n".join(lines)))
    found = remove_near_lines(spark.createDataFrame(rows, DOC), groups=5).collect()
    assert sorted(((r.doc_id, r.text, tuple(r.removed_lines)) for r in found), key=str) == brute_lines(rows)


def test_short_lines_are_compared(spark):
    rows = [(1, "Menu\n\nhome page\nown"), (2, "MENU\n\nhome  page\nother"), (3, " \n\nmenu item")]
    found = {r.doc_id: r.text for r in remove_near_lines(spark.createDataFrame(rows, DOC), groups=3).collect()}
    assert found == {1: rows[0][1], 2: "\nother", 3: rows[2][1]}


def test_lines_edges_and_carried_columns(spark):
    assert remove_near_lines(spark.createDataFrame([], DOC), groups=3).collect() == []
    df = spark.createDataFrame([(None, "a b c d e", "x"), (3, "a b c d e", None), (4, None, "z")], DOC + ", n_lines string")
    found = {r.doc_id: r for r in remove_near_lines(df.withColumnRenamed("n_lines", "source"), groups=3, carry=("source",)).collect()}
    assert found[3].text == "a b c d e" and found[None].text == "" and found[None].source == "x"
    assert found[4].text is None and found[4].n_lines == 0
    assert "n_lines" in remove_near_lines(df, groups=3).columns  # a clashing column of the input is not read
