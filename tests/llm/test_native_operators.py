"""Host reputation, quality rules, quotation linking, sharding."""

import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestitch.llm import quality_rules as Q
from lodestitch.llm.queries import URL_RULES
from lodestitch.llm.quote_linking import link_quotes
from lodestitch.llm.ring_sharding import clockwise_preferences, lay_out, shard_rows
from lodestitch.llm.url_reputation import beta_mass_below, judge_urls

DOC = "doc_id long, text string, lang string"


# ---- urls ---------------------------------------------------------------------------------


def test_rules_and_parts_of_urls(spark):
    urls = {
        1: ("https://Www.Example.COM/en/7?x=/de", "www.example.com", "/en/7", "example.com/en/7", "allow"),
        2: ("http://a.com/en/1#/x", "a.com", "/en/1", "com/en/", "block"),
        3: ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
        4: ("http://x.example.net/de/9", "x.example.net", "/de/9", "net/de/", "allow"),
        5: ("no scheme", "", "", None, None),
        6: (None, "", "", None, None),
        7: ("http://notcom/en/", "notcom", "/en/", None, None),
        8: ("http://h.org?q=://z/y", "h.org", "", None, None),
        9: ("http://Ä.org:80/es/1", "Ä.org:80", "/es/1", None, None),
    }
    pages = spark.createDataFrame([(k, v[0], "clash") for k, v in urls.items()], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in judge_urls(pages, labels, URL_RULES).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == verdict if verdict else found[k].verdict in ("allow", "block")
    assert judge_urls(pages.limit(0), labels, URL_RULES).collect() == []


def test_bad_hosts_are_blocked_and_new_ones_follow_their_domain(spark):
    rng, pages, labels = random.Random(2), [], []
    for i in range(900):
        bad = i % 3 == 0
        host = f"h{i % 5}.bad.net" if bad else f"h{i % 7}.good{i % 4}.org"
        pages.append((i, f"http://{host}/p{i}"))
        labels.append((i, int(rng.random() < (0.1 if bad else 0.95))))
    pages += [(10_000, "http://new.bad.net/"), (10_001, "http://new.good1.org/")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    found = {r.page_id: r.verdict for r in judge_urls(p, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert found[0] == "block" and found[1] == "allow"
    assert found[10_000] == "block" and found[10_001] == "allow"


# ---- quality ------------------------------------------------------------------------------


@pytest.mark.parametrize("x", [0.1, 0.5, 0.8])
@pytest.mark.parametrize("a, b", [(1, 1), (3, 1), (1, 4), (0.3, 0.7), (2.5, 7.25), (40, 60.5), (900, 150), (20, 4000), (0.02, 30)])
def test_mass_of_the_beta_posterior(a, b, x):
    below = beta_mass_below(x, a, b)
    assert below + beta_mass_below(1 - x, b, a) == pytest.approx(1, abs=1e-9)
    if b == 1:
        assert below == pytest.approx(x**a, rel=1e-9)
    if a == 1:
        assert below == pytest.approx(1 - (1 - x) ** b, rel=1e-9)
    if a >= 1 and b >= 1:  # a fine trapezium rule of the density
        t = np.linspace(0, x, 400_001)[1:]
        log = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        assert below == pytest.approx(float(np.trapezoid(np.exp(log), t)), abs=1e-4)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def quality_texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one", "é ü\x0bß", "a b c d e f g h", "a " * 30, "x\ny\nx\n\nx", "line #1\n" * 3]
    for _ in range(60):
        v = rng.choice([3, 30, 500])
        t = [rng.choice("abcdé#$") * rng.randint(1, 3) + str(rng.randrange(v)) for _ in range(rng.randint(0, 120))]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t"]) for w in t) + (" " + " ".join(t) if rng.random() < 0.3 else ""))
    return out


def test_counts_equal_brute_force(spark):
    texts = quality_texts()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {r.doc_id: r for r in Q.quality_rules(df, labels).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_counts(t)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and r.kept == (not r.base_failed)


def brute_cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_cutoffs_are_the_strictest_that_the_exact_test_allows(spark):
    rng, rows = random.Random(6), []
    for i in range(3000):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        dirty = rng.random() < 0.004
        rows.append((i, " ".join(w + "##" * dirty for w in words), "en" if i % 3 else "xx"))
    junk = [(5000 + i, " ".join(f"w{rng.randrange(10**6)}###" for _ in range(40)), "en") for i in range(50)]
    df = spark.createDataFrame(rows + junk, DOC)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows] + [(5000, 0), (None, 1), (1, None)], "doc_id long, quality int")
    found = Q.quality_rules(df, labels, alpha=0.08, delta=0.05).collect()
    counts = {}
    for r in found:
        if r.doc_id < 5000:
            counts.setdefault(rows[r.doc_id][2], []).append(r.n_symbols / r.n_words)
    cut = {}
    for lang, values in counts.items():
        ok = [c for c in Q.CUTOFFS["symbol_ratio"] if brute_cdf(sum(v > c for v in values), len(values), 0.02) <= 0.05 / 8]
        cut[lang] = min(ok) if ok else None
    assert cut["en"] is not None
    for r in found:
        lang = rows[r.doc_id][2] if r.doc_id < 5000 else "en"
        symbols = cut[lang] is not None and r.n_symbols / r.n_words > cut[lang]
        assert ("symbol_ratio" in r.failed_rules.split(",")) == symbols
    good = [r for r in found if r.doc_id < 5000]
    assert sum(not r.kept for r in good) <= 0.08 * len(good) and not any(r.kept for r in found if r.doc_id >= 5000)
    same = {r.doc_id for r in Q.keep_good_documents(df, labels, alpha=0.08, delta=0.05).collect()}
    assert same == {r.doc_id for r in found if r.kept}
    wide = {r.doc_id for r in Q.quality_rules(df, labels, alpha=0.08, delta=0.05, most_strata=0).where("kept").collect()}
    assert wide == same


def test_joint_cutoffs_need_few_labels(spark):
    rng = random.Random(8)
    text = lambda end: " ".join(f"w{rng.randrange(10**6)}{end}" for _ in range(25))
    rows = [(i, text(""), "abcd"[i % 4]) for i in range(900)] + [(900 + i, text("####"), "abcd"[i % 4]) for i in range(8)]
    rows += [(950 + i, text(""), "e") for i in range(5)] + [(960, text("####"), "e")]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i < 900)) for i in range(908)], "doc_id long, quality int")
    assert Q.keep_good_documents(df, labels).count() == len(rows)
    kept = Q.keep_good_documents(df, labels, joint=True)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - set(range(900, 908))
    assert Q.quality_rules(df, labels, joint=True).where("kept").count() == kept.count()
    few = labels.where("doc_id < 800 or doc_id >= 900")
    assert Q.keep_good_documents(df, few, joint=True).count() == len(rows)


def test_a_repeated_or_contradicted_label_counts_once(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(25)), "en") for i in range(20)], schema)
    once = [(i, 1) for i in range(20)]
    for labels in (once, once * 100, once + [(i, 0) for i in range(20)], [(i, None) for i in range(20)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int")
        measured = Q.measure(docs, id_col="doc_id", text_col="text", stratum_col="lang")
        assert Q._cutoff_table(measured, table, "doc_id", "quality", 0.02, 0.05, True).count() == 0
        assert Q.keep_good_documents(docs.withColumn("labelled_id", F.lit(1)), table).count() == 20


def test_quality_of_nothing(spark):
    df, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(df, labels).collect() == [] and Q.keep_good_documents(df, labels).columns == df.columns


# ---- quotations ---------------------------------------------------------------------------

TALK = "conv_id long, turn long, role string, text string"


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."),
        (1, 1, "assistant", "Mix flour and water.\n\nThen bake it."),
        (1, 2, "user", "unrelated remark"),
        (1, 3, "assistant", "On Monday, X wrote:\n> Then  bake it.\nAt 200 degrees."),
        (1, 4, "user", "> At 200 degrees.\n>> Then bake it.\n\nThanks!"),
        (1, 5, "assistant", "> never said before\nok"),
        (2, 0, "user", "> How do I bake bread?\nother talk"),
        (3, None, None, None),
        (None, 1, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], TALK + ", depth int")
    ordered = link_quotes(df).collect()
    found = {(r.conv_id, r.turn): r for r in ordered}
    assert found[1, 3].parent_turn == 1 and found[1, 3].content == "At 200 degrees."
    assert found[1, 4].parent_turn == 3 and found[1, 4].reply_path == [1, 3, 4] and found[1, 4].content == "Thanks!"
    assert found[1, 4].n_quotes == 2 and found[1, 5].parent_turn is None and found[1, 5].content == "ok"
    assert found[2, 0].parent_turn is None and found[3, None].content == ""
    assert [r.turn for r in ordered if r.conv_id == 1] == [0, 1, 3, 4, 2, 5]
    assert found[1, 0].formatted == "<|user|>\nHow do I bake bread?\nI have flour."
    assert link_quotes(df.limit(0)).collect() == []


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "start here")] + [(1, i, "u", f"> {'start here' if i == 1 else f'answer {i - 1}'}\nanswer {i}") for i in range(1, 40)]
    found = {r.turn: r for r in link_quotes(spark.createDataFrame(rows + rows[:1], TALK)).collect()}
    assert found[39].depth == 39 and found[39].reply_path == list(range(40)) and found[39].content == "answer 39"


def test_a_repeated_message_that_quotes(spark):
    rows = [(1, 0, "a", "First thought.\nSecond thought."), (1, 1, "b", "other"), (1, 2, "b", "X wrote:\n> First thought.\n> Second thought.\nI agree.\nBye.")]
    once = [r for r in link_quotes(spark.createDataFrame(rows, TALK)).collect() if r.turn == 2]
    twice = [r for r in link_quotes(spark.createDataFrame(rows + rows, TALK)).collect() if r.turn == 2]
    assert twice == once * 2 and once[0].parent_turn == 0 and once[0].n_quotes == 1 and once[0].content == "I agree.\nBye."


# ---- shards -------------------------------------------------------------------------------


def brute_quotes(rows):
    """(conv, turn, role, text) -> parent turn, path, content of each distinct message."""
    squeeze = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    said = re.compile(r"^.{0,200}\b(?:wrote|said)\s*:\s*$", re.I)
    read = {}
    for row in set(rows):
        lines = []
        raw = (row[3] or "").split("\n")
        levels = [(re.match(r"^(?:[ \t]{0,3}>)+", x) or [""])[0].count(">") for x in raw]
        for k, x in enumerate(raw):
            body = re.sub(r"^(?:[ \t]{0,3}>)+[ \t]?", "", x)
            if not (levels[k] == 0 and k + 1 < len(raw) and levels[k + 1] > 0 and said.match(body)):
                lines.append((levels[k], body))
        read[row] = [(level, "\n".join(b for _, b in run)) for level, run in groupby(lines, key=lambda x: x[0])]
    keys = lambda b: {squeeze(x) for x in [b, *re.split(r"\n[ \t]*\n", b), *b.split("\n")]} - {""}
    first = {}
    for (c, t, *_), passages in read.items():
        for level, b in passages:
            for k in keys(b) if level == 0 and None not in (c, t) else ():
                first[c, k] = min(first.get((c, k), t), t)
    parent = {}
    for row, passages in read.items():
        c, t, *_ = row
        score = {}
        for level, b in passages:
            for k in keys(b) if level else ():
                if t is not None and first.get((c, k), t) < t:
                    low, chars = score.get(first[c, k], (99, 0))
                    score[first[c, k]] = (min(low, level), chars + len(k))
        if score:
            parent[row] = min((low, -chars, s) for s, (low, chars) in score.items())[2]
    hop = {}
    for (c, t, *_), up in parent.items():
        hop[c, t] = min(hop.get((c, t), up), up)

    def path(c, t):
        return [*path(c, hop[c, t]), t] if (c, t) in hop else [t]

    out = {}
    for row, passages in read.items():
        quoted = any(level for level, _ in passages)
        text = "\n".join(b for level, b in passages if not level) if quoted else row[3] or ""
        out[row] = (parent.get(row), path(*row[:2]) if row in parent else [row[1]], text.strip())
    return out


def test_quotes_equal_brute_force(spark):
    rng = random.Random(6)
    v = ["One line here", "two  words", "Three", "a longer line of some words", ""]
    rows = []
    for i in range(160):
        c, t = rng.choice([1, 2, 3, None]), rng.choice([None, *range(12)])
        lines = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.4:
                lines += (["Ann wrote:"] if rng.random() < 0.5 else []) + [rng.choice(["> ", ">> ", ">"]) + rng.choice(v) for _ in range(rng.randint(1, 3))]
            else:
                lines.append(rng.choice(v))
        rows.append((c, t, rng.choice(["user", None]), None if rng.random() < 0.05 else "\n".join(lines)))
    rows += rows[:30]
    expected = brute_quotes(rows)
    found = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    got = Counter((r.conv_id, r.turn, r.role, r.parent_turn, tuple(r.reply_path), r.content) for r in found)
    assert got == Counter((*row[:3], expected[row][0], tuple(expected[row][1]), expected[row][2]) for row in rows)


def brute_ring(cells, preferences, shards):
    """Row by row: hop after hop, in ring order, each row takes the next shard that has room."""
    n = len(cells)
    room, load, at = [n // shards + (s < n % shards) for s in range(shards)], [0] * shards, [None] * n
    order = sorted(range(n), key=lambda i: cells[i])
    for hop in range(shards):
        for i in order:
            s = preferences[cells[i]][hop]
            if at[i] is None and load[s] < room[s]:
                at[i], load[s] = s, load[s] + 1
    return at


def test_layout_equals_row_by_row_insertion():
    rng = random.Random(8)
    preferences = clockwise_preferences(5, 6, 64)
    cells = sorted(rng.randrange(64) if rng.random() < 0.7 else 7 for _ in range(400))
    segments = lay_out({c: cells.count(c) for c in set(cells)}, preferences, 5)
    expected, got, seen = brute_ring(cells, preferences, 5), {}, {}
    for i, c in enumerate(cells):
        rank = seen[c] = seen.get(c, -1) + 1
        got[i] = next(s for cell, a, b, s, _ in segments if cell == c and a <= rank < b)
    assert [got[i] for i in range(len(cells))] == expected


def test_shards_are_balanced_and_slots_have_no_gaps(spark):
    rows = [(i if i % 50 else None, None if i % 9 == 0 else f"text {i % 40} é") for i in range(1003)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    found = shard_rows(df, 24).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(found) == len(rows) and set(by) == set(range(24))
    assert {len(v) for v in by.values()} == {41, 42} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.size for r in found if r.text_crc32 == 0} == {8} and {r.law for r in found} == {"rows"}
    assert shard_rows(df.limit(0), 24).collect() == []


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r.doc_id: r.shard for r in shard_rows(df, 24).collect()}
    b = {r.doc_id: r.shard for r in shard_rows(df, 25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.1 * len(a)  # 4 % is the least; modulo placement would move 96 %


def test_shards_equal_row_by_row_insertion(spark):
    """The whole Spark job: hot ids, equal rows, nulls; rows equal in all that is returned are alike."""
    import zlib
    from hashlib import md5

    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.3 else rng.randrange(300), f"t{rng.randrange(4)}") for _ in range(700)] + [(None, "x"), (None, None), (9, None)]
    keyed = []
    for i, t in rows:
        b = (t or "").encode()
        place = str(i) if i is not None else "text-" + md5(b).hexdigest()
        keyed.append((int(md5(place.encode()).hexdigest()[:13], 16), i is None, i or 0, zlib.crc32(b), len(b) + 8))
    keyed.sort()
    shards = brute_ring([k[0] // (16**13 // 64) for k in keyed], clockwise_preferences(5, 8, 64), 5)
    expected = Counter((None if k[1] else k[2], k[4], k[3], s) for k, s in zip(keyed, shards, strict=True))
    found = shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, virtual_nodes=8, cells=64).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in found) == expected


@pytest.mark.parametrize("shards", [1, 3])
def test_fewer_rows_than_shards(spark, shards):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert shard_rows(df, shards).count() == 1


def test_the_mass_of_a_host_with_very_many_labels_takes_no_memory():
    for n in (10**6, 10**8):
        spread = 1 / (2 * math.sqrt(2 * n))
        for z in (-2.0, 0.0, 0.5, 3.0):
            # Close to a normal distribution around 1/2.
            found = beta_mass_below(0.5 + z * spread, n, n)
            assert found == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-3)
