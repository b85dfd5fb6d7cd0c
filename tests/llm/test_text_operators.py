"""Tokenizer, page extraction, decontamination."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestitch.llm.byte_bpe import BytePairCodec, encode_documents, read_ranks
from lodestitch.llm.html_consensus import best_container, blocks, extract_main_text, main_text
from lodestitch.llm.template_decontam import NUMBER_WORDS, UNIT_WORDS, find_contamination, keep_clean_documents

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def codec():
    return BytePairCodec(read_ranks(VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_codec():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})


def test_tokens_equal_the_merges_on_random_texts(codec, reference_codec):
    rng = random.Random(1)
    alphabets = ["aehtnr s", "abcdefghijklmnopqrstuvwxyz", "éèàüößñ çaeiou", "0123456789.,", " \n\tab", "日本語中文한국어", "😀😁‍🏽a "]
    for k in range(4000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60)))
        if k % 10 == 0:
            text = "".join(rng.choice(alphabets[k % 7]) for _ in range(400)).replace(" ", "")
        ids = codec.encode(text)
        assert ids == reference_codec.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_tokens_of_a_very_long_piece_take_linear_time(codec, reference_codec):
    text = "ab" * 50_000
    assert codec.encode(text) == reference_codec.encode_ordinary(text)


def test_documents_are_encoded_whole(spark, reference_codec):
    rows = [(1, "Hello, wörld!\n\n  x"), (2, ""), (3, None), (None, "a"), (1, "again")]
    df = spark.createDataFrame([(*r, 7) for r in rows], DOC + ", n_tokens int")
    found = encode_documents(df, VOCABULARY, public_tokenizers.PATTERN, with_ids=True).collect()
    expected = []
    for i, t in rows:
        ids = np.array(reference_codec.encode_ordinary(t or ""), "<u4")
        digest = hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
        expected.append((i, len(ids), *digest, ids.tolist()))
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)
    assert encode_documents(spark.createDataFrame([], DOC), VOCABULARY, public_tokenizers.PATTERN).collect() == []


# ---- pages --------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href='/a'>A</a></li></ul></nav><div class='ad'>Buy</div>{body}<footer>&copy; 2020</footer>"
)
ARTICLE = "<article><h1>Title &amp; more</h1><p>One\n&nbsp; two <b>x</b>y.<div class='cookie-notice'>ok?</div><p>Three<ul><li>a<li>b</ul><section id=comments><p>me</section></article>"


def test_article_without_its_surroundings():
    assert main_text(PAGE.replace("{body}", ARTICLE), []) == "Title & more\nOne two xy.\nThree\na\nb"


@pytest.mark.parametrize("page", ["", "plain text", "<<<>>><p", "<p>a<p>b", "<div><div><div>", "</p></div>", "<!-- open", "<a title=\"x>y"])
def test_any_page_can_be_read(page):
    found = blocks(page)
    assert isinstance(main_text(page, ["html>body"]), str) and isinstance(best_container(found), str)


STORY = "".join(f"<p>Sentence number {i} of the long story goes on.</p>" for i in range(5))


@pytest.mark.parametrize(
    "classes",
    ["content no-sidebar", "post has-share-buttons", "entry-content with-comments", "article-body related-none", "sidebar", "sidebar-layout x"],
)
def test_classes_that_only_mention_a_role_do_not_hide_the_article(classes):
    page = f"<body><div class='{classes}'>{STORY}</div><div class='site-nav-wrapper'>Home</div><div class='sidebar-left'>Side</div></body>"
    assert main_text(page, []).split("\n") == [f"Sentence number {i} of the long story goes on." for i in range(5)]


def test_header_of_an_article_belongs_to_it():
    page = "<body><header><p>Site</p></header><article><header><h1>T</h1><p>By me</p></header><p>x</p></article></body>"
    assert main_text(page, []) == "T\nBy me\nx"


@pytest.mark.parametrize(
    "part", ["<a ", "</b>", "<div>", "<p><i>x</p>", "<ul><li><b><b><li>x", "<div class='c'><p>t", '<a href="', "<", "<script>", "<!--", "&amp"]
)
def test_hostile_pages_take_linear_time(part):
    import time

    began = time.process_time()
    assert isinstance(main_text(part * ((5 << 20) // len(part)), ["html>body"]), str)
    assert time.process_time() - began < 15  # about 3 s; a quadratic reader takes hours


def test_large_ids_beside_a_null_one(spark, codec):
    big = 2**53 + 1
    rows = [(big, "http://a.example/", "<p>x</p>"), (None, "http://a.example/", "<p>x</p>"), (big, "http://a.example/", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(r.page_id or 0 for r in extract_main_text(pages).collect()) == [0, big, big]
    docs = spark.createDataFrame([(i, "some text") for i, *_ in rows], DOC)
    encoded = encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r.doc_id or 0 for r in encoded.collect()) == [0, big, big]


class SlowReader(HTMLParser):
    """An independent reader of well-formed pages: a tree of the standard library's parser, walked from the root."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = ["#", {}, [], None]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), [], self.node]
        self.node[2].append(node)
        if tag not in ("br", "img", "meta"):
            self.node = node

    def handle_endtag(self, tag):
        if tag not in ("br", "img", "meta"):
            self.node = self.node[3]

    def handle_data(self, data):
        self.node[2].append(data)


def brute_article(page):
    reader = SlowReader()
    reader.feed(page)
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    def walk(node):
        if isinstance(node, str):
            line.append(node)
            return
        tag, attrs = node[:2]
        words = set((attrs.get("class") or "").split())
        if tag in ("nav", "footer", "aside", "script", "style", "title", "button") or words & {"comments", "ad", "cookie-notice", "newsletter"}:
            if tag in ("nav", "footer", "aside") or words:
                flush()
            return
        block = tag in ("article", "p", "h1", "h2", "li", "ul", "section", "blockquote", "div")
        if block:
            flush()
        if tag == "br":
            line.append(" ")
        for child in node[2]:
            walk(child)
        if block:
            flush()

    def find(node):
        if isinstance(node, str):
            return None
        return node if node[0] == "article" else next((f for c in node[2] if (f := find(c))), None)

    walk(find(reader.root))
    return "\n".join(out)


def test_articles_equal_those_of_an_independent_reader():
    rng = random.Random(21)
    texts = ["One &amp; two", "a\n  b&nbsp;c", "x < y".replace("<", "&lt;"), "plain <b>bold</b> tail", "<a href='/q'>link</a> text", "caf&eacute; &#8212; &#x41;", "l1<br>l2", ""]
    outside = ["<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<div class='ad'>Buy now</div>", "<aside><p>More</p></aside>", "<script>if (a < b) { x('</p>'); }</script>",
               "<div class='cookie-notice'><p>We use</p></div>", "<style>p > a {}</style>", "<section class='comments'><p>Reader says</p></section>", "<!-- note -->"]

    def body(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            k, t = rng.randrange(7), rng.choice(texts)
            inner = body(depth - 1) if depth and k > 3 else t
            parts.append(
                [f"<p>{t}</p>", f"<h2>{t}</h2>", f"<ul><li>{t}</li><li>{rng.choice(texts)}</li></ul>", rng.choice(outside), f"<div class='part'>{inner}</div>",
                 f"<section>{inner}</section>", f"<blockquote>{inner}</blockquote>"][k]
            )
        return "".join(parts)

    for _ in range(300):
        story = "<p>The story itself goes on for a while, so that it is the best container of its page.</p>" * 3
        page = f"<html><head><title>t</title></head><body><header><p>Site</p></header>{rng.choice(outside)}<article><h1>Head</h1>{story}{body(2)}</article>{rng.choice(outside)}<footer>c</footer></body></html>"
        assert main_text(page, []) == brute_article(page), page


def test_hosts_agree_on_a_path(spark):
    story = "".join(f"<p>Sentence number {i} of the story.</p>" for i in range(6))
    side = "".join(f"<p>Teaser {i} that is rather long and would win on this one page alone.</p>" for i in range(8))
    usual = f"<div class='story s#'>{story}</div><div class='teasers'><p>Teaser.</p></div>"
    odd = f"<div class='story s9'><p>Short story.</p></div><div class='teasers'>{side}</div>"
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{body}", usual.replace("#", str(i)))) for i in range(6)]
    rows += [(6, "http://h.example/6", PAGE.replace("{body}", odd)), (7, None, None), (8, "http://x.example", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in extract_main_text(df).collect()}
    assert found[6].text == "Short story." and found[0].text.count("\n") == 5
    assert found[7].text == "" and found[8].n_chars == 0 and found[0].n_chars == len(found[0].text)
    wide = {r.page_id: r.text for r in extract_main_text(df, most_broadcast_hosts=0).collect()}
    assert wide == {k: r.text for k, r in found.items()}
    assert extract_main_text(df.limit(0)).collect() == []


# ---- decontamination ----------------------------------------------------------------------

ITEMS = [
    (1, "If Anna has 12 apples and gives 5 to Tom, then how many apples does Anna keep after 3 days of rain?"),
    (2, "short one"),
    (3, "the plain words only question about rivers and hills"),
    (4, None),
]
DOCS = [
    (1, "Intro text. If Maria has 20 apples and gives 7 to Bob, then how many apples does Maria keep after 9 days of rain? End."),
    (2, "Intro. If Maria has 20 apples and gives 7 to Bob, then how many apples does Kurt keep after 9 days of rain? End."),
    (3, "nothing to see here, short one"),
    (4, None),
    (5, "x y z the plain words only question about rivers and hills indeed"),
    (6, "the plain words only question about dogs and cats"),
    (None, ITEMS[0][1]),
    (7, ""),
]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_reparameterised_questions_are_found(spark, most):
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], DOC + ", contaminated int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r["items"] for r in find_contamination(docs, items, most_filter_windows=most).collect()}
    assert {k for k, v in found.items() if v} == {1, 5, None} and found[1] == [1] and found[5] == [3]
    assert len(found) == len(DOCS)


def brute_tokens(text):
    """(placeholder or word, value) of an ASCII text."""
    cut = re.findall(r"(?:\d[.,:/](?=\d)|[A-Za-z]['-](?=[A-Za-z])|[A-Za-z0-9])+|[^A-Za-z0-9]", text)
    out, stop, before = [], True, None
    for w in cut:
        if not w[0].isalnum():
            stop = stop or w in ".!?:;\n"
            continue
        low = w.lower()
        number = w[0].isdigit() or low in NUMBER_WORDS
        unit = before == "number" and not stop and low in UNIT_WORDS
        kind = "number" if number else "unit" if unit else ("opener" if stop else "name") if w[0].isupper() else "word"
        if kind == "name" and before == "name":
            out[-1] = ("name", (*out[-1][1], low))
        else:
            out.append((low, None) if kind == "word" else ("name" if kind == "opener" else kind, (low,)))
        before, stop = kind, False
    return out


def brute_contamination(docs, items):
    found = {}
    for k, (_, text) in enumerate(docs):
        t = brute_tokens(text or "")
        for item, question in items:
            q = brute_tokens(question)
            plain = [i for i, (_, v) in enumerate(q) if v is None]
            exact = len(plain) < 4
            if exact and len(q) < 4:
                continue
            w = len(q) if exact else min(len(q), max(8, min(plain[i + 3] - plain[i] + 1 for i in range(len(plain) - 3))))
            full = lambda x: exact or sum(v is None for _, v in x) >= 4
            same = lambda x, y: x == y if exact else [a for a, _ in x] == [b for b, _ in y]
            at = [i for i in range(len(q) - w + 1) if full(q[i : i + w])]
            lines = {}
            for i in at:
                for p in range(len(t) - w + 1):
                    if same(q[i : i + w], t[p : p + w]):
                        lines.setdefault(p - i, []).append((i, p))
            covered = set()
            for hits in lines.values():
                fill = {}
                for i, p in hits:
                    for (_, a), (_, b) in zip(q[i : i + w], t[p : p + w], strict=True):
                        if a is not None:
                            fill.setdefault(a, set()).add(b)
                if all(len(v) == 1 for v in fill.values()):
                    covered |= {i for i, _ in hits}
            if at and 2 * len(covered) >= len(at):
                found.setdefault(k, []).append(item)
    return found


def test_contamination_equals_brute_force(spark):
    rng = random.Random(12)
    names, plain = ["Anna", "Tom", "Ben Lee"], ["has", "red", "apples", "and", "buys", "more", "then", "how", "many", "are", "left"]

    def sentence(n):
        kinds = [rng.choice([rng.choice(names), str(rng.randint(1, 9)), "five kg", *rng.sample(plain, 4)]) for _ in range(n)]
        return " ".join([rng.choice(names), *kinds]) + rng.choice([". ", "? ", ", "])

    items = [(i, "".join(sentence(rng.randint(2, 12)) for _ in range(rng.randint(1, 3)))) for i in range(30)]
    docs = []
    for i in range(120):
        text = rng.choice(items)[1]
        if rng.random() < 0.7:
            swap = dict(zip(names, rng.sample(names, 3), strict=True)) | {str(d): str(rng.randint(1, 9)) for d in range(1, 10)}
            text = re.sub("|".join(swap), lambda m: swap[m[0]], text)
        if rng.random() < 0.3:
            text = text.replace(rng.choice(plain), "green", 1)
        docs.append((rng.choice([i, None, 5]), sentence(5) + text + sentence(4)))
    expected = brute_contamination(docs, items)
    assert 30 < len(expected) < 115
    found = find_contamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, tuple(r["items"])) for r in found.collect())
    assert got == Counter((i, tuple(expected.get(k, []))) for k, (i, _) in enumerate(docs))


def test_names_that_open_sentences_and_clashing_columns(spark):
    item = "Tom has 3 red apples. Tom buys 4 more apples at the old market, so how many apples are there?"
    other = item.replace("Tom", "Anna").replace("3", "5").replace("4", "9")
    rows = [(1, f"Intro. {other} End.", 7), (1, f"Intro. {other} End.", 8), (2, f"Intro. {other.replace('Anna', 'Bob', 1)}", 9), (3, "word " * 60_000 + item, 1)]
    docs = spark.createDataFrame(rows, DOC + ", uid long")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = find_contamination(docs, items).collect()
    assert sorted((r.doc_id, r.contaminated) for r in found) == [(1, True), (1, True), (2, False), (3, True)]
    assert [tuple(r) for r in keep_clean_documents(docs, items).collect()] == [rows[2]]


def test_number_heavy_items_are_found(spark):
    heavy, bare = "add 3 5 7 9 11 then 2 4 6 8 10 subtract 1 3 5 7 9 give 4 8", "12 17 29 + 35 = 93"
    items = spark.createDataFrame([(1, heavy), (2, bare), (3, "7 8 9")], "item_id long, text string")
    other = "add 4 6 8 1 12 then 3 5 7 9 13 subtract 2 4 6 8 1 give 5 9"
    rows = [(1, f"Intro. x {heavy} y"), (2, f"Intro. x {other} y"), (3, f"so {bare} here"), (4, "so 12 17 29 + 35 = 94 here"), (5, other.replace("then", "and")), (6, "7 8 9")]
    found = {r.doc_id: r["items"] for r in find_contamination(spark.createDataFrame(rows, DOC), items).collect()}
    assert found == {1: [1], 2: [1], 3: [2], 4: [], 5: [], 6: []}


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(DOCS, DOC), spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in find_contamination(docs, none).collect())
    assert find_contamination(docs.limit(0), none).collect() == []
