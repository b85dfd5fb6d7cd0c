"""Main text of web pages by consensus of each host's pages.

Pass one scores the containers of every page (text outside links, credited to the nearest
container and by half to the one around it) and lets the page vote for its best container's
generalised path: the tags from the root down, each with its classes, digits as ``#``. Spark
counts the votes per host. Pass two reads every page again and takes the text of the host's
winning paths, so a page whose own best container is an outlier follows its host. A page that
has none of the winning paths falls back to its own vote.

What is not the article is told by its tag, or by a class, id or role token that begins or ends
with the name of a role (``sidebar-left``, ``site-footer``); tokens that describe a layout
(``no-sidebar``, ``has-share-buttons``, ``related-none``) do not count. An element that holds most
of the page's text is not taken for a sidebar, form, banner or the like, whatever its class.

Scale: votes are one short row a page, combined before they shuffle, so a host with a third of
all pages costs nothing extra. Winning paths need a tenth of a host's votes, so a host has ten
at most. They are broadcast while their number of hosts is at most ``most_broadcast_hosts``
(a few hundred bytes each); beyond that they are joined by host, where adaptive execution
splits a hot host. Each page is parsed alone, in time and memory that grow with its length.

Defined results: a null or empty page gives an empty text; a page without markup is its own
text; a null url has the empty host; unclosed or stray tags never fail, and a tag that is still
open at the end of the page is dropped; the header of an article belongs to it, others do not;
repeated pages are repeated (and vote again); a null id stays null; an empty table gives an
empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm.url_reputation import host_of
from lodestitch.plans.materialize import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
HINT_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
CONTAINERS = frozenset("html body div article section main td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption "
    "address hr fieldset details summary nav header footer aside form hgroup menu search".split()
)
#: A new element of this kind ends an open one of these kinds, looked for down to the fence.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Any other block ends an open paragraph, looked for down to the fence.
ENDS_P = (("p",), ("td", "th", "li", "div", "article", "section", "main", "blockquote", "body"))
#: Elements that are never the article.
OUTSIDE = frozenset(
    "head nav footer aside noscript template svg button select iframe object menu dialog search canvas label".split()
)
#: Words of class, id and role that mark what is not the article (fixed values): always, and unless most of the page is there.
ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored menu nav navbar navigation footer masthead "
    "breadcrumb breadcrumbs cookie cookies consent gdpr popup modal overlay dialog newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond replies pagination pager toolbar skip contentinfo "
    "copyright disclaimer".split()
)
UNLESS_MOST = frozenset(
    "promo promotion banner sidebar notice notices alert share sharing social related recommended widget complementary search".split()
)
#: Words that say something about a layout, not what an element is: before and after the name of a role (fixed values).
BEFORE = frozenset("no not has have with without is hide hides show shows enable disable enabled disabled js".split())
AFTER = frozenset("no none off on true false disabled enabled layout page template".split())
#: Words that may follow the name of a role (fixed values).
NEUTRAL = frozenset("wrapper wrap container box block area section list inner outer item items link links left right top bottom button buttons bar form".split())


class Block(NamedTuple):
    node: int  # its container
    text: str
    linked: int
    mark: int  # the element with an ``UNLESS_MOST`` word around it, 0 for none


class Page(NamedTuple):
    """Text blocks that are not in an outside element, in page order, and the tree of their containers' paths."""

    blocks: list[Block]
    around: list[int]  # of each container's path the one around it; the page itself is 0
    steps: list[str]
    inner: dict[tuple[int, str], int]


def _roles(attribute: str) -> set[str]:
    """The words that name a role in a class, id or role attribute: those a token begins or ends with."""
    found: set[str] = set()
    for token in attribute.split():
        parts = [x.lower() for x in HINT_PARTS.findall(token) if not x.isdigit()]
        if not parts or len(parts) > 1 and (parts[0] in BEFORE or parts[-1] in AFTER):
            continue
        found.add(parts[0])
        while len(parts) > 1 and parts[-1] in NEUTRAL:
            parts.pop()
        found.add(parts[-1])
    return found


def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(step of the generalised path, is outside the article, is so unless most of the page is there, is a header)."""
    maybe = tag == "form"
    if not attributes:
        return tag, tag in OUTSIDE, maybe, tag == "header"
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = values.get("class", "")
    roles = _roles(f"{classes} {values.get('id', '')} {values.get('role', '')}")
    step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c).replace(">", "") for c in classes.split()})])
    if tag in ("html", "body", "article", "main"):
        return step, False, False, False
    outside = tag in OUTSIDE or not ALWAYS.isdisjoint(roles) or bool(HIDDEN.search(attributes))
    return step, outside, maybe or not UNLESS_MOST.isdisjoint(roles), tag == "header" or "header" in roles


def blocks(page: str) -> Page:
    """Read a page once, from left to right; time and memory grow with its length only."""
    out: list[Block] = []
    around, steps, inner = [-1], [""], {}
    marks = [0]  # of each marked element the one around it
    # Open elements: tag, then the container, outside, mark, header, link and article around it.
    stack: list[tuple[str, int, bool, int, bool, bool, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack a tag is open
    node, outside, mark, header, link, in_article = 0, False, 0, False, False, 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(htmllib.unescape("".join(parts)).split())
            if text:
                out.append(Block(node, text, min(linked, len(text)), mark))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal node, outside, mark, header, link, in_article
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            _, node, outside, mark, header, link, in_article = stack.pop()
            places[tag].pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        start = m.start() if m else size
        if start > pos and not outside and not header:
            piece = page[pos:start]
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                parts.append(" ")
            elif (i := last((tag,))) >= 0:
                close(i)
            continue
        tags, fences = ENDS.get(tag, ENDS_P)
        if (tag in ENDS or tag in BLOCKS) and (i := last(tags)) > last(fences):
            close(i)
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "img"):
            parts.append(" ")
        if tag in VOID or (m[3] or "").endswith("/") and tag not in CONTAINERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        step, is_outside, is_marked, is_header = _element(tag, m[3] or "")
        places[tag].append(len(stack))
        stack.append((tag, node, outside, mark, header, link, in_article))
        in_article += tag in ("article", "main")
        if tag in CONTAINERS:
            key = (node, step)
            if key not in inner:
                inner[key] = len(steps)
                around.append(node)
                steps.append(step)
            node = inner[key]
        outside = outside or is_outside
        if is_marked and not outside:
            marks.append(mark)
            mark = len(marks) - 1
        header = header or is_header and not in_article
        link = link or tag == "a"
    close(0)
    flush()
    return Page(_unmarked(out, marks), around, steps, inner)


def _unmarked(found: list[Block], marks: list[int]) -> list[Block]:
    """Blocks outside marked elements; an element that holds most of the page, in several blocks, is not taken for marked."""
    if len(marks) == 1:
        return found
    chars, count = [0] * len(marks), [0] * len(marks)
    for b in found:
        chars[b.mark] += len(b.text)
        count[b.mark] += 1
    total = sum(chars)
    for k in range(len(marks) - 1, 0, -1):
        chars[marks[k]] += chars[k]
        count[marks[k]] += count[k]
    gone = [False] * len(marks)
    for k in range(1, len(marks)):
        gone[k] = gone[marks[k]] or not (2 * chars[k] > total and count[k] > 2)
    return [b for b in found if not gone[b.mark]]


def _best(page: Page) -> int:
    own: dict[int, float] = defaultdict(float)
    for b in page.blocks:
        own[b.node] += max(0, len(b.text) - 3 * b.linked)
    score: dict[int, float] = defaultdict(float)
    for node, chars in own.items():
        score[node] += chars
        if node:
            score[page.around[node]] += chars / 2
    if not score:
        return 0
    best = node = min(score, key=lambda k: (-score[k], k))
    article = main = -1
    while node > 0:
        tag = page.steps[node].partition(".")[0]
        article, main = (node if tag == "article" else article), (node if tag == "main" else main)
        node = page.around[node]
    return article if article > 0 else main if main > 0 else best


def best_container(page: Page) -> str:
    """The path that the page votes for; empty for the whole page."""
    node, steps = _best(page), []
    while node > 0:
        steps.append(page.steps[node])
        node = page.around[node]
    return ">".join(reversed(steps))


def _text_under(page: Page, node: int) -> str:
    """The blocks of all containers with this path, joined by newlines."""
    below = [False] * len(page.steps)
    below[node] = True
    for k in range(node + 1, len(below)):
        below[k] = below[page.around[k]]
    return "\n".join(b.text for b in page.blocks if below[b.node])


def main_text(html: str, winners: list[str]) -> str:
    """The text under the first winning path that the page has, else under its own vote."""
    page = blocks(html)
    for path in winners:
        node = 0
        for step in path.split(">") if path else ():
            node = page.inner.get((node, step), -1)
        if node >= 0 and (text := _text_under(page, node)):
            return text
    return _text_under(page, _best(page))


def host_paths(pages: DataFrame, *, least_share: float = 0.1) -> DataFrame:
    """host, paths: the paths with ``least_share`` of the host's votes, most votes first.

    ``pages`` has host and html.
    """

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [best_container(page) if h and (page := blocks(h)).blocks else None for h in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "path": best}).dropna()

    votes = pages.mapInPandas(vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes"))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    return (
        votes.join(totals, "host")
        .where(F.col("votes") >= F.col("total") * least_share)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))).alias("ranked"))
        .select("host", F.transform("ranked", lambda x: x["path"]).alias("paths"))
    )


def extract_main_text(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    most_broadcast_hosts: int = 50_000,
) -> DataFrame:
    """page_id, url, text, n_chars; one row per input row."""
    p = pages.select(
        F.col(id_col).cast("long").cast("string").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col)).alias("host"),
        F.col(html_col).cast("string").alias("html"),
    )
    winners = materialize(host_paths(p.select("host", "html")))
    few = winners.count() <= most_broadcast_hosts
    joined = p.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "paths")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [
                main_text(h, [] if w is None else list(w)) if h else ""
                for h, w in zip(batch["html"], batch["paths"], strict=True)
            ]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "text": text,
                    "n_chars": [len(t) for t in text],
                }
            )

    # Ids pass as text: beside a null pandas would make them floating-point numbers.
    out = joined.mapInPandas(extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
