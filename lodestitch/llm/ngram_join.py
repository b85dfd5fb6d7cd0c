"""N-gram Jaccard self-join by multiple global orders.

A document is the set of its distinct word shingles. Two sets with a Jaccard similarity of
``percent`` / 100 or more share a shingle among the first ``n - ceil(t n) + 1`` of each, under
any order that is the same for all documents. Several orders are used at once, all with rare
shingles first and each with its own random order among equally frequent ones; a pair is
verified only if it passes the prefix filter of every order.

1. How many documents have each shingle is found by packed fingerprints (``_sharing``). A
   document whose prefix holds only shingles of its own is linked with nothing: most end here.
2. Documents with equal sets are one class; its smallest id stands for it. Classes that share
   a shingle in their first-order prefixes are brought together by connected components over
   edges to the least class of each shingle (no pairs are made).
3. Within such a block, the filters of all orders and the sizes are intersected and the pairs
   that remain are verified on their shared shingles. A block of more than ``block_bytes`` is
   first dealt by size: sets whose sizes are too far apart for a link do not meet. What is
   still larger is cut into parts and each two parts meet in a task of their own, so memory is
   bounded and no pair is lost.
4. A task returns the links that connect its sets and, with ``links``, how many links each set
   has, weighted by the copies of the other set; pairs are counted, not listed. Components of
   the connecting links, and of the classes, give the result. ``similar_pairs`` lists them.

Scale: the texts shuffle once (by a hash of id and text); later steps carry only documents that
may have a partner, and of those only shingles that occur elsewhere. A group of copies is one
row per group of documents after a partial aggregate. The work that grows faster than the
input is that of very many different sets of one size in one block: their parts meet pairwise.

Names: shingles have 64-bit names; documents with equal size and two equal 64-bit sums of
their shingles' names are one class.

Defined results: a null or blank text has an empty set and is linked with nothing; fewer words
than a shingle make one shingle of all; a document with a null id is linked with nothing, has a
null component and no links; rows with equal ids and different texts are separate documents;
repeated rows are one class and link with each other; an empty table gives an empty result;
columns other than the named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm import _sharing as sharing
from lodestitch.llm._hashing import BYTE, LOWER, U, distinct, join, portions, scramble, span_names, text_bytes, word_spans
from lodestitch.operators.graph import connected_components
from lodestitch.plans.materialize import shuffle_partitions, stored

ORDERS = 3
_SEEDS = scramble(np.arange(1, ORDERS + 1, dtype=np.uint64))

SETS = "g int, doc_id long, n long, s1 long, s2 long, shared binary, p0 array<long>, p1 binary, p2 binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's row, shingle), distinct and sorted by row, then shingle."""
    rows, names = [], []
    for a, b in portions(offsets, 1 << 20):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends = word_spans(part, bounds)
        if not len(starts):
            continue
        words = span_names(BYTE[LOWER[part]], starts, ends)
        row = np.searchsorted(bounds, starts, side="right") - 1
        count = np.bincount(row, minlength=b - a)
        full = max(0, len(words) - width + 1)
        name = words[:full]
        for k in range(1, width):
            name = join(name, words[k : k + full])
        whole = row[:full] == row[width - 1 : width - 1 + full]
        name, at = name[whole], row[:full][whole]
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < width))
        few = span_names(words, first[short], first[short] + count[short]) ^ U(1)
        name, at = np.r_[name, few], np.r_[at, short]
        order = np.lexsort((name, at))
        name, at = name[order], at[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])]
        rows.append(a + at[new])
        names.append(name[new])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(names)


def _classes(texts: pa.Table, width: int):
    """Shingles of one group of documents and which documents are the first with their set."""
    ids = texts.column("doc_id").to_numpy()
    row, name = shingle_sets(*text_bytes(texts.column("text")), width)
    n = np.bincount(row, minlength=len(ids))
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    s1, s2 = np.zeros(len(ids), U), np.zeros(len(ids), U)
    if len(starts):
        s1[full] = np.add.reduceat(scramble(name), starts)
        s2[full] = np.add.reduceat(scramble(name ^ _SEEDS[0]), starts)
    order = np.lexsort((ids, s2, s1, n))
    same = (n[order][1:] == n[order][:-1]) & (s1[order][1:] == s1[order][:-1]) & (s2[order][1:] == s2[order][:-1])
    first = np.zeros(len(ids), bool)
    first[order] = np.r_[True, ~same][: len(ids)]
    return ids, row, name, n, s1, s2, first & full


def _ask(buckets: int, width: int):
    def ask(texts: pa.Table) -> pa.Table:
        _, row, name, _, _, _, first = _classes(texts, width)
        keys, counts = np.unique(name[first[row]], return_counts=True)
        return sharing.ask(keys, counts, texts.column("g")[0].as_py() if len(texts) else 0, buckets)

    return ask


def _prefixes(width: int, percent: int):
    def prefixes(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int32()] + [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["g", "doc_id", "n", "s1", "s2", "shared", "p0", "p1", "p2"]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        if not len(texts):
            return schema.empty_table()
        ids, row, name, n, s1, s2, first = _classes(texts, width)
        keys = distinct(name[first[row]])
        level = np.zeros(len(name), np.uint8)
        if len(keys):
            level = sharing.levels(answers)[np.searchsorted(keys, name)]
        prefix = n - (percent * n + 99) // 100 + 1
        own = np.bincount(row[level == 1], minlength=len(ids))
        open_ = first & (own < prefix) & (ids != sharing.NO_ID)
        begin = np.cumsum(n) - n
        shared: list[bytes | None] = [None] * len(ids)
        tops: list[list] = [[None] * len(ids) for _ in range(ORDERS)]
        for i in np.flatnonzero(open_):
            s = slice(begin[i], begin[i] + n[i])
            t, lv = name[s], level[s]
            several = lv > 1
            t, lv = t[several], lv[several]
            shared[i] = t.tobytes()
            for k in range(ORDERS):
                top = t[np.lexsort((scramble(t ^ _SEEDS[k]), lv))[: prefix[i] - own[i]]]
                tops[k][i] = top.view(np.int64) if k == 0 else top.tobytes()
        values = [texts.column("g"), ids, n, s1.view(np.int64), s2.view(np.int64), shared, *tops]
        return pa.table([v if isinstance(v, pa.ChunkedArray) else pa.array(v, t) for v, t in zip(values, kinds, strict=True)], schema)

    return prefixes


def _csr(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in values])
    return np.concatenate(values), np.cumsum(sizes) - sizes


def linked_pairs(
    n: np.ndarray,
    shared: list[np.ndarray],
    tops: list[list[np.ndarray]],
    percent: int,
    *,
    side: np.ndarray | None = None,
    bins: np.ndarray | None = None,
    every: bool = True,
) -> Iterator[tuple[int, np.ndarray]]:
    """Links of one block: (place, places of later sets linked with it).

    ``side``: compare only sets of different sides (0, 1). ``bins``: 1 for sets of the larger of
    two neighbouring size ranges, 0 for the smaller; two of the smaller meet elsewhere. Without
    ``every``, pairs that are already connected are passed over.
    """
    size = len(n)
    vocabulary, flat = np.unique(np.concatenate(shared), return_inverse=True)
    sizes = np.array([len(s) for s in shared])
    start = np.cumsum(sizes) - sizes
    filters = []
    for top in tops:
        values, begin = _csr(top)
        filters.append((np.searchsorted(vocabulary, values), begin, np.array([len(t) for t in top])))
    mark = np.zeros(len(vocabulary), bool)
    component = np.arange(size)
    for x in range(size - 1):
        y = np.arange(x + 1, size)
        if not every:
            y = y[component[y] != component[x]]
        y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
        if side is not None:
            y = y[side[y] != side[x]]
        if bins is not None:
            y = y[(bins[y] | bins[x]) > 0]
        for values, begin, length in filters:
            if not len(y):
                break
            mine = values[begin[x] : begin[x] + length[x]]
            mark[mine] = True
            y = y[_hits(mark, values, begin[y], length[y]) > 0]
            mark[mine] = False
        if not len(y):
            continue
        mine = flat[start[x] : start[x] + sizes[x]]
        mark[mine] = True
        both = _hits(mark, flat, start[y], sizes[y])
        mark[mine] = False
        y = y[100 * both >= percent * (n[x] + n[y] - both)]
        if len(y):
            joined = np.isin(component, component[y])
            if not every:
                y = y[np.unique(component[y], return_index=True)[1]]
            component[joined] = component[x]
            yield x, y


def _hits(mark: np.ndarray, values: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of each slice's values are marked."""
    past = np.cumsum(length)
    inner = np.arange(past[-1]) - np.repeat(past - length, length)
    total = np.r_[0, np.cumsum(mark[values[np.repeat(begin, length) + inner]])]
    return total[past] - total[past - length]


def _spanning(found: list[tuple[int, np.ndarray]], size: int) -> list[tuple[int, int]]:
    """Links enough to connect what all of them connect."""
    component, out = np.arange(size), []
    for x, ys in found:
        new = ys[component[ys] != component[x]]
        if len(new):
            for y in new[np.unique(component[new], return_index=True)[1]].tolist():
                component[component == component[y]] = component[x]
                out.append((x, y))
    return out


LINKS = "a string, b string, n long"


def _verify(percent: int, mode: str):
    """Rows (a, b, null) of links, connecting ones or all, and with mode "count" (a, null, links weighted by copies)."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("v", "ascending")])
        block, n, weight = (rows.column(c).to_numpy() for c in ("block", "n", "copies"))
        parts, sub, bin_ = (rows.column(c).to_numpy() for c in ("part", "sub", "bin"))
        v = rows.column("v").to_pylist()
        split = bool(rows.column("i")[0].as_py() != rows.column("j")[0].as_py())
        as_sets = lambda c: [np.frombuffer(x, "<u8") for x in rows.column(c).to_pylist()]
        shared = as_sets("shared")
        tops = [[np.array(x, np.int64).view(U) for x in rows.column("p0").to_pylist()], as_sets("p1"), as_sets("p2")]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        a_out: list[str] = []
        b_out: list[str | None] = []
        n_out: list[int | None] = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found = list(
                linked_pairs(
                    n[a:b],
                    shared[a:b],
                    [t[a:b] for t in tops],
                    percent,
                    side=(parts[a:b] != parts[a]).astype(int) if split else None,
                    bins=(bin_[a:b] == sub[a:b]).astype(int) if sub[a] >= 0 else None,
                    every=mode != "connect",
                )
            )
            pairs = [(x, y) for x, ys in found for y in ys.tolist()] if mode == "list" else _spanning(found, b - a)
            a_out += [v[a + x] for x, _ in pairs]
            b_out += [v[a + y] for _, y in pairs]
            n_out += [None] * len(pairs)
            if mode == "count":
                links = np.zeros(b - a, np.int64)
                for x, ys in found:
                    links[x] += weight[a + ys].sum()
                    links[ys] += weight[a + x]
                some = np.flatnonzero(links).tolist()
                a_out += [v[a + x] for x in some]
                b_out += [None] * len(some)
                n_out += links[some].tolist()
        return pa.table([a_out, b_out, n_out], schema=schema)

    return verify


class _Sets(NamedTuple):
    sets: DataFrame  # g, doc_id, n, s1, s2 and, of sets that may have a partner, what they are compared by
    local: DataFrame  # classes per group of documents
    classes: DataFrame  # v, first, copies, n, s1, s2
    links: DataFrame


KEY = ["n", "s1", "s2"]


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, groups: int | None, block_bytes: int, mode: str) -> _Sets:
    g, b = sharing.layout(docs, text_col, groups)
    texts = sharing.dealt(docs, id_col, text_col, g).groupBy("g")
    answers = sharing.answered(texts.applyInArrow(_ask(b, width), sharing.ASK))
    sets = stored(texts.cogroup(answers.groupBy("g")).applyInArrow(_prefixes(width, percent), SETS))

    # A class with a third of all rows has one row per group of documents from here on.
    local = stored(
        sets.where((F.col("n") > 0) & (F.col("doc_id") != sharing.NO_ID))
        .groupBy("g", *KEY)
        .agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    )
    classes = stored(
        local.groupBy(*KEY)
        .agg(F.min(F.struct("low", "g")).alias("at"), F.sum("rows").alias("copies"))
        .select(F.concat_ws("-", *KEY).alias("v"), *KEY, F.col("at.low").alias("first"), F.col("at.g").alias("g"), "copies")
    )
    own = sets.where("shared is not null").join(classes.select("g", *KEY, "v", "copies"), ["g", *KEY])
    open_ = stored(own.dropDuplicates(["v"]))
    tokens = open_.select("s1", F.explode("p0").alias("token"))
    hubs = tokens.groupBy("token").agg(F.min("s1").alias("hub"), F.count("*").alias("k")).where("k > 1")
    near = tokens.join(hubs, "token").where("s1 <> hub").select("s1", "hub").distinct()
    blocks = connected_components(near, "s1", "hub").select(F.col("node").alias("s1"), F.col("component").alias("block"))

    weight = (F.length("shared") + F.length("p1") + F.length("p2") + 8 * F.size("p0") + 64).cast("long")
    members = open_.join(blocks, "s1").withColumn("weight", weight)
    big = F.col("total") > block_bytes
    # Sets that can be linked are in equal or neighbouring bins; each meets those of its own bin there and of the next one there.
    bin_ = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9)).cast("long")
    sized = (
        members.join(members.groupBy("block").agg(F.sum("weight").alias("total")), "block")
        .withColumn("bin", F.when(big, bin_).otherwise(F.lit(-1)))
        .withColumn("sub", F.explode(F.when(big, F.array(F.col("bin"), F.col("bin") + 1)).otherwise(F.array(F.lit(-1).cast("long")))))
    )
    totals = sized.groupBy("block", "sub").agg(F.ceil(F.sum("weight") / block_bytes).cast("int").alias("cut"))
    bins = 8 * shuffle_partitions(docs.sparkSession)
    placed = sized.join(totals, ["block", "sub"]).withColumn(
        "part", F.when(F.col("cut") > 1, F.pmod(F.xxhash64("v"), F.col("cut"))).otherwise(0).cast("int")
    )
    meets = F.transform(
        F.sequence(F.lit(0), F.col("cut") - 1),
        lambda o: F.struct(F.least(o, "part").alias("i"), F.greatest(o, "part").alias("j")),
    )
    small = (F.col("cut") == 1) & (F.col("sub") < 0)
    tasks = placed.select(
        F.when(small, -1 - F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.shiftrightunsigned(F.xxhash64("block", "sub"), 1)).alias("k"),
        F.xxhash64("block", "sub").alias("block"), "v", "n", "copies", "part", "bin", "sub", "shared", "p0", "p1", "p2", F.inline(meets),
    )
    return _Sets(sets, local, classes, stored(tasks.groupBy("k", "i", "j").applyInArrow(_verify(percent, mode), LINKS)))


def similar_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
    groups: int | None = None,
    block_bytes: int = 4 << 20,
    links: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id and with ``links`` n_links (how many rows it links with); one row per input row."""
    sets, local, classes, found = _linked(docs, id_col, text_col, width, percent, groups, block_bytes, "count" if links else "connect")
    component = connected_components(found.where("b is not null"))
    labelled = component.join(classes.select(F.col("v").alias("node"), "first"), "node")
    least = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = labelled.join(least, "component").select(F.col("node").alias("v"), "component_id")
    counted = found.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("others"))
    result = classes.join(of_class, "v", "left")
    result = result.join(counted, "v", "left") if links else result.withColumn("others", F.lit(None).cast("long"))
    result = result.select(
        *KEY,
        F.coalesce("component_id", "first").alias("component_id"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )
    result = local.join(result, KEY).select("g", *KEY, "component_id", "n_links")
    known = F.col("doc_id") != sharing.NO_ID
    return (
        sets.select("g", "doc_id", *KEY)
        .join(result, ["g", *KEY], "left")
        .select(
            F.when(known, F.col("doc_id")).alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
            *[F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")][: int(links)],
        )
    )


def similar_pairs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    percent: int = 90,
    groups: int | None = None,
    block_bytes: int = 4 << 20,
) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes: class_a, class_b; membership: doc_id, class_id); documents with equal sets are one class."""
    sets, local, classes, found = _linked(docs, id_col, text_col, width, percent, groups, block_bytes, "list")
    of_row = local.join(classes.select(*KEY, "v"), KEY).select("g", *KEY, F.col("v").alias("class_id"))
    members = sets.where(F.col("doc_id") != sharing.NO_ID).select("g", "doc_id", *KEY).join(of_row, ["g", *KEY])
    pairs = found.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
    return pairs, members.select("doc_id", "class_id")
