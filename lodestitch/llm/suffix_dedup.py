"""Exact substring deduplication by bucket-pointer refinement.

Every byte that lies in a ``2q``-byte string (q = 25) which also starts in a document with a
smaller id is removed. Suffixes are put into buckets by their first bytes, and buckets are
refined by the bucket pointers at later offsets, first across the cluster, where the suffixes
that matter are few, then exactly within each place where they meet:

* Of the q-grams of a ``2q``-byte window, the one with the least name is the window's anchor.
  Equal windows have equal anchors, so only suffixes at anchors (about 7 % of all) stand for
  their bucket; consecutive windows that share an anchor are a run.
* Round 0 keeps the anchors' buckets that have suffixes of two documents. Round 1 refines them
  by the buckets that lie at the run's first byte, q later, and q after its last window's
  start: a bucket that stays whole keeps its smallest document's bytes, all others lose theirs.
* Where a bucket falls apart, each part's smallest document sends the bytes of its run. There
  ``bucket_pointers`` sorts them: initial buckets are 8-grams, taken as numbers, a suffix's
  pointer is where its bucket begins, and buckets are refined by sorting on (own pointer,
  pointer at the later offset), 8, then 16, then 18 bytes later. Each round reads the pointers
  that the one before wrote, and only suffixes that still share a bucket are sorted again.
  After three rounds a bucket holds equal 50-byte strings: bytes were compared, not hashes.
* A bucket that falls into very many parts (a short passage that a third of all documents
  share, with other words around it) is not brought to one place: its windows are sent one by
  one, dealt by their content, each distinct one once per group.

Scale: rounds exchange packed fingerprints (see ``_sharing``), not a row per suffix; in every
round a group of documents sends each bucket its smallest document only, so a passage that a
third of all documents share, or thousands of copies, cost an entry per group. Later rounds
see only what the earlier ones left. Memory of a task is that of a group or bucket, whose
number follows the bytes of the corpus.

Names: in rounds 0 and 1 a whole run is known by its 32-bit fingerprint within a bucket and a
64-bit name; runs that agree in both are taken for equal.

Defined results: a null text has no bytes; a null id comes after all others; documents with
equal ids do not remove each other's bytes; texts shorter than a window are kept whole; an
empty table gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm import _sharing as sharing
from lodestitch.llm._hashing import BYTE, U, distinct, join, portions, quick_join, scramble, span_names, text_bytes

#: Bytes of an initial bucket; a window has twice as many.
Q = 25
WIN = 2 * Q
#: Window starts taken at a time, and bytes of runs compared at a time.
PIECE, PORTION = 1 << 17, 1 << 20
_PLACE = U((1 << 20) - 1)
#: Bytes of an initial bucket where runs are compared.
GRAM = 8
#: States of a bucket after round 1: one part; several; several, and this group holds the part's smallest document; crowded.
WHOLE, SEVERAL, SPEAKS, WINDOWS = range(4)
#: The name that says that a group has very many parts of a bucket.
CROWDED = U(2**64 - 1)


class Runs(NamedTuple):
    """Consecutive windows that share an anchor."""

    doc: np.ndarray  # row of the document in the group
    lo: np.ndarray  # first window's start, in the group's bytes
    hi: np.ndarray  # last window's start
    anchor: np.ndarray  # the suffix that stands for the windows
    bucket: np.ndarray  # its q-pointer
    refined: np.ndarray  # name of the bucket after round 1


def _pointers(data: np.ndarray) -> np.ndarray:
    """q-pointers at every offset, by doubling the depth: 1, 2, 4, 8, 16, then 25."""
    p, depth = BYTE[data], 1
    while 2 * depth <= Q:
        p = quick_join(p[:-depth], p[depth:])
        depth *= 2
    return scramble(quick_join(p[: len(p) - (Q - depth)], p[Q - depth :]))


def _pieces(offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first text, past text, first byte, past byte); a long text is cut with an overlap of a window less one."""
    out = []
    for a, b in portions(offsets, PIECE):
        begin, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - begin <= PIECE:
            out.append((a, b, begin, end))
        else:
            out += [(a, b, s, min(end, s + PIECE + WIN - 1)) for s in range(begin, end - WIN + 1, PIECE)]
    return out


def _runs_of(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of all texts of a group."""
    found = []
    for a, b, begin, end in _pieces(offsets):
        if end - begin < WIN:
            continue
        p = _pointers(data[begin:end])
        bounds = np.clip(offsets[a : b + 1] - begin, 0, end - begin)
        edge = np.zeros(end - begin + 1, np.int32)
        np.add.at(edge, bounds[:-1], 1)
        np.add.at(edge, np.maximum(bounds[:-1], bounds[1:] - (WIN - 1)), -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(at):
            continue
        least = (p & ~_PLACE) | np.arange(len(p), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: len(least) - (Q - 15)], least[Q - 15 :])
        anchor = (least[at] & _PLACE).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
        first = np.flatnonzero(new)
        lo, hi, anchor = at[first], at[np.r_[first[1:], len(at)] - 1], anchor[first]
        shape = scramble(((anchor - lo) * 64 + (hi - lo)).astype(np.uint64))
        refined = join(join(p[lo], p[lo + Q]), join(p[hi + Q], shape))
        doc = a + np.searchsorted(bounds[1:], lo, side="right")
        # Anchors have small pointers, so they are scrambled once more: buckets are dealt by their first bits.
        found.append(Runs(doc, lo + begin, hi + begin, anchor + begin, scramble(p[anchor]), refined))
    none, no_name = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Runs(*map(np.concatenate, zip(*found, strict=True))) if found else Runs(none, none, none, none, no_name, no_name)


def _input(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts.column("text"))
    return texts.column("doc_id").to_numpy(), data, offsets


def _least_by(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the least and the largest value of each."""
    order = np.argsort(key)
    k, v = key[order], value[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.minimum.reduceat(v, starts) if len(k) else v, np.maximum.reduceat(v, starts) if len(k) else v


def _round0(n_buckets: int):
    def ask(texts: pa.Table) -> pa.Table:
        ids, data, offsets = _input(texts)
        runs = _runs_of(data, offsets)
        keys, low, high = _least_by(runs.bucket, ids[runs.doc])
        return sharing.ask(keys, 1 + (low < high), texts.column("g")[0].as_py() if len(texts) else 0, n_buckets)

    return ask


def _shared_classes(runs: Runs, ids: np.ndarray, answers: pa.Table):
    """Runs in shared buckets; their classes (bucket, refined) sorted, each run's class, each class's least id."""
    keys = distinct(runs.bucket)
    shared = sharing.shared_among(runs.bucket, keys, sharing.levels(answers))
    runs = Runs(*(x[shared] for x in runs))
    pair = np.empty(len(runs.lo), dtype=[("bucket", "<u8"), ("refined", "<u8")])
    pair["bucket"], pair["refined"] = runs.bucket, runs.refined
    order = np.lexsort((runs.refined, runs.bucket))
    ordered = pair[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    of_run = np.empty(len(order), np.int64)
    of_run[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[runs.doc][order], starts) if len(order) else np.zeros(0, np.int64)
    return runs, ordered[starts], of_run, least


def _round1(n_buckets: int, crowd: int):
    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        g = (texts if len(texts) else answers).column("g")[0].as_py()
        ids, data, offsets = _input(texts)
        _, classes, _, least = _shared_classes(_runs_of(data, offsets), ids, answers)
        entry, _ = _entries1(classes, crowd)
        bucket, name = classes["bucket"][entry], classes["refined"][entry].copy()
        name[_crowded(classes, crowd)[entry]] = CROWDED
        buckets, bounds = sharing.bucket_bounds(np.ascontiguousarray(bucket), n_buckets)
        fields = sharing.packed({"f": bucket.astype(np.uint32), "k": name, "d": least[entry].astype("<i8")}, bounds)
        return pa.table({"b": pa.array(buckets, pa.int32()), "g": pa.array(np.full(len(buckets), g), pa.int32()), **fields})

    return ask


def _crowded(classes: np.ndarray, crowd: int) -> np.ndarray:
    """Whether a class is in a bucket with very many classes of this group."""
    if not len(classes):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, classes["bucket"][1:] != classes["bucket"][:-1]])
    sizes = np.diff(np.r_[starts, len(classes)])
    return np.repeat(sizes > crowd // 16, sizes)


def _entries1(classes: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes that are sent in round 1 (the first of a crowded bucket, else all) and each class's place among them."""
    first = np.r_[True, classes["bucket"][1:] != classes["bucket"][:-1]][: len(classes)]
    sent = first | ~_crowded(classes, crowd)
    return np.flatnonzero(sent), np.cumsum(sent) - 1


def _first_of(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of each entry's key, and an order in which equal keys are together."""
    order = np.lexsort(keys)
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.r_[starts, len(ids)]))
    return least, order


def _settle1(crowd: int):
    def settle(table: pa.Table) -> pa.Table:
        """For every class its least id and the state of its bucket."""
        f, k, d = (sharing.unpacked(table, n, t) for n, t in (("f", "<u4"), ("k", "<u8"), ("d", "<i8")))
        least, order = _first_of([k, f], d)
        of, ok = f[order], k[order]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        parts = 1 + np.add.reduceat(np.r_[False, (ok[1:] != ok[:-1]) & (of[1:] == of[:-1])].astype(np.int64), starts)
        # The mark of a crowded bucket is the largest name, so it sorts last.
        crowded = (parts > crowd) | (ok[np.r_[starts[1:], len(of)] - 1] == CROWDED)
        kind = np.where(crowded, WINDOWS, np.where(parts > 1, SEVERAL, WHOLE)).astype(np.uint8)
        state = np.empty(len(f), np.uint8)
        state[order] = np.repeat(kind, np.diff(np.r_[starts, len(f)]))
        state[(state == SEVERAL) & (least == d)] = SPEAKS
        bounds = np.r_[0, np.cumsum([len(x) // 8 for x in table.column("d").to_pylist()])]
        return pa.table({"g": table.column("g"), "b": table.column("b"), **sharing.packed({"d": least, "s": state}, bounds)})

    return settle


def _of_kind(answers: pa.Table, kind: int) -> pa.Table:
    return sharing.in_order(answers.filter(pc.equal(answers.column("kind"), kind)))


class Contested(NamedTuple):
    """What round 1 left open in a group: entries to be compared, sorted by where they go, and what they stand for."""

    key: np.ndarray  # where an entry goes
    lo: np.ndarray  # first window's start of an entry
    count: np.ndarray  # its windows
    least: np.ndarray  # smallest document that has it here
    start: np.ndarray  # every window that an entry stands for,
    row: np.ndarray  # its document's row,
    entry: np.ndarray  # the entry
    nth: np.ndarray  # and its place in it


def _windows_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of some runs, and each one's place in its run."""
    sizes = hi - lo + 1
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(lo, sizes) + nth, nth


def _distinct_windows(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name of each window's content, one window of each distinct content, and each window's place among those."""
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = span_names(BYTE[data], start, start + WIN)
    order = np.argsort(name)
    content = data[start[order][:, None] + np.arange(WIN)]
    new = np.r_[True, (content[1:] != content[:-1]).any(axis=1)]
    place = np.empty(len(start), np.int64)
    place[order] = np.cumsum(new) - 1
    return name, order[new], place


def _contested(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, answers: pa.Table, crowd: int) -> tuple[Runs, Contested]:
    """Runs that are lost whole, and what is to be compared."""
    settled = _of_kind(answers, 1)
    runs, classes, of_run, low = _shared_classes(_runs_of(data, offsets), ids, _of_kind(answers, 0))
    _, sent = _entries1(classes, crowd)
    own, of_sent = ids[runs.doc], sent[of_run] if len(of_run) else of_run
    least, state = sharing.unpacked(settled, "d", "<i8")[of_sent], sharing.unpacked(settled, "s", "u1")[of_sent]
    lost = Runs(*(x[(state != WINDOWS) & (least < own)] for x in runs))
    # A class's smallest document speaks for it; its runs have the same bytes.
    speaks = np.flatnonzero((state == SPEAKS) & (least == own))
    classes_left, first, of_entry = np.unique(of_run[speaks], return_index=True, return_inverse=True)
    head = speaks[first]
    start_a, nth_a = _windows_of(runs.lo[speaks], runs.hi[speaks])
    sizes_a = runs.hi[speaks] - runs.lo[speaks] + 1
    # Windows of crowded buckets, one by one.
    alone = np.flatnonzero(state == WINDOWS)
    start_b, _ = _windows_of(runs.lo[alone], runs.hi[alone])
    row_b = np.repeat(runs.doc[alone], runs.hi[alone] - runs.lo[alone] + 1)
    name, chosen, place = _distinct_windows(data, start_b)
    least_b = np.full(len(chosen), sharing.NO_ID)
    np.minimum.at(least_b, place, ids[row_b])
    key = np.r_[runs.bucket[head], name[chosen]]
    order = np.argsort(key, kind="stable")
    moved = np.empty(len(order), np.int64)
    moved[order] = np.arange(len(order))
    return lost, Contested(
        key[order],
        np.r_[runs.lo[head], start_b[chosen]][order],
        np.r_[runs.hi[head] - runs.lo[head] + 1, np.ones(len(chosen), np.int64)][order],
        np.r_[low[classes_left], least_b][order],
        np.r_[start_a, start_b],
        np.r_[np.repeat(runs.doc[speaks], sizes_a), row_b],
        moved[np.r_[np.repeat(of_entry, sizes_a), len(head) + place]],
        np.r_[nth_a, np.zeros(len(start_b), np.int64)],
    )


def _round2(n_buckets: int, crowd: int):
    schema = pa.schema([("b", pa.int32()), ("g", pa.int32()), *((c, pa.binary()) for c in "fcdt")])

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts) or not len(answers):
            return schema.empty_table()
        ids, data, offsets = _input(texts)
        _, open_ = _contested(ids, data, offsets, answers, crowd)
        buckets, bounds = sharing.bucket_bounds(open_.key, n_buckets)
        sizes = open_.count + WIN - 1
        at, _ = _windows_of(open_.lo, open_.lo + sizes - 1)
        content = sharing.packed({"t": data[at]}, np.r_[0, np.cumsum(sizes)][bounds])
        numbers = {"f": open_.key.astype(np.uint32), "c": open_.count.astype(np.uint8), "d": open_.least.astype("<i8")}
        fields = sharing.packed(numbers, bounds) | content
        g = pa.array(np.full(len(buckets), texts.column("g")[0].as_py()), pa.int32())
        return pa.table({"b": pa.array(buckets, pa.int32()), "g": g, **fields}, schema)

    return ask


def bucket_pointers(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For every window of some entries the pointer of its bucket: equal for equal ``WIN``-byte strings only.

    Entry ``e`` lies at ``start[e]`` of ``data`` and has ``count[e]`` windows, so ``count[e] + WIN - 1`` bytes.
    """
    grams = np.zeros(len(data) + GRAM, np.uint64)
    for k in range(GRAM):  # the next eight bytes at every offset, as a number
        grams[: len(data) - k] |= data[k:].astype(np.uint64) << U(8 * (GRAM - 1 - k))
    pointer = np.zeros(len(data), np.int64)
    several = np.zeros(len(data), bool)

    def sort(at: np.ndarray, key: np.ndarray, base: np.ndarray | None) -> None:
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        heads = np.flatnonzero(new)
        bucket = np.cumsum(new) - 1
        if base is None:
            pointer[at] = heads[bucket]
        else:  # a part begins where its bucket began, after the parts before it
            base = base[order]
            first = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
            began = np.repeat(first, np.diff(np.r_[first, len(base)]))
            pointer[at] = base + heads[bucket] - began
        several[at] = (np.diff(np.r_[heads, len(at)]) > 1)[bucket]

    def reaching(depth: int) -> np.ndarray:
        """Suffixes of which so many bytes lie in their entry."""
        return _windows_of(start, start + count + WIN - 1 - depth)[0]

    at, depth = reaching(GRAM), GRAM
    sort(at, grams[at], None)
    while depth < WIN:
        step = min(depth, WIN - depth)
        at = reaching(depth + step)
        at = at[several[at]]
        own = pointer[at]
        if len(at):
            sort(at, own.astype(np.uint64) << U(32) | pointer[at + step].astype(np.uint64), own)
        depth += step
    return pointer[_windows_of(start, start + count - 1)[0]]


def _settle2(table: pa.Table) -> pa.Table:
    """For every entry the windows that a smaller document has too, one bit each."""
    count, d = sharing.unpacked(table, "c", "u1").astype(np.int64), sharing.unpacked(table, "d", "<i8")
    data, f = sharing.unpacked(table, "t", "u1"), sharing.unpacked(table, "f", "<u4")
    sizes = count + WIN - 1
    start = np.cumsum(sizes) - sizes
    mask = np.zeros(len(count), np.uint32)
    # Equal windows are in entries of one key, so a portion of the keys can be settled by itself.
    portion = (f.astype(np.uint64) * U(1 + len(data) // PORTION)) >> U(32)
    order = np.argsort(portion, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(portion[order])) + 1):
        c, n = count[some], sizes[some]
        at, _ = _windows_of(start[some], start[some] + n - 1)
        pointer = bucket_pointers(data[at], np.cumsum(n) - n, c)
        own = np.repeat(d[some], c)
        least, _ = _first_of([pointer], own)
        bit = _windows_of(np.zeros(len(c), np.int64), c - 1)[1].astype(np.uint32)
        mask[some] = np.bitwise_or.reduceat((least < own).astype(np.uint32) << bit, np.cumsum(c) - c)
    bounds = np.r_[0, np.cumsum([len(x) for x in table.column("c").to_pylist()])]
    return pa.table({"g": table.column("g"), "b": table.column("b"), **sharing.packed({"d": mask.astype("<u4")}, bounds)})


def _remove(crowd: int):
    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of one group with the removed spans and the bytes kept."""
        if not len(texts):
            return RESULT.empty_table()
        ids, data, offsets = _input(texts)
        lost, open_ = _contested(ids, data, offsets, answers, crowd)
        mask = sharing.unpacked(_of_kind(answers, 2), "d", "<u4")[open_.entry]
        gone = open_.start[((mask >> open_.nth.astype(np.uint32)) & 1 > 0) | (open_.least[open_.entry] < ids[open_.row])]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, lost.lo, 1)
        np.add.at(edge, lost.hi + WIN, -1)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WIN, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out: dict[str, list] = {"n_bytes": [], "starts": [], "ends": [], "kept": []}
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            c, text = covered[a:b], data[a:b]
            turns = np.flatnonzero(np.diff(np.r_[False, c, False]))
            out["n_bytes"].append(b - a)
            out["starts"].append(turns[::2])
            out["ends"].append(turns[1::2])
            out["kept"].append((text[~c] if len(turns) else text).tobytes())
        return pa.table([texts.column("doc_id"), *(pa.array(v, t.type) for v, t in zip(out.values(), list(RESULT)[1:], strict=True))], RESULT)

    return remove


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("kept", pa.binary()),
    ]
)


def _tagged(df: DataFrame, kind: int) -> DataFrame:
    """All answers in one shape: g, b, kind, level, d, s."""
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("binary").alias(c)
    return df.select("g", "b", F.lit(kind).alias("kind"), col("level"), col("d"), col("s"))


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", groups: int | None = None, crowd: int = 1024
) -> DataFrame:
    """doc_id, n_bytes, starts, ends (of the removed spans, in bytes), kept (the other bytes); a row per input row.

    ``crowd``: parts of a bucket, or sixteen times those in one group, from which its windows are
    dealt one by one; the result does not depend on it.
    """
    n, b = sharing.layout(docs, text_col, groups)
    texts = sharing.dealt(docs, id_col, text_col, n)
    by_group = texts.groupBy("g")
    level0 = sharing.answered(by_group.applyInArrow(_round0(b), sharing.ASK))
    asked1 = by_group.cogroup(level0.groupBy("g")).applyInArrow(_round1(b, crowd), "b int, g int, f binary, k binary, d binary")
    settled1 = asked1.groupBy("b").applyInArrow(_settle1(crowd), "g int, b int, d binary, s binary")
    so_far = _tagged(level0, 0).unionByName(_tagged(settled1, 1))
    asked2 = by_group.cogroup(so_far.groupBy("g")).applyInArrow(_round2(b, crowd), "b int, g int, f binary, c binary, d binary, t binary")
    settled2 = asked2.groupBy("b").applyInArrow(_settle2, "g int, b int, d binary")
    answers = so_far.unionByName(_tagged(settled2, 2))
    out = by_group.cogroup(answers.groupBy("g")).applyInArrow(
        _remove(crowd), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") != sharing.NO_ID, F.col("doc_id")))
