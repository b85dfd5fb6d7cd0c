"""Near-duplicate lines by a deletion-neighbourhood join.

A line is a sequence of lower-cased words. Two lines are near when at most one word is
replaced, inserted or deleted, provided the longer has ``edit_words`` words or more; shorter
lines, down to a single word, must be equal (a line without words is no line and stays). A line
is removed when an earlier line (by document id, then line number) is near it, whether or not
that one is removed itself. The bound does not grow beyond one word: the variants within k
deletions number as the k-th power of a line's words.

* Equal lines first: for every distinct line the earliest place is found, and only that place
  speaks for the line from then on.
* Every distinct line of enough words emits its variants, the line without each of its words,
  and itself, as 64-bit keys. Packed fingerprints (``_sharing``) tell which keys another line
  has too; most lines end here.
* The keys that are left are joined. Lines meet on a key when they lack the same place (a
  replaced word) or when one of them is whole (an insertion). For each key and place a group of
  documents sends its earliest line only, with its words once per key, so that a line with
  thousands of variants costs an entry per group and makes no pairs.
* Each line gets the earliest line of its keys back, the edit distance of the two is verified
  on their words, and the line goes if that one is earlier.

Scale: the texts shuffle once; keys cost about five bytes each; hot lines are combined before
they shuffle. Memory of a task is that of a group of documents.

Defined results: a null text has no lines and stays null; a text without a removed line stays
as it is, byte by byte; a null id comes after all others; lines of rows with equal ids count in
the order of their line numbers (equal numbers do not remove each other); an empty table gives
an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestitch.llm import _sharing as sharing
from lodestitch.llm._hashing import _power, BYTE, LOWER, distinct, portions, scramble, span_names, text_bytes, word_spans

WHOLE = np.int32(-1)
RESULT = "doc_id long, text string, n_lines long, removed_lines array<int>"


class Lines(NamedTuple):
    """The lines of a group that take part: where they are and what they hold."""

    doc: np.ndarray  # id
    number: np.ndarray  # line number in the text
    row: np.ndarray  # text's row in the group
    name: np.ndarray
    first: np.ndarray  # first word
    count: np.ndarray  # words
    words: np.ndarray  # names of all words of the group
    per_text: np.ndarray  # lines of each text


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of every word."""
    starts, names = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in portions(offsets, 1 << 18):
        part = data[offsets[a] : offsets[b]]
        first, past = word_spans(part, offsets[a : b + 1] - offsets[a])
        starts.append(first + offsets[a])
        names.append(span_names(BYTE[LOWER[part]], first, past))
    return np.concatenate(starts), np.concatenate(names)


def _lines(texts: pa.Table, least_words: int) -> Lines:
    ids = texts.column("doc_id").to_numpy()
    data, offsets = text_bytes(texts.column("text"))
    starts, words = _words(data, offsets)
    breaks = np.flatnonzero(data == 10) + 1
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    heads = np.r_[offsets[:-1][full], breaks]
    head_row = np.r_[full, np.searchsorted(offsets, breaks - 1, side="right") - 1]
    order = np.lexsort((heads, head_row))
    heads, head_row = heads[order], head_row[order]
    per_text = np.bincount(head_row, minlength=len(ids))
    number = np.arange(len(heads)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    first = np.searchsorted(starts, heads)
    count = np.diff(np.r_[first, len(starts)])
    some = count >= least_words
    first, count = first[some], count[some]
    name = span_names(words, first, first + count)
    row = head_row[some]
    return Lines(ids[row], number[some].astype(np.int32), row, name, first, count, words, per_text)


def _distinct(lines: Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names, the earliest line of each, and each line's place among the names."""
    order = np.lexsort((lines.number, lines.doc, lines.name))
    named = lines.name[order]
    new = np.r_[True, named[1:] != named[:-1]] if len(named) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return named[new], order[new], place


def _rows(buckets: np.ndarray, g: int, fields: dict) -> pa.Table:
    return pa.table({"b": pa.array(buckets, pa.int32()), "g": pa.array(np.full(len(buckets), g), pa.int32()), **fields})


def _group_of(*tables: pa.Table) -> int:
    return next((t.column("g")[0].as_py() for t in tables if len(t)), 0)


def _ask_places(n_buckets: int, least_words: int):
    def ask(texts: pa.Table) -> pa.Table:
        lines = _lines(texts, least_words)
        names, at, _ = _distinct(lines)
        buckets, bounds = sharing.bucket_bounds(names, n_buckets)
        return _rows(
            buckets, _group_of(texts), sharing.packed({"k": names, "d": lines.doc[at], "l": lines.number[at]}, bounds)
        )

    return ask


def _settle_places(table: pa.Table) -> pa.Table:
    """The earliest place of every distinct line."""
    k, d, n = (sharing.unpacked(table, c, t) for c, t in (("k", "<u8"), ("d", "<i8"), ("l", "<i4")))
    order = np.lexsort((n, d, k))
    new = np.r_[True, k[order][1:] != k[order][:-1]]
    source = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    best = np.empty(len(k), np.int64)
    best[order] = source
    bounds = np.r_[0, np.cumsum([len(x) // 8 for x in table.column("k").to_pylist()])]
    return pa.table({"g": table.column("g"), "b": table.column("b"), **sharing.packed({"d": d[best], "l": n[best]}, bounds)})


def _spoken(lines: Lines, answers: pa.Table):
    """Names, earliest lines here, places, earliest (doc, line) anywhere, and which names this group speaks for."""
    names, at, place = _distinct(lines)
    own = sharing.in_order(answers)
    doc, number = sharing.unpacked(own, "d", "<i8"), sharing.unpacked(own, "l", "<i4")
    speaks = (doc == lines.doc[at]) & (number == lines.number[at])
    return names, at, place, doc, number, speaks


def _variants(lines: Lines, which: np.ndarray, edit_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, place of the missing word) of the given lines; the line itself has place -1."""
    some = which[lines.count[which] >= edit_words - 1]
    cut = which[lines.count[which] >= edit_words]
    sizes = lines.count[cut]
    line = np.repeat(cut, sizes)
    j = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    up, down = _power(len(lines.words) + 2)
    total = np.zeros(len(lines.words) + 1, dtype=np.uint64)
    np.cumsum(lines.words * up[: len(lines.words)], out=total[1:])
    s, e = lines.first[line], lines.first[line] + lines.count[line]
    before = (total[s + j] - total[s]) * down[s]
    after = (total[e] - total[s + j + 1]) * down[s + 1]
    key = scramble(before + after + (e - s - 1).astype(np.uint64))
    return np.r_[lines.name[some], key], np.r_[some, line], np.r_[np.full(len(some), WHOLE), j.astype(np.int32)]


def _ask_variants(n_buckets: int, least_words: int, edit_words: int):
    def ask(texts: pa.Table, places: pa.Table) -> pa.Table:
        if not len(texts):
            return sharing.ask(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, n_buckets)
        lines = _lines(texts, least_words)
        _, at, _, _, _, speaks = _spoken(lines, places)
        key, line, place = _variants(lines, at[speaks], edit_words)
        # Leaving out either of two equal neighbours gives the same key: a line counts once.
        word = lines.first[line] + np.maximum(place, 0)
        again = (place > 0) & (lines.words[word] == lines.words[np.maximum(word - 1, 0)])
        keys, counts = np.unique(key[~again], return_counts=True)
        return sharing.ask(keys, counts, _group_of(texts), n_buckets)

    return ask


def _of_kind(answers: pa.Table, kind: int) -> pa.Table:
    return sharing.in_order(answers.filter(pc.equal(answers.column("kind"), kind)))


def _meeting(texts: pa.Table, answers: pa.Table, least_words: int, edit_words: int):
    """Keys that another line has too: the lines, and sorted by (key, place, id, number): key, line, place, entries' starts."""
    lines = _lines(texts, least_words)
    spoken = _spoken(lines, _of_kind(answers, 0))
    key, line, place = _variants(lines, spoken[1][spoken[5]], edit_words)
    if len(key):
        shared = sharing.shared_among(key, distinct(key), sharing.levels(_of_kind(answers, 1)))
        key, line, place = key[shared], line[shared], place[shared]
    order = np.lexsort((lines.number[line], lines.doc[line], place, key))
    key, line, place = key[order], line[order], place[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])] if len(key) else np.zeros(0, bool)
    return lines, spoken, key, line, place, new


def _word_lists(lines: Lines, which: np.ndarray) -> list[bytes]:
    return [lines.words[a : a + n].tobytes() for a, n in zip(lines.first[which].tolist(), lines.count[which].tolist(), strict=True)]


SENT = "b int, g int, k long, j binary, d long, l int, w binary"
PARTNERS = "g int, k long, j binary, pd long, pl int, w binary"


def _send_lines(n_buckets: int, least_words: int, edit_words: int):
    """One row per key and line, with the line's words once and all places at which it is the group's earliest."""

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lines, _, key, line, place, new = _meeting(texts, answers, least_words, edit_words)
        key, line, place = key[new], line[new], place[new]
        order = np.lexsort((place, line, key))
        key, line, place = key[order], line[order], place[order].astype("<i4")
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]) if len(key) else np.zeros(0, np.int64)
        places = sharing.packed({"j": place}, np.r_[starts, len(key)])["j"]
        key, line = key[starts], line[starts]
        b = (((key >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
        return pa.table(
            {
                "b": pa.array(b, pa.int32()),
                "g": pa.array(np.full(len(key), _group_of(texts)), pa.int32()),
                "k": pa.array(key.view(np.int64), pa.int64()),
                "j": places,
                "d": pa.array(lines.doc[line], pa.int64()),
                "l": pa.array(lines.number[line], pa.int32()),
                "w": pa.array(_word_lists(lines, line), pa.binary()),
            }
        )

    return send


def _earliest_partner(table: pa.Table) -> pa.Table:
    """For each entry the earliest line it meets: same key and place, or the same key and one of the two whole."""
    sizes = np.array([len(x) // 4 for x in table.column("j").to_pylist()])
    row = np.repeat(np.arange(len(sizes)), sizes)
    j = sharing.unpacked(table, "j", "<i4")
    k, d, n = (table.column(c).to_numpy()[row] for c in ("k", "d", "l"))
    order = np.lexsort((n, d, j, k))
    ks, js = k[order], j[order]
    new_key = np.r_[True, ks[1:] != ks[:-1]]
    new_place = new_key | np.r_[True, js[1:] != js[:-1]]
    heads = order[np.flatnonzero(new_place)]  # earliest of each key and place
    head_of = np.cumsum(new_place) - 1
    by_key = np.lexsort((n[heads], d[heads], k[heads]))
    new = np.r_[True, k[heads][by_key][1:] != k[heads][by_key][:-1]]
    over_all = heads[by_key[np.flatnonzero(new)]]  # earliest of each key, keys sorted
    key_of = np.cumsum(new_key) - 1
    whole_first = order[np.flatnonzero(new_key)]  # place -1 sorts first
    has_whole = j[whole_first] == WHOLE
    same, whole = heads[head_of], whole_first[key_of]
    whole_earlier = has_whole[key_of] & ((d[whole] < d[same]) | ((d[whole] == d[same]) & (n[whole] < n[same])))
    source = np.empty(len(k), np.int64)
    source[order] = np.where(js == WHOLE, over_all[key_of], np.where(whole_earlier, whole, same))
    earlier = (d[source] < d) | ((d[source] == d) & (n[source] < n))
    # A group's other lines of this key and place may come later than its own earliest one.
    source = row[np.where(earlier, source, np.arange(len(k)))]
    order = np.lexsort((j, source, row))
    row, source, j = row[order], source[order], j[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (source[1:] != source[:-1])])
    own, other = pa.array(row[starts]), pa.array(source[starts])
    return pa.table(
        {
            "g": table.column("g").take(own), "k": table.column("k").take(own),
            "j": sharing.packed({"j": j}, np.r_[starts, len(j)])["j"],
            "pd": table.column("d").take(other), "pl": table.column("l").take(other), "w": table.column("w").take(other),
        }
    )


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one replaced, inserted or deleted word at most parts the two."""
    if abs(len(a) - len(b)) > 1:
        return False
    least = min(len(a), len(b))
    front = least if np.array_equal(a[:least], b[:least]) else int(np.argmin(a[:least] == b[:least]))
    if len(a) == len(b):
        return np.array_equal(a[front + 1 :], b[front + 1 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return np.array_equal(long[front + 1 :], short[front:])


def _rewrite(least_words: int, edit_words: int, carried: int):
    def rewrite(texts: pa.Table, answers: pa.Table) -> pa.Table:
        lines, (_, at, place, doc, number, _), key, line, missing, _ = _meeting(texts, answers, least_words, edit_words)
        if not len(lines.name):
            gone = np.zeros(0, bool)
        else:
            # Not the earliest of equal lines, or a near line is earlier than the earliest of them.
            gone = (doc[place] < lines.doc) | ((doc[place] == lines.doc) & (number[place] < lines.number))
            near = np.zeros(len(at), bool)
            partners = answers.filter(pc.equal(answers.column("kind"), 2))
            columns = (partners.column(c).to_pylist() for c in ("k", "j", "pd", "pl", "w"))
            found = {
                (k, j): (d, n, w)
                for k, places, d, n, w in zip(*columns, strict=True)
                for j in np.frombuffer(places, "<i4").tolist()
            }
            for k, j, x in zip(key.view(np.int64).tolist(), missing.tolist(), line.tolist(), strict=True):
                d, n, w = found[k, j]
                if not near[place[x]] and (d, n) < (lines.doc[x], lines.number[x]) and within_one_edit(
                    np.frombuffer(w, "<u8"), lines.words[lines.first[x] : lines.first[x] + lines.count[x]]
                ):
                    near[place[x]] = True
            gone |= near[place]
        removed: dict[int, list[int]] = {}
        for r, n in zip(lines.row[gone].tolist(), lines.number[gone].tolist(), strict=True):
            removed.setdefault(r, []).append(n)
        out = texts.column("text").to_pylist()
        for r, drop in removed.items():
            drop_set = set(drop)
            out[r] = "\n".join(x for i, x in enumerate(out[r].split("\n")) if i not in drop_set)
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "text": pa.array(out, pa.string()),
                "n_lines": pa.array(lines.per_text, pa.int64()),
                "removed_lines": pa.array([removed.get(r, []) for r in range(len(out))], pa.list_(pa.int32())),
            }
            | {f"carry_{i}": (c := texts.column(f"carry_{i}")).cast(sharing.nullable(c.type)) for i in range(carried)}
        )

    return rewrite


def _tagged(df: DataFrame, kind: int) -> DataFrame:
    """All answers in one shape; what an answer does not have is null."""
    shape = {
        "g": "int", "b": "int", "level": "binary", "d": "binary", "l": "binary",
        "k": "long", "j": "binary", "pd": "long", "pl": "int", "w": "binary",
    }
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()]
    return df.select(F.lit(kind).alias("kind"), *cols)


def remove_near_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 1,
    edit_words: int = 8,
    groups: int | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text (the kept lines), n_lines, removed_lines (their numbers); one row per input row.

    ``carry``: further columns of the input to return with each row; they may not be called as
    one of the four.
    """
    g, n = sharing.layout(docs, text_col, groups)
    texts = sharing.dealt(docs, id_col, text_col, g, carry).groupBy("g")
    places = texts.applyInArrow(_ask_places(n, least_words), "b int, g int, k binary, d binary, l binary").groupBy("b")
    places = places.applyInArrow(_settle_places, "g int, b int, d binary, l binary")
    asked = texts.cogroup(places.groupBy("g")).applyInArrow(_ask_variants(n, least_words, edit_words), sharing.ASK)
    so_far = _tagged(places, 0).unionByName(_tagged(sharing.answered(asked), 1))
    sent = texts.cogroup(so_far.groupBy("g")).applyInArrow(
        _send_lines(n, least_words, edit_words), SENT
    )
    partners = sent.groupBy("b").applyInArrow(_earliest_partner, PARTNERS)
    answers = so_far.unionByName(_tagged(partners, 2))
    types = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    out = texts.cogroup(answers.groupBy("g")).applyInArrow(_rewrite(least_words, edit_words, len(carry)), RESULT + types)
    known = F.when(F.col("doc_id") != sharing.NO_ID, F.col("doc_id")).alias("doc_id")
    kept = [F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)]
    return out.select(known, "text", "n_lines", "removed_lines", *kept)
