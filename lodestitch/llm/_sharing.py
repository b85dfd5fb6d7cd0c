"""Which keys of a corpus occur in more than one place, without a row per key.

A corpus is dealt into groups of a few MB by a hash of id and text; how many is found from the
bytes of all texts. A group names its keys (64-bit), removes its own repeats, and sends each
bucket of keys one packed row of short fingerprints. A bucket adds up the fingerprints over all groups and answers every group with
one byte per key, in the order sent. So each key costs about five bytes of shuffle there and
one back, a key that occurs in every document costs one entry per group, and the group side is
the same shuffle of the texts each time (Spark reuses the exchange).

A fingerprint has 32 bits beside its bucket. Two keys that collide only look shared: what is
built on these answers must stay right when an unshared key passes for a shared one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = 2**63 - 1

#: Bytes of text of a group at first, and how many groups there are before groups grow instead, up to the last.
GROUP_BYTES, MANY_GROUPS, MOST_GROUP_BYTES = 4 << 20, 4096, 32 << 20
#: Bytes of text whose keys a bucket holds.
BUCKET_BYTES = 4 << 20
FEWEST = 16


def layout(docs: DataFrame, text_col: str, groups: int | None = None) -> tuple[int, int]:
    """How many groups of documents and how many buckets of keys: by the bytes of all texts, counted first.

    A task holds one group or one bucket at a time, so its memory does not depend on the size of
    the corpus or on the session's shuffle width. A group sends a bucket one row at most and only
    for keys that it has, so there are never more packed rows than keys.
    """
    if groups:
        return groups, max(8, groups // 2)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    size = min(max(GROUP_BYTES, total // MANY_GROUPS), MOST_GROUP_BYTES)
    return max(FEWEST, -(-total // size)), max(FEWEST, -(-total // BUCKET_BYTES))


def dealt(docs: DataFrame, id_col: str, text_col: str, groups: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """g, doc_id, text, carry_0 ... A null id becomes the largest number, so that it never comes first.

    An id that very many rows have is spread by their texts.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    spread = F.xxhash64(key, F.col(text_col).cast("string"))
    return docs.select(
        F.pmod(spread, F.lit(groups)).cast("int").alias("g"),
        key.alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    )


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with nulls allowed at every level, as Spark takes results."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(nullable(kind.key_type), nullable(kind.item_type))
    return kind


def bucket_bounds(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the buckets that have some, and where each starts, with the end."""
    buckets = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return buckets[starts].astype(np.int64), np.r_[starts, len(keys)]


def packed(columns: dict[str, np.ndarray], bounds: np.ndarray) -> dict[str, pa.Array]:
    """Each column cut at the bounds into binary values."""
    out = {}
    for name, values in columns.items():
        values = np.ascontiguousarray(values)
        out[name] = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
    return out


def unpacked(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    """All values of a binary column, one after the other."""
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist()), dtype=dtype)


def in_order(table: pa.Table, column: str = "b") -> pa.Table:
    return table.sort_by([(column, "ascending")])


def ask(keys: np.ndarray, counts: np.ndarray, g: int, n_buckets: int) -> pa.Table:
    """The packed rows of one group: sorted distinct ``keys`` and in how many places each was met."""
    buckets, bounds = bucket_bounds(keys, n_buckets)
    fields = packed({"f": keys.astype(np.uint32), "n": np.minimum(counts, 255).astype(np.uint8)}, bounds)
    return pa.table({"b": pa.array(buckets, pa.int32()), "g": pa.array(np.full(len(buckets), g), pa.int32()), **fields})


ASK = "b int, g int, f binary, n binary"
ANSWER = "g int, b int, level binary"


def _add_up(table: pa.Table) -> pa.Table:
    f, n = unpacked(table, "f", "<u4"), unpacked(table, "n", "u1")
    sizes = np.array([len(x) for x in table.column("n").to_pylist()])
    order = np.argsort(f)
    ordered = f[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    totals = np.add.reduceat(n[order].astype(np.int64), starts)
    level = np.empty(len(f), np.uint8)
    level[order] = np.repeat(np.ceil(np.log2(totals + 1)).astype(np.uint8), np.diff(np.r_[starts, len(f)]))
    bounds = np.r_[0, np.cumsum(sizes)]
    return pa.table({"g": table.column("g"), "b": table.column("b"), **packed({"level": level}, bounds)})


def answered(asked: DataFrame) -> DataFrame:
    """g, b, level: for each key asked, the bit length of the number of places (1: one place only)."""
    return asked.groupBy("b").applyInArrow(_add_up, ANSWER)


def shared_among(keys: np.ndarray, ordered: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Whether each of ``keys`` is met in several places; ``level``: the answers for the sorted distinct keys."""
    several = ordered[level > 1]
    if not len(several):
        return np.zeros(len(keys), bool)
    shift = np.uint64(64 - max(16, int(len(several) * 16).bit_length()))
    maybe = np.zeros(1 << (64 - int(shift)), bool)
    maybe[several >> shift] = True
    out = maybe[keys >> shift]
    at = np.flatnonzero(out)
    found = np.searchsorted(several, keys[at])
    out[at] = several[np.minimum(found, len(several) - 1)] == keys[at]
    return out


def levels(answers: pa.Table) -> np.ndarray:
    """The answers of one group, in the order of its sorted keys."""
    return unpacked(in_order(answers), "level", "u1")
