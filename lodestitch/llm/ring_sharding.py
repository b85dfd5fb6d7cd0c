"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring that is cut into ``cells`` equal cells; a
row starts in the cell of its id's hash and prefers the shards in clockwise order of their
points. Loads are bounded by quotas: ``rows // shards`` rows, and one more for the first
``rows % shards`` shards, so counts differ by one at most. A row whose shard is full continues
clockwise: in hop ``r`` all rows that are still without a shard try, in ring order, the
``r``-th distinct shard of their cell.

The law that holds is ``rows`` (balance is exact; the price is that a row's shard depends on
the whole table, not on its id alone, so ``grown_shard`` is null). Of 100,000 ids a 25th shard
moves 5.7 %, where 4 % is the least possible.

Scale: only the count of each cell (``cells`` rows at most, a parameter, whatever the input)
reaches the driver, which lays out the hops cell by cell and returns one segment for each run
of rows of a cell that go to the same shard. Rows get consecutive numbers over ranges of the
ring, so a cell with very many rows, even one id with a third of them, is spread; they carry id,
size, checksum and hash only, never the text. The segment table has at most ``cells * shards``
rows and is broadcast on that bound.

Defined results: a null text has size 8 and the checksum of no bytes; a null id takes its place
on the ring from the text; rows with equal ids start in the same cell and are separate rows;
ties are ordered by id, checksum and size, rows equal in all of these are alike; an empty table
gives an empty result; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.plans.numbering import row_numbers

#: Hex digits of the md5 that make a ring position.
DIGITS = 13
SPAN = 16**DIGITS


def _position(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long")


def clockwise_preferences(shards: int, virtual_nodes: int, cells: int) -> list[list[int]]:
    """For each cell the shards in clockwise order of their first point at or after it."""
    from hashlib import md5

    at: dict[int, list[tuple[int, int]]] = {}
    for s in range(shards):
        for v in range(virtual_nodes):
            p = int(md5(f"shard-{s}-{v}".encode()).hexdigest()[:DIGITS], 16)
            at.setdefault(p * cells // SPAN, []).append((p, s))
    owners = [[s for _, s in sorted(at.get(c, []))] for c in range(cells)]
    out: list[list[int]] = []
    for c in range(cells):
        seen: list[int] = []
        for step in range(cells):
            for s in owners[(c + step) % cells]:
                if s not in seen:
                    seen.append(s)
            if len(seen) == shards:
                break
        out.append(seen)
    return out


def lay_out(
    counts: dict[int, int], preferences: Sequence[Sequence[int]], shards: int
) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, from, to, shard, slot of the first row); ranks in a cell start at 0, ``to`` is exclusive."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    load, placed, segments = [0] * shards, dict.fromkeys(counts, 0), []
    for hop in range(shards):
        for cell in sorted(counts):
            left = counts[cell] - placed[cell]
            if not left:
                continue
            s = preferences[cell][hop]
            if take := min(left, room[s] - load[s]):
                segments.append((cell, placed[cell], placed[cell] + take, s, load[s]))
                placed[cell] += take
                load[s] += take
    return segments


def shard_rows(
    docs: DataFrame,
    shards: int = 24,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    virtual_nodes: int = 128,
    cells: int = 4096,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per input row."""
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("string")
    data = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    place = F.coalesce(key, F.concat(F.lit("text-"), F.md5(data)))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        _position(place).alias("pos"),
    ).withColumn("cell", F.floor(F.col("pos") / F.lit(SPAN // cells)).cast("int"))
    order = (F.col("pos"), F.asc_nulls_last("doc_id"), F.col("text_crc32"), F.col("size"), F.col("row"))
    numbered = row_numbers(rows.withColumn("row", F.monotonically_increasing_id()), *order)
    counts = {r["cell"]: r["count"] for r in numbered.groupBy("cell").count().collect()}
    begin = dict(zip(sorted(counts), accumulate((counts[c] for c in sorted(counts)), initial=1), strict=False))
    segments = [
        (cell, begin[cell] + a, begin[cell] + b, shard, slot)
        for cell, a, b, shard, slot in lay_out(counts, clockwise_preferences(shards, virtual_nodes, cells), shards)
    ]
    plan = docs.sparkSession.createDataFrame(segments, "cell int, first long, past long, shard int, slot0 long")
    inside = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("past"))
    return (
        numbered.join(F.broadcast(plan), "cell")
        .where(inside)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("slot0") + F.col("number") - F.col("first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
