"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, names and units are typed placeholders, so a
benchmark question that was given other numbers or names has the same template. Windows of the
templates are hashed and joined. A window must keep ``least_literals`` plain words, so that
mostly empty templates match nothing. Matches of a document and an item on one diagonal (equal
distance of their places) belong together, and their slots must be consistent: wherever the
item repeats a value, the document must repeat its own value for it. A document is
contaminated by an item when consistent windows cover ``least_cover`` of the item's windows.
An item of which no window keeps that many has the shortest longer windows that do; one with
fewer plain words altogether is a single window that must match with the values in its slots.

* number: starts with a digit, or is a number word (English, German, French, Spanish); name: a
  capitalised word, or a run of them in one sentence (a word that opens a sentence is taken for
  one too, since "Tom has" and "Anna has" must agree; so what opens the item's sentences must
  be repeated consistently); unit: a unit word right after a number.

Scale: the texts do not shuffle. The hashes of the benchmark's windows filter the documents'
windows inside the scan while they number at most ``most_filter_windows`` (8 bytes each, counted
first); with a larger benchmark all windows go to the join instead. Only matches are joined, by
hash, and counted per document and item; a passage that a third of all documents share costs
its windows per document and no pairs of documents. Each further window size of the items costs
one more pass over the documents' tokens.

Defined results: a null or empty text is clean; items of fewer than ``least_literals`` tokens
are ignored, and an item shorter than a window is one window of its own length; equal
rows have equal results; a null id is kept; empty tables give an empty result, or all clean;
columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestitch.llm._hashing import BYTE, LOWER, U, join, portions, scramble, span_names, text_bytes, word_spans
from lodestitch.plans.materialize import materialize

LITERAL, NUMBER, NAME, UNIT = range(4)
#: Stand-ins of the placeholders.
_KIND = scramble(np.arange(4, dtype=np.uint64) + U(1 << 40))

#: Number words and unit words of four languages (fixed values, lower case).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre "
    "kilometres g kg mg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons tonne tonnes l ml liter "
    "liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
    "years s min h hr hrs percent cents dollar dollars euro euros usd eur gbp degree degrees celsius fahrenheit "
    "kelvin watt watts kw kwh volt volts amp amps hz khz mhz ghz mph kmh joule joules newton newtons pascal bar psi "
    "gramm kilogramm sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent grad "
    "mètre mètres kilomètre kilomètres gramme grammes kilogramme kilogrammes seconde secondes heure heures jour jours "
    "semaine semaines mois an ans pourcent degré degrés metro metros kilómetro kilómetros gramo gramos kilogramo "
    "kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados"
).split()


def _names_of(words: Sequence[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(list(words)))
    return np.sort(span_names(BYTE[data], offsets[:-1], offsets[1:]))


NUMBER_NAMES, UNIT_NAMES = _names_of(NUMBER_WORDS), _names_of(UNIT_WORDS)


def _in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


class Template(NamedTuple):
    row: np.ndarray
    name: np.ndarray  # of the word, or of its placeholder
    value: np.ndarray  # what fills the slot; 0 for a plain word


def template(data: np.ndarray, offsets: np.ndarray) -> Template:
    """Canonical tokens of some texts."""
    digit = (data >= 48) & (data <= 57)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        mid = data[1:-1]
        inner[1:-1] = ((mid == 46) | (mid == 44) | (mid == 58) | (mid == 47)) & digit[:-2] & digit[2:]
        inner[1:-1] |= ((mid == 39) | (mid == 45)) & letter[:-2] & letter[2:]
        marks = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)  # dashes and quotes outside ASCII
        for k in range(3):
            letter[k : len(data) - 2 + k] &= ~marks
    gap = ~(digit | letter | inner)
    starts, ends = word_spans(data, offsets, gap)
    lower = LOWER[data]
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        lower[1:][accented] += 0x20
    name = span_names(BYTE[lower], starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.r_[0, np.cumsum(gap & np.isin(data, np.frombuffer(b".!?:;\n", np.uint8)))]
    follows = np.zeros(len(starts), bool)  # the token before is in the same sentence
    follows[1:] = (row[1:] == row[:-1]) & (stops[starts[1:]] == stops[ends[:-1]])
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(starts) else first
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    number = ((first >= 48) & (first <= 57)) | _in(name, NUMBER_NAMES)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & follows[1:] & _in(name[1:], UNIT_NAMES)
    proper = capital & ~number & ~unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(proper, NAME, LITERAL)))
    goes_on = np.zeros(len(starts), bool)  # a further word of the same name
    # A word that opens a sentence is a slot of its own, whatever follows.
    opens = proper & ~follows
    goes_on[1:] = proper[1:] & proper[:-1] & follows[1:] & ~opens[:-1]
    head = np.flatnonzero(~goes_on)
    value = np.zeros(0, np.uint64)
    if len(head):
        place = np.arange(len(starts)) - head[np.cumsum(~goes_on) - 1]
        value = np.add.reduceat(scramble(name ^ place.astype(np.uint64)), head)
    kind, name, row = kind[head], name[head], row[head]
    return Template(row, np.where(kind == LITERAL, name, _KIND[kind]), np.where(kind == LITERAL, U(0), value))


def windows(t: Template, size: int, least_literals: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, token at which it starts, place in its text) of the windows with enough plain words.

    A negative ``size`` is of windows that count with what fills their slots, however few words are plain.
    """
    exact, size = size < 0, abs(size)
    n = len(t.row) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.r_[0, np.cumsum(t.value == 0)]
    good = (t.row[:n] == t.row[size - 1 :]) & (exact | (plain[size:] - plain[:n] >= min(least_literals, size)))
    at = np.flatnonzero(good)
    name = span_names(np.where(t.value == 0, t.name, join(t.name, t.value)) if exact else t.name, at, at + size)
    begin = np.searchsorted(t.row, np.arange(texts))
    return name ^ U(2 * size + exact), at, at - begin[t.row[at]]


def _item_sizes(t: Template, size: int, least_literals: int, items: int) -> np.ndarray:
    """The window size of each item, as ``windows`` takes it; 0: too short to be looked for."""
    length = np.bincount(t.row, minlength=items)
    words = np.flatnonzero(t.value == 0)
    need = min(least_literals, size)
    first, last = words[: max(len(words) - need + 1, 0)], words[need - 1 :]
    whole = t.row[first] == t.row[last]
    span = np.full(items, len(t.row) + 1)  # shortest that holds enough plain words
    np.minimum.at(span, t.row[first[whole]], (last - first + 1)[whole])
    some = np.minimum(length, np.maximum(span, size))
    return np.where(span <= length, some, np.where(length >= least_literals, -length, 0))


def _slots(t: Template, at: np.ndarray, size: int) -> list[np.ndarray]:
    return list(t.value.view(np.int64)[at[:, None] + np.arange(size)]) if len(at) else []


def _item_windows(size: int, least_literals: int):
    schema = pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("slots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            t, ids = template(data, offsets), batch.column("item_id")
            own = _item_sizes(t, size, least_literals, len(ids))
            for w in np.unique(own[own != 0]).tolist():
                h, at, place = windows(t, w, least_literals, len(ids))
                mine = own[t.row[at]] == w
                h, at, place = h[mine], at[mine], place[mine]
                if len(h):
                    columns = [h.view(np.int64), ids.take(pa.array(t.row[at])), place, np.full(len(h), w), _slots(t, at, abs(w))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _document_windows(sizes: list[int], least_literals: int, wanted):
    schema = pa.schema([("uid", pa.string()), ("h", pa.int64()), ("place", pa.int64()), ("filled", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in portions(offsets, 1 << 20):
                t = template(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for w in sizes:
                    h, at, place = windows(t, w, least_literals, b - a)
                    if wanted is not None:
                        hit = _in(h, wanted.value)
                        h, at, place = h[hit], at[hit], place[hit]
                    if len(h):
                        columns = [batch.column("uid").take(pa.array(a + t.row[at])), h.view(np.int64), place, _slots(t, at, abs(w))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                        )

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 8,
    least_literals: int = 4,
    least_cover: float = 0.5,
    most_filter_windows: int = 4_000_000,
) -> DataFrame:
    """doc_id, contaminated, items (ids of the benchmark items found, sorted); one row per input row."""
    hits = _items_found(docs, benchmark, id_col, text_col, item_id, item_text, size, least_literals, least_cover, most_filter_windows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("uid"))
    return rows.join(hits, "uid", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    )


def keep_clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 8,
    least_literals: int = 4,
    least_cover: float = 0.5,
    most_filter_windows: int = 4_000_000,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found."""
    hits = _items_found(docs, benchmark, id_col, text_col, item_id, item_text, size, least_literals, least_cover, most_filter_windows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("uid"))
    few = hits.count() <= most_filter_windows // 40  # a key takes about 40 bytes
    found = hits.select("uid")
    return rows.join(F.broadcast(found) if few else found, "uid", "left_anti").select("row.*")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: the id, and a hash for rows that share one. Equal rows have equal results and share it."""
    known = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.concat(known, F.lit("-"), F.hex(F.xxhash64(F.col(text_col).cast("string"))))


def _items_found(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str,
    text_col: str,
    item_id: str,
    item_text: str,
    size: int,
    least_literals: int,
    least_cover: float,
    most_filter_windows: int,
) -> DataFrame:
    """uid, items: of the rows in which items are found."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    known = materialize(
        items.where("text is not null and item_id is not null").mapInArrow(
            _item_windows(size, least_literals), "h long, item_id long, at long, size int, slots array<long>"
        )
    )
    sizes = sorted(known.select("size").distinct().toArrow().column("size").to_pylist())
    wanted = None
    if known.count() <= most_filter_windows:
        hashes = known.select("h").distinct().toArrow().column("h").to_numpy()
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(hashes.view(np.uint64)))
    d = docs.select(row_key(id_col, text_col).alias("uid"), F.col(text_col).cast("string").alias("text"))
    found = d.where("text is not null").mapInArrow(
        _document_windows(sizes, least_literals, wanted), "uid string, h long, place long, filled array<long>"
    )
    matches = found.join(known, "h").withColumn("diagonal", F.col("place") - F.col("at"))
    matches = materialize(matches.select("uid", "item_id", "at", "diagonal", "slots", "filled").distinct())
    line = ["uid", "item_id", "diagonal"]
    broken = (
        matches.select(*line, F.explode(F.filter(F.arrays_zip("slots", "filled"), lambda s: s["slots"] != 0)).alias("s"))
        .groupBy(*line, "s.slots")
        .agg(F.count_distinct("s.filled").alias("values"))
        .where("values > 1")
        .select(*line)
        .distinct()
    )
    whole = known.groupBy("item_id").agg(F.count_distinct("at").alias("windows"))
    return materialize(
        matches.join(broken, line, "left_anti")
        .groupBy("uid", "item_id")
        .agg(F.count_distinct("at").alias("covered"))
        .join(whole, "item_id")
        .where(F.col("covered") >= F.col("windows") * least_cover)
        .groupBy("uid")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
