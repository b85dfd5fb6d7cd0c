"""Typed attributes read from normalized text, each with its source, method and confidence.

A bag is ``map<string, struct<value_str, value_num, source, method, confidence>>``; one of the
two values is set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.text import let, number_text

ATTRIBUTE = "struct<value_str:string,value_num:double,source:string,method:string,confidence:double>"
BAG = f"map<string,{ATTRIBUTE}>"


def attribute(
    source: Column, confidence: float | Column, *, text: Column | None = None, number: Column | None = None, method: str = "rule"
) -> Column:
    """One attribute value; confidence has four decimals."""
    level = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        (F.lit(None) if text is None else text).cast("string").alias("value_str"),
        (F.lit(None) if number is None else number).cast("double").alias("value_num"),
        source.cast("string").alias("source"),
        F.lit(method).alias("method"),
        (F.floor(level * 10000 + 0.5) / 10000).alias("confidence"),
    )


def value_text(value: Column) -> Column:
    """The value as one canonical string (whole numbers without a point); null stays null."""
    number = F.when(
        value["value_num"] == F.floor(value["value_num"]), value["value_num"].cast("decimal(20,0)").cast("string")
    ).otherwise(value["value_num"].cast("string"))
    return F.coalesce(F.upper(F.trim(value["value_str"])), number)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


class _Match:
    """A case-insensitive pattern on one text."""

    def __init__(self, text: Column, pattern: str, case: bool = False):
        self.text, self.pattern = text, pattern if case else "(?i)" + pattern
        self.found = text.rlike(self.pattern)

    def group(self, *numbers: int) -> Column:
        return F.coalesce(*[_group(self.text, self.pattern, i) for i in numbers])

    @property
    def source(self) -> Column:
        return F.regexp_extract(self.text, self.pattern, 0)

    def text_value(self, value: Column, confidence: float, method: str = "rule") -> Column:
        return F.when(self.found, attribute(self.source, confidence, text=value, method=method))

    def number(self, value: Column, confidence: float) -> Column:
        return F.when(self.found, attribute(self.source, confidence, number=value))


def _spaced(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), r"\s+", " ")


def material(text: Column) -> Column:
    """The first grade whose pattern fits; a bare stainless mention counts less."""
    found = [
        _Match(text, p).text_value(F.lit(name), 0.70 if name == "STAINLESS STEEL" else 0.98) for name, p in R.MATERIALS
    ]
    return F.coalesce(*found)


def maker(text: Column) -> Column:
    """A known name, else a part number."""
    name, part = _Match(text, rf"\b({R.MAKERS})\b"), _Match(text, R.PART_NUMBER)
    return F.coalesce(name.text_value(F.upper(name.group(1)), 0.95), part.text_value(F.upper(part.group(1)), 0.70))


def nominal_size(text: Column) -> Column:
    m = _Match(text, r"\bDN\s*(\d{1,4})\b")
    return m.text_value(F.concat(F.lit("DN"), m.group(1).cast("int").cast("string")), 0.98)


def pressure_class(text: Column) -> Column:
    """An explicit class marker, else the PN notation as it stands."""
    cl, pn = _Match(text, R.CLASS_PATTERN), _Match(text, R.PN_PATTERN)
    return F.coalesce(
        cl.text_value(F.concat(F.lit("CL"), cl.group(1, 2, 3)), 0.98),
        pn.text_value(F.concat(F.lit("PN"), pn.group(1).cast("int").cast("string")), 0.95),
    )


def _fixed(name: str, source: str, confidence: float) -> Column:
    return attribute(F.lit(source), confidence, text=F.lit(name))


def valve_attributes(text: Column) -> dict[str, Column]:
    end, standard = _Match(text, R.END_PATTERN), _Match(text, R.VALVE_STANDARD)
    flanged = F.regexp_replace(F.upper(end.group(1)), "^FLANGE$", "FLANGED")
    return {
        "item_type": _fixed("GATE VALVE", "gate valve", 0.99),
        "size": nominal_size(text),
        "material": material(text),
        "pressure_class": pressure_class(text),
        "end_connection": end.text_value(flanged, 0.92),
        "standard": standard.text_value(_spaced(standard.group(1)), 0.95),
        "oem": maker(text),
    }


def pipe_attributes(text: Column) -> dict[str, Column]:
    schedule, standard, kind = _Match(text, R.SCHEDULE_PATTERN), _Match(text, R.PIPE_STANDARD), _Match(text, R.PIPE_TYPE)
    grade = F.coalesce(F.concat(F.lit("SCH"), F.upper(schedule.group(1))), F.upper(schedule.group(2)))
    return {
        "item_type": _fixed("PIPE", "pipe", 0.99),
        "size": nominal_size(text),
        "material": material(text),
        "schedule": schedule.text_value(grade, 0.97),
        "standard": standard.text_value(_spaced(standard.group(1)), 0.95),
        "manufacture": kind.text_value(F.upper(kind.group(1)), 0.90),
        "oem": maker(text),
    }


_NUMBER = r"\d{1,3}(?:\.\d+)?"
_ANY_MEASURE = "|".join(R.MEASURES.values())


def _value_first(words: str) -> str:
    return rf"(?<![\d.])({_NUMBER})\s*MM\s*(?:{words})\b"


def _key_first(words: str) -> str:
    return rf"\b(?:{words})\s*[:=]?\s*({_NUMBER})\s*MM\b"


def _measures(text: Column) -> dict[str, Column]:
    """Measurements in the one order, value or name first, that explains more of the text."""
    count = lambda p: F.regexp_count(text, F.lit("(?i)" + p))
    value_first = count(_value_first(_ANY_MEASURE)) > count(_key_first(_ANY_MEASURE))
    out = {}
    for key, words in R.MEASURES.items():
        by_value, by_key = _Match(text, _value_first(words)), _Match(text, _key_first(words))
        level = R.MEASURE_CONFIDENCE[key]
        out[key] = F.when(value_first, by_value.number(by_value.group(1).cast("double"), level)).otherwise(
            by_key.number(by_key.group(1).cast("double"), level)
        )
    return out


def bearing_attributes(text: Column) -> dict[str, Column]:
    kind, seal = _Match(text, R.BEARING_TYPE), _Match(text, R.SEAL_PATTERN)
    every = lambda i: F.regexp_extract_all(text, F.lit("(?i)" + R.DESIGNATION), F.lit(i))
    pairs = F.zip_with(every(1), every(0), lambda d, m: F.struct(F.trim(d).alias("d"), m.alias("m")))
    digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
    fits = lambda x: (F.length(digits(x["d"])) >= 4) | F.upper(x["d"]).rlike("^N[UJ]")
    first = F.get(F.filter(pairs, fits), F.lit(0))
    name = F.regexp_replace(F.upper(first["d"]), r"\s+", "")
    core = digits(name)
    tail = F.right(core, F.lit(2))
    by_code = F.create_map(*[F.lit(x) for pair in R.BORE_CODES.items() for x in pair])[tail]
    bore = F.when(F.length(core) >= 3, F.coalesce(by_code, F.when(tail.cast("int") >= 4, tail.cast("int") * 5.0)))
    measures = _measures(text)
    seals = F.create_map(*[F.lit(x) for pair in R.SEALS.items() for x in pair])
    raw = F.upper(seal.group(1))
    named = name.isNotNull()
    return {
        "item_type": F.coalesce(kind.text_value(F.upper(kind.group(1)), 0.95), _fixed("BEARING", "bearing", 0.60)),
        "designation": F.when(named, attribute(first["m"], 0.96, text=name)),
        "bore_mm": F.coalesce(
            measures["bore_mm"],
            F.when(
                named & bore.isNotNull(),
                attribute(F.concat(F.lit("designation "), name), 0.90, number=bore, method="derived"),
            ),
        ),
        "outer_diameter_mm": measures["outer_diameter_mm"],
        "width_mm": measures["width_mm"],
        "seal_type": F.coalesce(
            seal.text_value(F.coalesce(seals[raw], raw), 0.88),
            F.when(
                named,
                attribute(
                    F.concat(F.lit("designation "), name, F.lit(" (no closure suffix)")),
                    0.85,
                    text=F.lit("OPEN"),
                    method="derived",
                ),
            ),
        ),
        "oem": maker(text),
    }


def voltage_grade(text: Column) -> Column:
    """The low-tension pair, else kilovolts, else volts that fall on a standard grade."""
    low, kv, volt = _Match(text, R.LOW_TENSION_PATTERN), _Match(text, R.KV_PATTERN), _Match(text, R.VOLT_PATTERN)
    from_volts = volt.group(1).cast("double") / 1000.0
    standard = F.exists(F.array(*map(F.lit, R.KV_GRADES)), lambda g: F.abs(from_volts - g) < 0.01)
    named = lambda v: F.concat(number_text(v), F.lit("KV"))
    return (
        F.when(low.found, attribute(low.source, 0.95, text=F.lit("1.1KV"), method="derived"))
        .when(kv.found, attribute(kv.source, 0.98, text=named(kv.group(1).cast("double"))))
        .when(volt.found & standard, attribute(volt.source, 0.92, text=named(from_volts), method="derived"))
    )


def cable_attributes(text: Column) -> dict[str, Column]:
    both, cores, area = _Match(text, R.CORES_AREA_PATTERN), _Match(text, R.CORES_PATTERN), _Match(text, R.AREA_PATTERN)
    out = {
        "item_type": _fixed("CABLE", "cable", 0.95),
        "cores": F.when(both.found, both.number(both.group(1).cast("int"), 0.96)).otherwise(
            cores.number(cores.group(1).cast("int"), 0.95)
        ),
        "cross_section_sqmm": F.when(both.found, both.number(both.group(2).cast("double"), 0.96)).otherwise(
            area.number(area.group(1).cast("double"), 0.97)
        ),
        "voltage_grade": voltage_grade(text),
    }
    named = {
        "conductor_material": (R.CONDUCTOR_PATTERN, 0.95),
        "insulation": (R.INSULATION_PATTERN, 0.95),
        "armour": (R.ARMOUR_PATTERN, 0.93),
    }
    for key, (pattern, level) in named.items():
        m = _Match(text, pattern)
        out[key] = m.text_value(F.upper(m.group(1)), level)
    return out | {"oem": maker(text)}


def fastener_attributes(text: Column) -> dict[str, Column]:
    kind, thread, length = _Match(text, R.FASTENER_TYPE), _Match(text, R.THREAD_PATTERN, case=True), _Match(text, R.LENGTH_PATTERN)
    stainless, grade = _Match(text, R.STAINLESS_PROPERTY), _Match(text, R.PROPERTY_PATTERN)
    finish, standard = _Match(text, R.FINISH_PATTERN), _Match(text, R.FASTENER_STANDARD)
    kinds = F.create_map(*[F.lit(x) for pair in R.FASTENER_TYPES.items() for x in pair])
    raw = _spaced(kind.group(1))
    dashed = F.regexp_replace(F.regexp_replace(F.upper(stainless.group(1)), "^A270$", "A2-70"), "^A480$", "A4-80")
    by_thread = thread.group(2).cast("double")
    return {
        "item_type": kind.text_value(F.coalesce(kinds[raw], raw), 0.95),
        "thread_size": thread.text_value(F.concat(F.lit("M"), thread.group(1).cast("int").cast("string")), 0.97),
        "length_mm": F.coalesce(
            F.when(by_thread.isNotNull(), thread.number(by_thread, 0.95)), length.number(length.group(1).cast("double"), 0.95)
        ),
        "property_class": F.coalesce(stainless.text_value(dashed, 0.95), grade.text_value(grade.group(1), 0.96)),
        "material": material(text),
        "finish": finish.text_value(_spaced(finish.group(1)), 0.90),
        "standard": standard.text_value(_spaced(standard.group(1)), 0.94),
        "oem": maker(text),
    }


EXTRACTORS = {
    R.VALVE: valve_attributes,
    R.PIPE: pipe_attributes,
    R.BEARING: bearing_attributes,
    R.CABLE: cable_attributes,
    R.FASTENER: fastener_attributes,
}


def bag_of(values: dict[str, Column]) -> Column:
    """A bag of the attributes that are not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast(ATTRIBUTE).alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _read(text: Column, extract: Callable[[Column], dict[str, Column]]) -> Column:
    return let(text, lambda t: bag_of(extract(t)))


def extract_attributes(text: Column, category: Column) -> Column:
    """The bag of a normalized text by its category; empty for an unknown one or a null text."""
    out = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{ATTRIBUTE}>"))
    for name, extract in EXTRACTORS.items():
        out = F.when((category == name) & text.isNotNull(), _read(text, extract)).otherwise(out)
    return out


def fill_gaps(found: Column, extra: Column) -> Column:
    """Attributes of ``extra`` for keys that ``found`` lacks; what is found is never replaced."""
    new = F.map_filter(extra, lambda k, v: ~F.map_contains_key(found, k) & v.isNotNull())
    return F.when(extra.isNull(), found).otherwise(F.map_concat(found, new))
