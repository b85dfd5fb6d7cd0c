"""Text expressions: category detection, normalization, tokens. JVM-side throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestitch.functions import rules as R

PUNCTUATION = r"[,;:/\\|()\[\]{}]+"
PUNCTUATION_AND_DOT = r"[,;:/\\|()\[\]{}.]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def number_text(value: Column) -> Column:
    """A double in short form: up to six significant digits, no trailing zeros (``%g`` below 1e6); null stays null."""
    digits = F.greatest(F.lit(0), 6 - F.ceil(F.log10(F.greatest(F.abs(value), F.lit(1e-6)) * (1 + 1e-12))))
    scale = F.pow(F.lit(10.0), digits)
    exact = F.format_string("%.6f", F.floor(value * scale + 0.5) / scale)
    return F.when(value.isNotNull(), F.regexp_replace(exact, r"\.?0+$", ""))


def substituted(text: Column, pattern: str, replacement: Callable[[Column], Column]) -> Column:
    """Every match replaced by a function of it; a null replacement keeps the match."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    glued = F.zip_with(
        parts, found, lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).otherwise(F.coalesce(replacement(m), m)))
    )
    return F.array_join(glued, "")


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


# ---- category -----------------------------------------------------------------------------


def _cleaned(text: Column) -> Column:
    upper = F.regexp_replace(F.upper(text), r"\bV\s*/\s*V\b", "VALVE")
    return collapsed(F.regexp_replace(upper, PUNCTUATION_AND_DOT, " "))


def within_one_edit(token: Column, word: str) -> Column:
    """One substitution, insertion, deletion or swap of neighbours at most."""
    swaps = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return (F.levenshtein(token, F.lit(word)) <= 1) | token.isin(*sorted(swaps))


def fuzzy_category(cleaned: Column) -> Column:
    """Category of the first word that is a head noun but for one edit; null without one."""

    def of(tokens: Column) -> Column:
        gate = F.contains(cleaned, F.lit("GATE")) | F.exists(tokens, lambda t: within_one_edit(t, "GATE"))

        def category(token: Column) -> Column:
            out = F.lit(None).cast("string")
            for word, name in reversed(R.HEAD_NOUNS.items()):
                fits = within_one_edit(token, word)
                out = F.when(fits & gate if name == R.VALVE else fits, F.lit(name)).otherwise(out)
            return out

        return F.get(F.filter(F.transform(tokens, category), lambda c: c.isNotNull()), F.lit(0))

    words = F.filter(F.split(cleaned, " "), lambda t: (F.length(t) >= 4) & t.rlike(r"^\p{L}+$"))
    return let(words, of)


def detect_category(text: Column) -> Column:
    """The first category whose pattern fits, else the fuzzy one, else ``unknown``; never null."""

    def of(cleaned: Column) -> Column:
        out = F.coalesce(fuzzy_category(cleaned), F.lit(R.UNKNOWN))
        for name, pattern in reversed(R.DETECTION.items()):
            out = F.when(cleaned.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
        return out

    return F.when(text.isNull() | (text == ""), F.lit(R.UNKNOWN)).otherwise(let(_cleaned(text), of))


def is_known(category: Column) -> Column:
    return F.coalesce(category.isin(*R.CATEGORIES), F.lit(False))


# ---- normalization ------------------------------------------------------------------------


def _fraction_value(match: Column) -> Column:
    part = lambda i: F.regexp_extract(match, r"^(?:(\d+)[-\s]+)?(\d)\s*/\s*(\d)$", i)
    whole = F.coalesce(F.try_to_number(F.nullif(part(1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("double")
    return F.try_divide(part(2).cast("double"), part(3).cast("double")) + whole


def fractions_resolved(text: Column) -> Column:
    """``1-1/2"`` becomes ``1.5"``: only before an inch mark, and never with a zero denominator."""
    return substituted(text, R.FRACTION_PATTERN, lambda m: number_text(_fraction_value(m)))


def _size(value: Column) -> Column:
    known = value.isin(*sorted(set(R.INCH_TO_DN.values())))
    return F.when(known, F.concat(F.lit("DN"), value.cast("string")))


def _inches(match: Column) -> Column:
    text = stripped(F.regexp_extract(match, R.INCH_PATTERN.replace(r"(?<![\w.])", "^"), 1))
    value = F.coalesce(_literal_map(R.FRACTIONS)[text], F.expr("cast(null as double)"), text.try_cast("double"))
    return F.concat(F.lit("DN"), _literal_map(R.INCH_TO_DN)[value].cast("string"))


def sizes_canonical(text: Column, category: Column) -> Column:
    """Nominal sizes as ``DNx`` for valves and pipes: bore, inch, millimetre, then DN notation."""
    digits = lambda m: F.regexp_extract(m, r"(\d{1,4})", 1).cast("int")
    out = substituted(text, R.NB_PATTERN, lambda m: _size(digits(m)))
    out = substituted(out, R.INCH_PATTERN, _inches)
    out = substituted(out, R.MM_PATTERN, lambda m: _size(digits(m)))
    out = substituted(out, R.DN_PATTERN, lambda m: F.concat(F.lit("DN"), digits(m).cast("string")))
    return F.when(category.isin(*R.SIZED), out).otherwise(text)


ABBREVIATION_PATTERN = r"(?i)\b(?:" + "|".join(sorted(R.ABBREVIATIONS, key=len, reverse=True)) + r")\b"


def _expansion(key: Column, category: Column) -> Column:
    scope = _literal_map(R.SCOPED)[key]
    inside = scope.isNull() | F.coalesce(scope == category, F.lit(False))
    return F.when(inside, _literal_map(R.ABBREVIATIONS)[key])


def abbreviations_expanded(text: Column, category: Column) -> Column:
    """Whole-word abbreviations spelled out, some in their own category only."""
    return substituted(text, ABBREVIATION_PATTERN, lambda m: _expansion(F.upper(m), category))


def _prepared(text: Column) -> Column:
    upper = stripped(F.upper(F.translate(text, R.QUOTES_FROM, R.QUOTES_TO)))
    return F.regexp_replace(upper, r"\bV\s*/\s*V\b", "VALVE")


def normalize(text: Column, category: Column) -> Column:
    """The canonical description that is indexed and matched; null gives an empty text."""
    flat = let(fractions_resolved(_prepared(text)), lambda t: collapsed(F.regexp_replace(t, PUNCTUATION, " ")))
    sized = let(flat, lambda t: sizes_canonical(t, category))
    out = let(sized, lambda t: collapsed(abbreviations_expanded(t, category)))
    return F.coalesce(out, F.lit(""))


def rule_trace(text: Column, category: Column) -> Column:
    """Which rules a text would trigger: ``fraction:``, ``dim:`` and ``abbrev:`` entries (for previews)."""
    start = _prepared(text)
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    digits = lambda m: F.regexp_extract(m, r"(\d{1,4})", 1).cast("int")
    fractions = F.transform(
        every(start, R.FRACTION_PATTERN), lambda m: F.concat(F.lit("fraction:"), m, F.lit("->"), number_text(_fraction_value(m)))
    )
    flat = collapsed(F.regexp_replace(fractions_resolved(start), PUNCTUATION, " "))

    def sizes(kind: str, pattern: str, to: Callable[[Column], Column]) -> Column:
        note = F.transform(every(flat, pattern), lambda m: F.concat(F.lit(f"dim:{kind}:"), F.trim(m), F.lit("->"), to(m)))
        return F.when(category.isin(*R.SIZED), note).otherwise(F.array().cast("array<string>"))

    words = F.transform(
        every(sizes_canonical(flat, category), ABBREVIATION_PATTERN),
        lambda m: F.concat(F.lit("abbrev:"), F.upper(m), F.lit("->"), _expansion(F.upper(m), category)),
    )
    mm = lambda m: _size(digits(m))
    notes = F.concat(
        fractions, sizes("nb", R.NB_PATTERN, mm), sizes("inch", R.INCH_PATTERN, _inches), sizes("mm", R.MM_PATTERN, mm), words
    )
    return F.coalesce(F.array_compact(notes), F.array().cast("array<string>"))


def tokenize(text: Column) -> Column:
    """Upper-case tokens of letters, digits, dots, dashes and hashes."""
    # Finding tokens takes a fraction of the time of cutting at what is between them.
    return F.regexp_extract_all(F.upper(text), F.lit(r"[A-Z0-9.\-#]+"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """The tokens of a text in which all but printable ASCII is a space; what upper case would make ASCII is none."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9.\-#]+"), F.lit(0))
    return F.array_remove(F.split(F.upper(F.array_join(found, " ")), " "), "")
