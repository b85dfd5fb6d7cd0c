"""Reading item lists: header aliases, row cleaning, lenient casts, de-duplication, new and known rows."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestitch.functions import rules as R
from lodestitch.functions.text import stripped
from lodestitch.plans.numbering import row_numbers

# Accepted header names.
ALIASES = {
    "source_org": ("source_org", "cpse_org", "cpse", "org", "organisation", "organization", "cpse_code"),
    "local_code": ("local_code", "legacy_code", "code", "material_code", "item_code"),
    "description": ("description", "desc", "material_description", "item_description", "raw_description"),
    "category": ("category", "commodity_type", "commodity"),
    "quantity": ("quantity", "qty", "stock"),
    "uom": ("uom", "unit", "unit_of_measure"),
    "unit_value": ("unit_value", "unit_value_inr", "value", "rate"),
}
REQUIRED = ("source_org", "local_code", "description")
MOST_BYTES = 8 << 20
DEFAULT_UOM = "NOS"


class IngestError(ValueError):
    """The input as a whole cannot be read."""


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every cell as text, quoted commas and line breaks kept."""
    return spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True, nanValue="", nullValue=None)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The cells of the first sheet of a workbook as text, blanks empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        read = lambda name: ElementTree.fromstring(book.read(name))
        first = read("xl/workbook.xml").find(f"{_SHEET}sheets/{_SHEET}sheet").get(_RELATION)
        target = next(r.get("Target") for r in read("xl/_rels/workbook.xml.rels") if r.get("Id") == first)
        text = lambda x: "".join(t.text or "" for t in x.iter(f"{_SHEET}t"))
        shared = [text(x) for x in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in read(f"xl/{target.removeprefix('/xl/')}").iter(f"{_SHEET}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{_SHEET}c"):
                letters = cell.get("r", "").rstrip("0123456789")
                at = functools.reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1 if letters else len(cells)
                value = cell.findtext(f"{_SHEET}v", "")
                kind = cell.get("t")
                cells[at] = shared[int(value)] if kind == "s" else text(cell) if kind == "inlineStr" else value
            yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an .xlsx workbook with a header row, all cells as text and blanks empty.

    The workbook is read and parsed in a task, from any store; only its header comes to the driver.
    """
    files = spark.read.format("binaryFile").load(path)
    for size in files.agg(F.min("length"), F.max("length")).first():
        check_upload(size or 0)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [list(_sheet_rows(content)) for content in batch["content"]]
            yield pd.DataFrame({"n": [i for r in rows for i in range(len(r))], "cells": [c for r in rows for c in r]})

    try:
        rows = files.select("content").mapInPandas(parse, "n long, cells array<string>")
        head = rows.where("n = 0").first()
    except PythonException as e:
        raise IngestError("not a workbook") from e
    names = [(i, x) for i, x in enumerate(head["cells"] if head else []) if x.strip()]
    if not names:
        raise IngestError("the workbook has no header")
    return rows.where("n > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(x) for i, x in names])


def check_upload(size: int) -> None:
    """Limits of one uploaded file."""
    if size == 0:
        raise IngestError("the file is empty")
    if size > MOST_BYTES:
        raise IngestError(f"the file is larger than {MOST_BYTES} bytes")


def canonical_headers(df: DataFrame) -> DataFrame:
    """Headers trimmed, lower-cased, blanks as underscores, aliases resolved; unknown columns go."""
    names = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    found: dict[str, str] = {}
    for column in df.columns:
        name = names.get(column.strip().lstrip("﻿").lower().replace(" ", "_"))
        if name and name not in found:
            found[name] = column
    missing = sorted(set(REQUIRED) - set(found))
    if missing:
        raise IngestError(f"missing columns {missing}; found {sorted(df.columns)}")
    cells = [F.col(f"`{found[n]}`").cast("string").alias(n) if n in found else F.lit(None).cast("string").alias(n) for n in ALIASES]
    return df.select(*cells)


def clean_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows): codes trimmed and typed; a row with a blank required cell is rejected.

    Casts are lenient: a bad number is null, a fraction is cut to a whole quantity, an unknown
    category is null.
    """
    text = lambda c: stripped(F.coalesce(F.col(c), F.lit("")))
    number = lambda c: text(c).try_cast("double")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < 2147483648.0), x)
    category = F.lower(text("category"))
    typed = df.select(
        *[c for c in ("row_no",) if c in df.columns],
        F.upper(text("source_org")).alias("source_org"),
        text("local_code").alias("local_code"),
        text("description").alias("description"),
        F.when(category.isin(*R.CATEGORIES), category).alias("category"),
        finite(number("quantity")).cast("int").alias("quantity"),
        F.nullif(F.upper(text("uom")), F.lit("")).alias("uom"),
        F.when(~F.isnan(number("unit_value")), number("unit_value")).alias("unit_value"),
    )
    filled = (F.col("source_org") != "") & (F.col("local_code") != "") & (F.col("description") != "")
    return typed.where(filled), typed.where(~filled)


def first_in_batch(rows: DataFrame, order: str = "row_no") -> DataFrame:
    """The first row of each (source_org, local_code)."""
    first = Window.partitionBy("source_org", "local_code").orderBy(order)
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def split_known(rows: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, known) by (source_org, local_code); known records stay as they are."""
    key = ["source_org", "local_code"]
    have = records.select(*key).distinct()
    return rows.join(have, key, "left_anti"), rows.join(have, key, "left_semi")


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """New rows with ids after the last one, by source_org and local_code."""
    out = row_numbers(rows, F.col("source_org"), F.col("local_code"), into="id")
    return out.withColumn("id", (F.col("id") + F.lit(after)).cast("long"))


def upsert(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those with their keys."""
    return base.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def upsert_newest(base: DataFrame, changes: DataFrame, *keys: str, at: str) -> DataFrame:
    """``base`` with the newest change of each key; ties go to the largest row. ``changes`` has the columns of ``base`` and ``at``."""
    rest = [c for c in base.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("_row"))
    return upsert(base, newest.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in base.columns]), *keys)


def inventory_rows(rows: DataFrame) -> DataFrame:
    """record_id, quantity, uom, unit_value of the rows that state a quantity."""
    return rows.where("quantity is not null").select(
        F.col("id").alias("record_id"), "quantity", F.coalesce("uom", F.lit(DEFAULT_UOM)).alias("uom"),
        F.coalesce("unit_value", F.lit(0.0)).alias("unit_value"),
    )


def ingest_report(received: DataFrame, new: DataFrame, known: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: received, inserted, skipped, unknown_category."""
    count = lambda df: df.agg(F.count("*").alias("n")).scalar()
    return received.sparkSession.range(1).select(
        count(received).alias("received"), count(new).alias("inserted"), count(known).alias("skipped"),
        count(enriched.where("category is null")).alias("unknown_category"),
    )


def stage(df: DataFrame) -> DataFrame:
    """Cleaned rows of a raw list, the first of each code only; fails when no row is valid."""
    # A file scan numbers its rows ascending, so the first of a code is the first in the file.
    valid, _ = clean_rows(canonical_headers(df).withColumn("row_no", F.monotonically_increasing_id()))
    if valid.limit(1).count() == 0:
        raise IngestError("no valid rows")
    return first_in_batch(valid).drop("row_no")


def enriched_records(rows: DataFrame, encoder=None) -> DataFrame:
    """Staged rows as records: category given or detected, normalized text, tokens, attributes, vector."""
    from lodestitch.operators.resolve import enrich

    return enrich(rows.withColumnRenamed("description", "raw_text"), encoder)


def write_csv(df: DataFrame, path: str) -> None:
    """The CSV sink: header, every cell quoted, quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")
