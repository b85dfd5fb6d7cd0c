"""Item lists with their malformations, snapshots, weights and the stream."""

import zipfile

import pytest
from pyspark.sql import functions as F

from lodestitch.plans import weights
from lodestitch.sources import ingest
from lodestitch.streaming.ingest_stream import start

CSV = """ CPSE ,Material Code,DESC,commodity,Qty,uom,rate
alpha,001,"GATE VALVE, 6 IN",gate_valve,12.7,nos,10.5
alpha,001,second of its code,,1,,1
 bravo , B-2 ,bearing 6205,thing,x,,
charlie,,no code,,,,
"""


def test_a_list_is_staged(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    rows = {r.local_code: r for r in ingest.stage(ingest.read_csv(spark, str(tmp_path / "in.csv"))).collect()}
    assert set(rows) == {"001", "B-2"}
    a, b = rows["001"], rows["B-2"]
    assert (a.source_org, a.description, a.category, a.quantity, a.uom, a.unit_value) == ("ALPHA", "GATE VALVE, 6 IN", "gate_valve", 12, "NOS", 10.5)
    assert (b.source_org, b.category, b.quantity, b.uom, b.unit_value) == ("BRAVO", None, None, None, None)


@pytest.mark.parametrize("text", ["org,code\na,b\n", "org,code,desc\n", "org,code,desc\n , ,\n"])
def test_bad_lists_fail(spark, tmp_path, text):
    (tmp_path / "in.csv").write_text(text)
    with pytest.raises(ingest.IngestError):
        ingest.stage(ingest.read_csv(spark, str(tmp_path / "in.csv")))


def workbook(path, rows):
    """A small .xlsx: shared and inline texts, numbers, and cells that are left out."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    shared = sorted({v for r in rows for v in r if isinstance(v, str)})
    cell = lambda v, at: "" if v is None else f'<c r="{at}"><v>{v}</v></c>' if not isinstance(v, str) else (
        f'<c r="{at}" t="s"><v>{shared.index(v)}</v></c>' if len(v) % 2 else f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
    )
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(v, f"{chr(65 + k)}{i + 1}") for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_a_workbook_is_staged(spark, tmp_path):
    path = str(tmp_path / "in.xlsx")
    workbook(path, [("org", None, "Code", "desc", "qty"), ("alpha", "x", "A-1", "GATE VALVE 6 IN", 12.5), ("alpha", None, 7, "pipe"), (None, None, "B", "c")])
    raw = ingest.read_excel(spark, path)
    assert raw.columns == ["org", "Code", "desc", "qty"] and raw.where("org = ''").count() == 1
    rows = {r.local_code: (r.source_org, r.description, r.quantity) for r in ingest.stage(raw).collect()}
    assert rows == {"A-1": ("ALPHA", "GATE VALVE 6 IN", 12), "7": ("ALPHA", "pipe", None)}
    (tmp_path / "bad.xlsx").write_bytes(b"no zip file")
    with pytest.raises(ingest.IngestError):
        ingest.read_excel(spark, str(tmp_path / "bad.xlsx"))
    (tmp_path / "empty.xlsx").write_bytes(b"")
    with pytest.raises(ingest.IngestError):
        ingest.read_excel(spark, str(tmp_path / "empty.xlsx"))


def test_a_store_is_seeded_once_unless_forced(spark, tmp_path):
    from lodestitch.sources import snapshots, synthetic

    base = str(tmp_path / "store")
    assert synthetic.seed_store(spark, base) and not synthetic.seed_store(spark, base)
    records, labels = (snapshots.read_current(spark, base, n) for n in ("records", "labels"))
    assert "truth" not in records.columns and labels.select("truth").distinct().count() == 38
    assert records.join(labels, ["source_org", "local_code"]).count() == records.count() == labels.count()
    assert synthetic.seed_store(spark, base, force=True) and snapshots.manifest(spark, base).count() == 2


@pytest.mark.parametrize("size", [0, ingest.MOST_BYTES + 1])
def test_upload_limits(size):
    with pytest.raises(ingest.IngestError):
        ingest.check_upload(size)


def test_new_known_and_report(spark):
    rows = spark.createDataFrame([("A", "1", "gate valve 6 in", None, 3, None, None), ("A", "2", "zzz", None, None, "KG", 2.0)],
        "source_org string, local_code string, description string, category string, quantity int, uom string, unit_value double")
    have = spark.createDataFrame([("A", "2")], "source_org string, local_code string")
    new, known = ingest.split_known(rows, have)
    assert [r.local_code for r in new.collect()] == ["1"] and known.count() == 1
    records = ingest.enriched_records(ingest.numbered(new, 100))
    row = records.first()
    assert (row.id, row.category, row.norm_text) == (101, "gate_valve", "GATE VALVE DN150") and len(row.embedding) == 256
    stock = ingest.inventory_rows(ingest.numbered(rows, 0)).collect()
    assert [tuple(r) for r in stock] == [(1, 3, "NOS", 0.0)]
    assert ingest.ingest_report(rows, new, known, records).first().asDict() == {"received": 2, "inserted": 1, "skipped": 1, "unknown_category": 0}


def test_csv_sink_quotes_every_cell(spark, tmp_path):
    out = str(tmp_path / "out")
    ingest.write_csv(spark.createDataFrame([('a "b"', "c,d")], "x string, y string").coalesce(1), out)
    text = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv").read_text()
    assert text == '"x","y"\n"a ""b""","c,d"\n'
    back = spark.read.csv(out, header=True, escape='"').first()
    assert tuple(back) == ('a "b"', "c,d")


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    found = ingest.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_weights(spark):
    none = spark.createDataFrame([], weights.SCHEMA)
    one = weights.with_override(none, "pipe", 1.0, 0.0, 0.0, {"size": 2.0})
    table = weights.as_table(weights.effective_weights(spark, one))
    assert table["pipe"] == (1.0, 0.0, 0.0, {"size": 2.0}) and table["bearing"][0] == 0.25
    assert weights.without_override(one, "pipe").count() == 0
    for bad in ((0.0, 0.0, 0.0, {}), (1.5, 0, 0, {}), (1.0, 0, 0, {"size": 3.0})):
        with pytest.raises(ValueError):
            weights.check_weights(*bad)


def test_a_folder_is_ingested_once(spark, tmp_path):
    folder, target, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    head = "source_org,local_code,description,category,quantity,uom,unit_value\n"
    (folder / "1.csv").write_text(head + "a,1,gate valve,,,,\na,1,again,,,,\n")
    start(spark, str(folder), str(target), str(state)).awaitTermination()
    (folder / "2.csv").write_text(head + "a,1,known,,,,\nb,2,pipe,,,,\n")
    start(spark, str(folder), str(target), str(state)).awaitTermination()
    found = spark.read.parquet(str(target)).select("source_org", "local_code", "description")
    assert sorted(tuple(r) for r in found.collect()) == [("A", "1", "gate valve"), ("B", "2", "pipe")]
    assert spark.read.parquet(str(target)).agg(F.max("batch_id")).first()[0] == 1
