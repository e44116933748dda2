"""Reading, mapping and validating files."""

import zipfile

import pytest

from shelfsignal.sources import files, imports
from shelfsignal.streaming.ingest import ingest


def test_csv_pads_short_rows_and_drops_blank_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Date, SKU ,Qty\n2024-01-01,A,1\n,,\n2024-01-02,B\n")
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).drop("_order").collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", "A", "1"), ("2024-01-02", "B", "")]
    assert rows[0].asDict().keys() == {"Date", "SKU", "Qty"}


def test_validation_and_ledger(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", "A", "5"), (2, "2024-01-01", "", "5"), (3, "never", "B", "1"), (4, "2024-01-01", "C", "0"), (5, "01/31/2024", "D", "$1,200 pcs"), (6, "2024-01-01", "E", "1-2")], "_order long, date string, sku string, quantity string")
    got = {r["_order"]: r for r in imports.validate(rows, "sales").collect()}
    assert got[1].error is None and got[5].error is None and got[5].quantity == 1200.0 and str(got[5].date) == "2024-01-31"
    assert got[2].error == "Missing required field: sku" and got[3].error == "Invalid date: date" and got[4].error == "Missing required field: quantity" and got[6].error == "Invalid number: quantity"
    assert {r["_order"]: r.error for r in imports.validate(rows, "sales", strict_zero=True).collect()}[4] is None
    run = imports.run_ledger(imports.validate(rows, "sales"), "sales").first()
    assert (run.status, run.rows_imported, run.rows_rejected, len(run.samples)) == ("partial", 2, 4, 4)


def test_inventory_blank_is_zero(spark):
    rows = spark.createDataFrame([("A", "5"), ("B", None), ("C", "0")], "sku string, on_hand_qty string")
    assert [r.on_hand_qty for r in imports.validate(rows, "inventory").collect()] == [5.0, 0.0, 0.0]


def test_users(spark):
    rows = spark.createDataFrame([("Ann", " Ann@X.org ", "tenant_admin"), ("Bob", "bob", "clerk")], "name string, email string, role string")
    got = imports.validate(rows, "users").collect()
    assert got[0].email == "ann@x.org" and got[0].is_admin and got[0].error is None and got[1].error == "Invalid e-mail"


@pytest.mark.parametrize(("header", "field"), [("Sale Date", "date"), ("QTY", "quantity"), ("sku", "sku"), ("Store", "location"), ("Store Name", "product_name"), ("item no", "sku"), ("qqqq", None)])
def test_header_mapping(header, field):
    assert imports.map_header(header, "sales")[0] == field


def test_similarity():
    assert imports.similarity("World", "Word") == pytest.approx(88.888, abs=0.01)
    assert imports.similarity("", "") == 0.0


def test_dimension_members_are_added(spark):
    rows = spark.createDataFrame([(" North ", 1), ("South", 2), ("", 3)], "location string, n long")
    found, members = imports.resolve_dimension(rows, spark.createDataFrame([(7, "North")], "id long, name string"), "location")
    assert {r.n: r.location_id for r in found.collect()} == {1: 7, 2: 8, 3: None}
    assert {r.name for r in members.collect()} == {"North", "South"}


def test_upsert_last_row_wins(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "sku string, v long")
    new = spark.createDataFrame([("A", 5, 1), ("A", 6, 2), ("C", 9, 3)], "sku string, v long, _order long")
    assert sorted(map(tuple, imports.upsert(old, new, ["sku"]).collect())) == [("A", 6), ("B", 2), ("C", 9)]


def test_globs(spark):
    names = spark.createDataFrame([("Sales_1.CSV",), ("x.xlsx",)], "name string")
    assert [r.name for r in files.matching(names, "sales_*.csv").collect()] == ["Sales_1.CSV"]
    assert files.matching(names, " ").count() == 2


def _sheet(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>SKU</t></si><si><t>A1</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Qty</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>4</v></c></row><row></row></sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    _sheet(tmp_path / "a.xlsx")
    spark.dataSource.register(files.SheetSource)
    assert [tuple(r) for r in spark.read.format("sheet").load(str(tmp_path / "a.xlsx")).collect()] == [("A1", "", "4", 2)]
    assert [r.cells for r in files.read_sheets(spark, str(tmp_path / "a.xlsx")).orderBy("order").collect()] == [["SKU", "", "Qty"], ["A1", "", "4"], []]


def test_streaming_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.csv").write_text("Date,SKU,Qty\n2024-01-01,A,1\n2024-01-01,,1\n")
    go = lambda: ingest(spark, str(landing), ["Date", "SKU", "Qty"], {"Date": "date", "SKU": "sku", "Qty": "quantity"}, "sales", str(tmp_path / "out"), str(tmp_path / "ck"))
    go()
    (landing / "2.csv").write_text("Date,SKU,Qty\n2024-01-02,B,2\n")
    go()
    go()
    assert sorted(r.sku for r in spark.read.parquet(str(tmp_path / "out/good")).collect()) == ["A", "B"]
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 1


def test_workbooks_can_be_read_again(spark):
    df = spark.createDataFrame([("a & b", 1.5), (None, 2.0)], "name string, v double")
    data = files.report({"Summary of a very long report name, cut": df, "More": df})
    assert data[:2] == b"PK"
    assert list(files.sheet_rows(data)) == [["name", "v"], ["a & b", "1.5"], ["", "2.0"]]
