"""Workbooks in and out: whole files, made here part by part."""
import zipfile

import pytest
from pyspark.sql import functions as F

from rostrum.sources import cells, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, rows, shared="", after="", target="worksheets/list.xml"):
    """A workbook whose first sheet is not the first part of the file."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/other.xml", f"<worksheet {MAIN}><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{RELS}"><sheets><sheet name="A" sheetId="4" r:id="r9"/><sheet name="B" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Target="worksheets/other.xml"/><Relationship Id="r9" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/list.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData>{after}</worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")


def values(df):
    return sorted((r["row_no"], r["col_no"], r["value"]) for r in df.collect())


def test_rich_text_links_and_formula_results(spark, tmp_path):
    book(tmp_path / "a.xlsx", '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'
         '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Person Name</t></is></c><c r="C2" t="s"><v>2</v></c></row>'
         '<row r="4"><c r="A4" t="str"><f>"Oak Mills"</f><v>Oak Mills</v></c><c r="B4" t="s"><v>3</v></c><c r="C4" t="s"><v>4</v></c></row>',
         "<si><t>Import</t></si><si><r><t>Company </t></r><r><rPr><b/></rPr><t>Name</t></r></si><si><t>Title</t></si>"
         "<si><r><t>Mira</t></r><r><t xml:space='preserve'> Sen</t></r><rPh sb='0' eb='1'><t>no</t></rPh></si><si><t>Managing Director</t></si>",
         '<hyperlinks><hyperlink ref="C4"/></hyperlinks>', "/xl/worksheets/list.xml")
    found = sheets.read_workbooks(spark, str(tmp_path))
    assert values(found) == [(1, 1, "Import"), (2, 1, "Company Name"), (2, 2, "Person Name"), (2, 3, "Title"), (4, 1, "Oak Mills"), (4, 2, "Mira Sen"), (4, 3, "Managing Director")]
    assert [tuple(r) for r in cells.sheet_rows(found, "file").drop("file").collect()] == [(4, "Oak Mills", "Mira Sen", "Managing Director")]


def test_numbers_errors_booleans_merged_ranges_and_cells_without_address(spark, tmp_path):
    book(tmp_path / "a.xlsx", '<row><c t="b"><v>1</v></c><c><v>1.50</v></c><c><v>1E3</v></c><c t="e"><v>#N/A</v></c><c><f>1/0</f></c><c><f>1+1</f><v>2</v></c></row>'
         '<row r="5"><c r="B5" t="inlineStr"><is><t>whole_x0041_</t></is></c><c r="C5"><v>7</v></c></row><row r="6"><c r="B6"><v>9</v></c></row>',
         after='<mergeCells count="1"><mergeCell ref="B5:C6"/></mergeCells>')
    assert values(sheets.read_workbooks(spark, str(tmp_path / "a.xlsx"))) == [
        (1, 1, "true"), (1, 2, "1.5"), (1, 3, "1000"), (1, 6, "2"), (5, 2, "wholeA"), (5, 3, "wholeA"), (6, 2, "wholeA"), (6, 3, "wholeA")]


def test_many_lists_keep_their_own_headers(spark, tmp_path):
    one = '<row><c t="inlineStr"><is><t>{}</t></is></c><c t="inlineStr"><is><t>{}</t></is></c></row>'
    book(tmp_path / "a.xlsx", one.format("Company", "Director") + one.format("Oak Mills", "Mira Sen"))
    book(tmp_path / "b.xlsx", one.format("Name", "ORGANIZATION") + one.format("Jon Ek", "Elm Works"))
    book(tmp_path / "c.xlsx", one.format("Ash Yard", "note"))
    book(tmp_path / "d.xlsx", "")
    rows = cells.sheet_rows(sheets.read_workbooks(spark, str(tmp_path)), "file").collect()
    assert sorted((r["file"][-6], r["company"], r["person"]) for r in rows) == [("a", "Oak Mills", "Mira Sen"), ("b", "Elm Works", "Jon Ek"), ("c", "Ash Yard", None)]


def test_layouts_of_one_list_equal_the_single_form(spark):
    table = spark.createDataFrame([("x", 1, 1, "Import"), ("x", 2, 3, "company"), ("x", 2, 1, " Company  Name "), ("x", 2, 2, "name"), ("x", 2, 4, "director"),
                                   ("x", 3, 1, "Companies"), ("x", 2, 5, "role"), ("x", 6, 3, "Oak")], "file string, row_no int, col_no int, value string")
    cols = ["header_row", "company_col", "person_col", "role_col"]
    assert cells.header_layout(table, "file").select(cols).collect() == cells.header_layout(table.drop("file")).select(cols).collect()


def test_a_file_that_is_no_workbook_is_named(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"PK no")
    with pytest.raises(Exception, match="not a workbook: .*bad.xlsx"):
        sheets.read_workbooks(spark, str(tmp_path)).collect()


def test_round_trip(spark, tmp_path):
    odd = ["a<b>&\"'", " two  spaces ", "line\nbreak\ttab", "\x07bell", "_x0041_ stays", "漢字 🙂", "\r\n"]
    df = spark.createDataFrame([(i, t, i % 2 == 0, None if i % 3 else 10 ** 17 + i) for i, t in enumerate(odd * 30)], "n int, `t <x>` string, b boolean, big bigint")
    path = str(tmp_path / "out")
    sheets.write_workbooks(df.repartition(3), path, "R & D", rows=40)
    found = sheets.read_workbooks(spark, path)
    heads = found.where("row_no = 1").select("value").distinct().collect()
    assert {r[0] for r in heads} == {"n", "t <x>", "b", "big"}
    assert found.groupBy("file").agg(F.max("row_no").alias("m")).agg(F.max("m")).first()[0] == 41
    got = found.where("row_no > 1").groupBy("file", "row_no").pivot("col_no", [1, 2, 3, 4]).agg(F.first("value")).drop("file", "row_no").collect()
    want = [(str(r["n"]), r["t <x>"], str(r["b"]).lower(), None if r["big"] is None else str(r["big"])) for r in df.collect()]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_append_overwrite_and_empty(spark, tmp_path):
    path, df = str(tmp_path / "out"), spark.range(5)
    sheets.write_workbooks(df, path)
    sheets.write_workbooks(df, path)
    assert sheets.read_workbooks(spark, path).where("row_no > 1").count() == 10
    sheets.write_workbooks(df.limit(0), path, mode="overwrite")
    assert values(sheets.read_workbooks(spark, path)) == [(1, 1, "id")]
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_an_aborted_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sheets.write_workbooks(spark.range(3), path)
    before = sorted(p.name for p in (tmp_path / "out").rglob("*"))
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        sheets.write_workbooks(broken, path, mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == before


def test_files_of_lost_attempts_are_not_shown(tmp_path):
    writer = sheets._WorkbookWriter({"path": str(tmp_path)}, ["a"], False)
    staged = tmp_path / f"_staged-{writer.begin().run}"
    for name in ("part-0-1.xlsx", "part-0-2.xlsx"):
        (staged / name).write_bytes(b"x")
    writer.commit([sheets._Written(["part-0-2.xlsx"]), None])
    assert [p.name for p in tmp_path.rglob("*.xlsx")] == ["part-0-2.xlsx"] and not staged.exists()
