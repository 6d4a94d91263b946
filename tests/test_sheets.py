"""Workbooks written and read by the tasks."""

import zipfile

from pyspark.sql import functions as F

from peneira.sources import files, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_round_trip_in_ranges(spark, tmp_path):
    text = F.concat(F.lit(" <a> & \"x\"\nção \U0001f600 "), F.col("id"))
    rows = spark.range(1000).repartition(3).select(F.col("id").cast("string").alias("ID"), F.when(F.col("id") % 7 > 0, text).alias("Texto Mascarado"), F.lit(None).cast("string").alias("Vazio"))
    files.write_xlsx(rows, str(tmp_path / "out"), most=100)
    books = sheets.workbooks(str(tmp_path / "out"))
    assert len(books) >= 10 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    want = sorted(map(tuple, rows.collect()), key=str)
    back = files.read_xlsx(spark, str(tmp_path / "out"))
    assert back.columns == rows.columns and sorted(map(tuple, back.collect()), key=str) == want
    sheets.register(spark)
    narrow = spark.read.format("sheet").option("rows", 7).load(str(tmp_path / "out"))
    assert sorted(map(tuple, narrow.collect()), key=str) == want
    some = files.read_xlsx(spark, str(tmp_path / "out"), schema="ID string, Nada string")
    assert sorted(r.ID for r in some.collect()) == sorted(r[0] for r in want) and some.where("Nada is not null").count() == 0
    assert files.documents(back).where("text is not null").count() == len([r for r in want if r[1]])
    # only rows make a workbook
    files.write_xlsx(rows.limit(0), str(tmp_path / "none"))
    assert sheets.workbooks(str(tmp_path / "none")) == []


def test_cells_of_other_programs(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>id</t></si><si><r><t>te</t></r><r><t>xto</t></r><rPh><t>no</t></rPh></si><si><t>olá</t></si><si/></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"""<worksheet {MAIN}><dimension ref="A1:C6"/><sheetData>
 <row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
 <row r="2"><c r="A2"><v>7</v></c><c r="C2" t="s"><v>2</v></c></row>
 <row r="4"><c r="A4" t="b"><v>1</v></c><c r="C4" t="str"><f>A2</f><v>soma</v></c></row>
 <row r="5"/>
 <row r="9"><c r="C9" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c><c r="AB9"><v>1</v></c></row></sheetData></worksheet>""")
    want = [("7", None, "olá"), ("TRUE", None, "soma"), (None, None, "ab")]
    for width in (1, 2, 100):
        sheets.register(spark)
        got = spark.read.format("sheet").option("rows", width).load(str(path))
        assert got.columns == ["id", "_c1", "texto"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
