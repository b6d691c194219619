import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.session import shared_dir
from tablewright.sources import csv, jdbc, store, workbook
from tests.conftest import rows


def test_csv_types_and_missing_texts(spark, tmp_path):
    text = 'i,f,b,s,gap,mixed,when\n1,1.5,True,x,,1,2024-01-02\n2,NA,False,n/a,NaN,a,2024-01-03\n-3, 2e3 ,,"NU""L",null,2.5,\n'
    (tmp_path / "t.csv").write_text(text)
    got = csv.read_csv(spark, str(tmp_path / "t.csv"), parse_dates=True)
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    assert types == {
        "i": "bigint", "f": "double", "b": "boolean", "s": "string", "gap": "double", "mixed": "string", "when": "timestamp_ntz",
    }
    assert [tuple(r)[:6] for r in got.collect()] == [
        (1, 1.5, True, "x", None, "1"),
        (2, None, False, None, None, "a"),
        (-3, 2000.0, None, 'NU"L', None, "2.5"),
    ]
    assert dict(csv.read_csv(spark, str(tmp_path / "t.csv")).dtypes)["when"] == "string"


def test_csv_numbers_too_large_for_whole_numbers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,m\n99999999999999999999,1\n1,1.0\n")
    assert dict(csv.read_csv(spark, str(tmp_path / "t.csv")).dtypes) == {"n": "double", "m": "double"}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.25), (2, 'quote " here', None)], "id bigint, s string, v double")
    csv.write_csv(df, str(tmp_path / "out"))
    assert rows(csv.load_table(spark, str(tmp_path / "out"), "CSV")) == rows(df)
    declared = csv.read_csv(spark, str(tmp_path / "out"), schema=df.schema)
    assert rows(declared) == rows(df)


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,hi\nNA,x\n")
    (tmp_path / "b.csv").write_text("b,a,c\nbye,7,9\n")
    got = csv.read_csv(spark, str(tmp_path), "b string, a bigint", mixed_headers=True)
    assert got.columns == ["b", "a"] and set(rows(got)) == {("hi", 1), ("x", None), ("bye", 7)}
    found = csv.read_csv(spark, str(tmp_path), mixed_headers=True)
    assert dict(found.dtypes) == {"a": "bigint", "b": "string", "c": "bigint"} and found.count() == 3
    with pytest.raises(Exception):  # a header that differs is never read by position
        csv.read_csv(spark, str(tmp_path), "a bigint, b string").collect()
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "a.csv"), "z bigint")


def test_csv_misfits(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,n\n10D,1\n20F,x\n")
    assert dict(csv.read_csv(spark, str(tmp_path / "t.csv")).dtypes) == {"code": "string", "n": "string"}
    with pytest.raises(Exception):
        csv.read_csv(spark, str(tmp_path / "t.csv"), "code string, n bigint").collect()
    lenient = csv.read_csv(spark, str(tmp_path / "t.csv"), "code string, n bigint", mode="lenient")
    assert set(rows(lenient)) == {("10D", 1), ("20F", None)}
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "t.csv"), mode="loose")


def test_load_table_kinds(spark):
    assert csv.load_table(spark, None, "csv").columns == []
    with pytest.raises(ValueError):
        csv.load_table(spark, "x", "json")


def _workbook(sheet, shared="", target="worksheets/sheet1.xml"):
    content = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(content, "w") as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            '<sheets><sheet name="One" sheetId="1" r:id="rId7"/><sheet name="Two" sheetId="2" r:id="rId8"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId8" Target="worksheets/other.xml"/><Relationship Id="rId7" Target="{target}"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        book.writestr("xl/worksheets/other.xml", f"<worksheet {main}><sheetData/></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
    return content.getvalue()


def test_workbooks(spark, tmp_path):
    shared = "<si><t>name</t></si><si><t>born</t></si><si><r><t>Ann</t></r><r><t>e</t></r></si><si><t>n</t></si>"
    sheet = (
        '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>3</v></c><c r="E1" t="inlineStr"><is><t>ok</t></is></c></row>'
        '<row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>45292.5</v></c><c r="D2"><v>7</v></c><c r="E2" t="b"><v>1</v></c></row>'
        '<row><c r="A3" t="inlineStr"><is><t>Bo</t></is></c><c r="D3"><v>8.0</v></c><c r="E3" t="e"><v>#REF!</v></c></row>'
        "<row></row>"
    )
    (tmp_path / "a.xlsx").write_bytes(_workbook(sheet, shared))
    (tmp_path / "b.xlsx").write_bytes(_workbook(sheet, shared, target="/xl/worksheets/sheet1.xml"))
    (tmp_path / "note.txt").write_text("not a workbook")
    got = workbook.read_workbooks(spark, str(tmp_path), "name string, n bigint, born timestamp_ntz, ok boolean, absent double")
    one = [("Anne", 7, datetime(2024, 1, 1, 12), True, None), ("Bo", 8, None, None, None)]
    assert rows(got) == sorted(one * 2)


def test_workbook_types_are_found_or_checked(spark, tmp_path):
    cell = '<c t="inlineStr"><is><t>{}</t></is></c>'.format
    sheet = (
        f"<row>{cell('n')}{cell('s')}{cell('gap')}</row>"
        f"<row><c><v>1</v></c>{cell('x')}{cell('nan')}</row><row><c><v>2</v></c>{cell('y')}<c><v>0.5</v></c></row>"
    )
    (tmp_path / "a.xlsx").write_bytes(_workbook(sheet))
    got = csv.load_table(spark, str(tmp_path), "xlsx")
    assert dict(got.dtypes) == {"n": "bigint", "s": "string", "gap": "double"}
    assert set(rows(got)) == {(1, "x", None), (2, "y", 0.5)}
    assert set(rows(workbook.read_workbooks(spark, str(tmp_path), "s string, gap double"))) == {("x", None), ("y", 0.5)}
    with pytest.raises(Exception):
        workbook.read_workbooks(spark, str(tmp_path), "s bigint").collect()
    assert rows(workbook.read_workbooks(spark, str(tmp_path), "s bigint", mode="lenient")) == [(None,), (None,)]


def test_jdbc_options():
    plain = jdbc.jdbc_options("jdbc:x:y", "SELECT 1", user="u")
    assert plain == {"url": "jdbc:x:y", "fetchsize": "10000", "user": "u", "query": "SELECT 1"}
    ranged = jdbc.jdbc_options("jdbc:x:y", "SELECT a FROM t", "a", "1", "9", 4)
    assert "query" not in ranged and ranged["dbtable"] == "(SELECT a FROM t) source"
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("a", "1", "9", "4")


def test_jdbc_asks_the_database_for_bounds():
    text = jdbc.bounds_query("SELECT a FROM t", "a")
    assert text == "SELECT min(a) AS low_end, max(a) AS high_end FROM (SELECT a FROM t) source"


def test_jdbc_needs_a_query(spark):
    with pytest.raises(ValueError):
        jdbc.read_sql(spark, "jdbc:x:y", "  ")


def test_store_versions(spark, tmp_path):
    root = str(tmp_path)
    assert store.load_table(spark, root, "t") is None and store.table_names(spark, root) == []
    store.save_table(spark.range(3), root, "t")
    current = store.load_table(spark, root, "t")
    store.save_table(current.union(current), root, "t")  # reads the version before
    assert store.load_table(spark, root, "t").count() == 6 and current.count() == 3
    store.save_table(spark.range(1).withColumn("g", F.lit(1)), root, "t", partition_by=["g"])
    assert len(list((tmp_path / "t").iterdir())) == 2
    (tmp_path / "t" / "v99999999999999999999-broken").mkdir()
    assert store.load_table(spark, root, "t").count() == 1
    assert store.table_names(spark, root) == ["t"]
    store.delete_table(spark, root, "t")
    store.delete_table(spark, root, "t")
    assert store.load_table(spark, root, "t") is None


def test_charts_by_name(spark, tmp_path):
    root = str(tmp_path)
    store.save_chart(spark.range(2), root, "one")
    store.save_chart(spark.range(5), root, "two")
    assert store.chart_names(spark, root) == ["one", "two"]
    assert store.load_chart(spark, root, "two").agg(F.count("*")).first()[0] == 5
    store.remove_chart(spark, root, "one")
    assert store.chart_names(spark, root) == ["two"]


def test_shared_dir_is_the_named_one(spark):
    assert shared_dir(spark) == shared_dir(spark)
