"""Files, workbooks, typed ingest, registry, JDBC helpers."""

import datetime as dt
import decimal
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

from tablewright.operators.staging import scratch_dir
from tablewright.operators.tables import read_table
from tablewright.plans import jobs
from tablewright.plans.storing import new_namespace
from tablewright.sources import jdbc, registry, workbooks
from tablewright.sources.files import extension, load_file, read_json
from tablewright.sources.ingest import ingest_typed
from tablewright.sources.workbooks import read_xlsx

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheet_rows, shared=(), since_1904=False, target="worksheets/first.xml", styles=None):
    strings = "".join(f"<si>{s}</si>" for s in shared)
    properties = '<workbookPr date1904="1"/>' if since_1904 else "<workbookPr/>"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{properties}<sheets>'
                      '<sheet name="b" sheetId="2" r:id="rId9"/><sheet name="a" sheetId="1" r:id="rId1"/>'
                      "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels",
                      '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                      '<Relationship Id="rId1" Target="worksheets/other.xml"/>'
                      f'<Relationship Id="rId9" Target="{target}"/></Relationships>')
        sheet = f'<worksheet xmlns="{MAIN}"><sheetData>{sheet_rows}</sheetData></worksheet>'
        book.writestr("xl/" + target if not target.startswith("/") else target[1:], sheet)
        book.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        if styles:
            book.writestr("xl/styles.xml", styles)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')


HEADER = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>when</t>'
          '</is></c><c r="D1" t="inlineStr"><is><t>ok</t></is></c></row>')
SHARED = ("<t>id</t>", "<r><t>na</t></r><r><t>me</t></r><rPh><t>hint</t></rPh>", "<t>Ann &amp; Bob</t>")
SCHEMA = (T.StructType().add("id", T.LongType()).add("name", T.StringType()).add("when", T.TimestampNTZType())
          .add("ok", T.BooleanType()).add("absent", T.DoubleType()))


def test_workbook_cells(spark, tmp_path):
    body = ('<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2"><v>45292.5</v></c>'
            '<c r="D2" t="b"><v>1</v></c></row>'
            '<row r="5"><c r="B5" t="str"><f>A1</f><v>x</v></c><c r="D5" t="b"><v>0</v></c></row>'
            '<row r="6"/><row r="7"><c r="A7" t="e"><v>#N/A</v></c><c r="C7" t="d"><v>2024-01-02T03:04:05</v></c></row>')
    workbook(tmp_path / "a.xlsx", HEADER + body, SHARED)
    (tmp_path / "ignored.txt").write_text("x")
    found = sorted(map(tuple, read_xlsx(spark, str(tmp_path), SCHEMA).collect()), key=str)
    assert found == [
        (1, "Ann & Bob", dt.datetime(2024, 1, 1, 12), True, None),
        (None, "x", None, False, None),
        (None, None, dt.datetime(2024, 1, 2, 3, 4, 5), None, None),
    ]


def test_workbooks_of_a_folder_with_1904_dates_and_other_column_order(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", HEADER + '<row><c><v>1</v></c><c t="s"><v>2</v></c><c><v>0</v></c></row>', SHARED,
             since_1904=True, target="/xl/worksheets/absolute.xml")
    swapped = ('<row><c t="s"><v>1</v></c><c t="s"><v>0</v></c></row>'
               '<row><c t="inlineStr"><is><t>Eve</t></is></c><c><v>7</v></c></row>')
    workbook(tmp_path / "b.XLSX".lower(), swapped, SHARED)
    schema = T.StructType.fromDDL("id int, name string, when date")
    found = sorted(map(tuple, read_xlsx(spark, str(tmp_path), schema).collect()))
    assert found == [(1, "Ann & Bob", dt.date(1904, 1, 1)), (7, "Eve", None)]


def test_workbook_types_are_inferred(spark, tmp_path):
    rows = ("<row>" + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in "ABCDE") + "</row>"
            '<row><c><v>1</v></c><c><v>3000000000</v></c><c><v>1.5</v></c><c t="b"><v>1</v></c>'
            '<c t="inlineStr"><is><t>x</t></is></c></row>')
    workbook(tmp_path / "a.xlsx", rows)
    df = load_file(spark, str(tmp_path / "a.xlsx"))
    assert df.dtypes == [("A", "int"), ("B", "bigint"), ("C", "double"), ("D", "boolean"), ("E", "string")]
    assert df.first() == (1, 3000000000, 1.5, True, "x")


STYLES = (f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/>'
          '<numFmt numFmtId="165" formatCode="0.0&quot; days&quot;[Red]"/></numFmts><cellXfs><xf numFmtId="0"/>'
          '<xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')


def test_date_styles_and_yes_no(spark, tmp_path):
    rows = ("<row>" + "".join(f'<c t="inlineStr"><is><t>{n}</t></is></c>' for n in "ABCDE") + "</row>"
            '<row><c s="1"><v>45292</v></c><c s="2"><v>45292.25</v></c><c s="3"><v>2</v></c><c s="0"><v>45292</v></c>'
            '<c t="inlineStr"><is><t>Yes</t></is></c></row>'
            '<row><c/><c s="2"><v>45293</v></c></row>')
    workbook(tmp_path / "a.xlsx", rows, styles=STYLES)
    df = read_xlsx(spark, str(tmp_path))
    assert df.dtypes == [("A", "date"), ("B", "timestamp"), ("C", "int"), ("D", "int"), ("E", "string")]
    assert df.selectExpr("A", "string(B)", "C", "D", "E").collect() == [
        (dt.date(2024, 1, 1), "2024-01-01 06:00:00", 2, 45292, "Yes"), (None, "2024-01-02 00:00:00", None, None, None)]
    typed = read_xlsx(spark, str(tmp_path), T.StructType.fromDDL("A timestamp_ntz, B date, D date"))
    assert typed.first() == (dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 1, 1))


def test_decimal_cells(spark, tmp_path):
    rows = ('<row><c t="inlineStr"><is><t>v</t></is></c></row><row><c><v>150.1</v></c></row>'
            '<row><c t="inlineStr"><is><t>no</t></is></c></row>')
    workbook(tmp_path / "a.xlsx", rows)
    df = read_xlsx(spark, str(tmp_path), T.StructType.fromDDL("v decimal(10,2)"))
    assert df.collect() == [(decimal.Decimal("150.10"),)] + [(None,)]


def test_tasks_need_no_copy_of_the_library(tmp_path):
    workbook(tmp_path / "a.xlsx", HEADER + '<row><c><v>1</v></c></row>', SHARED)
    (tmp_path / "task.pickle").write_bytes(cloudpickle.dumps(workbooks._data_rows))
    code = ("import pickle, sys; f = pickle.load(open('task.pickle', 'rb')); "
            "print(len(list(f(open('a.xlsx', 'rb').read()))), 'tablewright' in sys.modules)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.split() == ["1", "False"], done.stderr


@pytest.mark.parametrize("path, suffix", [
    ("/a/b.CSV", ".csv"), ("hdfs://h:8020/x.parquet/", ".parquet"), ("/a.b/c", ""), ("/a/.csv", "")])
def test_extension(path, suffix):
    assert extension(path) == suffix


def test_unknown_extension(spark, tmp_path):
    (tmp_path / "a.dat").write_text("x,y\n1,b\n")
    with pytest.raises(ValueError, match=".dat"):
        load_file(spark, str(tmp_path / "a.dat"))
    assert load_file(spark, str(tmp_path / "a.dat"), on_unknown="csv").first() == (1, "b")


def test_json_documents_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert read_json(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert read_json(spark, str(tmp_path / "b.json"), "a int", multi_line=False).count() == 2


def test_ingest(spark):
    df = spark.createDataFrame(
        [(None, None, None, "nan", None), (3, float("nan"), True, "", dt.date(2024, 1, 2)), (4, 1.5, False, "x", None)],
        "`Big Id` int, f float, b boolean, s string, d date").selectExpr("*", "1 as big_id")
    assert [f.dataType.simpleString() for f in ingest_typed(df).schema] == [
        "bigint", "double", "boolean", "string", "string"]
    assert ingest_typed(df).columns == ["big_id", "f", "b", "s", "d"]
    assert sorted(map(tuple, ingest_typed(df).collect())) == [
        (0, 0.0, False, None, None), (3, 0.0, True, None, "2024-01-02"), (4, 1.5, False, "x", None)]


def test_upsert_places_and_repeats(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "id string, seq int, v string")
    first = registry.upsert(stored, spark.createDataFrame([("a", 9, "new"), ("c", 5, "new")], stored.schema), "id", "seq")
    listed = [tuple(r) for r in first.orderBy("place").collect()]
    assert listed == [("a", 9, "new", 1), ("b", 2, "old", 2), ("c", 5, "new", 5)]
    again = registry.upsert(first, spark.createDataFrame([("a", 9, "new")], stored.schema), "id", "seq")
    assert [tuple(r) for r in again.orderBy("place").collect()] == listed


def test_an_update_wins_even_if_it_is_older(spark):
    stored = spark.createDataFrame([("a", 10, "stored")], "id string, seq int, v string")
    merged = registry.upsert(stored, spark.createDataFrame([("a", 2, "update")], stored.schema), "id", "seq")
    assert merged.first()["v"] == "update"


def test_loads_are_recorded_once_per_job(spark):
    target = new_namespace(spark) + ".registry"
    fields = registry.read_registry(spark, scratch_dir(spark) + ".none").columns
    for dag_id, rows, at in (("a", 1, "2024-01-01 10:00"), ("b", 2, "2024-01-02 10:00"), ("a", 3, "2024-01-03 10:00")):
        jobs.record_load(spark, target, dict.fromkeys(fields) | {"dag_id": dag_id, "row_count": rows, "created_at": at})
    stored = read_table(spark, target)
    assert sorted((r["dag_id"], r["row_count"], r["place"]) for r in stored.collect()) == [
        ("a", 3, "2024-01-01 10:00"), ("b", 2, "2024-01-02 10:00")]
    assert [r["row_count"] for r in registry.list_registry(stored).collect()] == ["3 rows", "2 rows"]
    assert [r["dag_id"] for r in registry.list_registry(stored, order_by="place").collect()] == ["b", "a"]


def test_files_load_into_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Big Id,note\n1,"say ""hi"", ok"\n,\n2,"two\nlines"\n')
    loaded = jobs.load_file_table(spark, str(tmp_path / "a.csv"), new_namespace(spark) + ".t")
    assert loaded.rows == 3
    stored = read_table(spark, loaded.table)
    assert sorted(map(tuple, stored.collect())) == [(0, None), (1, 'say "hi", ok'), (2, "two\nlines")]
    assert stored.dtypes == [("big_id", "bigint"), ("note", "string")]


def test_marks_of_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,s,t,u\n1.5,NA,a,NULL\nN/A,x,null,N/A\n2,n/a,NaN,\n")
    loaded = read_table(spark, jobs.load_file_table(spark, str(tmp_path / "a.csv"), new_namespace(spark) + ".t").table)
    assert sorted(map(tuple, loaded.collect())) == [(0.0, "x", None, None), (1.5, None, "a", None), (2.0, None, None, None)]


def test_files_are_cleaned_into_staging(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n1,x\n2,\n")
    path, log = jobs.clean_file(spark, str(tmp_path / "a.csv"), str(tmp_path), "t", "src")
    assert path == f"{tmp_path}/staging/t_cleaned" and "copies of rows: 1 left out" in log
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(path).collect()) == [(1, "x"), (2, "UNKNOWN")]


def test_missing_registry_is_empty(spark, tmp_path):
    empty = registry.read_registry(spark, str(tmp_path / "none.json"))
    assert empty.count() == 0 and "dag_id" in empty.columns


def test_dialects():
    assert jdbc.dialect_of("jdbc:mysql://h/db").name("a`b", "t") == "`a``b`.`t`"
    assert jdbc.dialect_of("jdbc:derby:memory:x").name("APP", "t") == '"APP"."t"'
    assert "pg_catalog" in jdbc.dialect_of("jdbc:postgresql://h/db").system_schemas


def test_bounds():
    assert jdbc._bound(decimal.Decimal("-1.5")) == "-2"
    assert jdbc._bound(dt.date(2024, 1, 2)) == "2024-01-02"
