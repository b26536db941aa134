"""Files cut into ranges against Spark's whole-file readers."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.operators import tables
from tablewright.plans import jobs
from tablewright.sources import ranges

SIZES = [29, 150, 100_000]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(path)


def field(value, escape):
    return '"' + value.replace(escape, escape * 2).replace('"', escape + '"') + '"' if escape != '"' else '"' + value.replace('"', '""') + '"'


def csv_text(rng, escape, end="\n", n=25):
    values = ["", "plain", "two words", 'say "x"', "line\nbreak", "a,b", '"', "\n\n", ",\n,", "é漢", "it's", '\n"\n,"', "12", "-3.5"]
    lines = [["id", "text", "more words"]] + [[str(i), rng.choice(values), rng.choice(values)] for i in range(n)]
    return end.join(",".join(field(v, escape) if set(v) & set('",\n') or rng.random() < 0.2 else v for v in line) for line in lines) + rng.choice(["", end])


@pytest.mark.parametrize("split", SIZES)
@pytest.mark.parametrize("escape, end", [('"', "\n"), ("\\", "\n"), ('"', "\r\n")])
def test_csv_as_whole_files(spark, tmp_path, split, escape, end):
    rng = random.Random(split)
    for i in range(3):
        write(tmp_path / f"{i}.csv", csv_text(rng, escape, end))
    path = str(tmp_path)
    whole = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape=escape)
    cut = ranges.read_csv_ranges(spark, path, split_bytes=split, escape=escape)
    assert cut.schema == whole.schema and rows(cut) == rows(whole)
    if split < 100_000:
        assert ranges.records(spark, path, ranges.csv_format(escape=escape), split).where("first").count() == 3


def test_csv_parts(spark, tmp_path):
    """Without a header; with other marks; with a schema; an unquoted quote; an open quote at the end; nothing at all."""
    path = write(tmp_path / "a.csv", "1;'x\ny'\n2;it's\n\n3;'z'';'\r\n4;last")
    found = ranges.read_csv_ranges(spark, path, split_bytes=3, header=False, sep=";", quote="'", escape="'")
    assert rows(found) == rows(spark.read.csv(path, sep=";", quote="'", escape="'", multiLine=True, inferSchema=True))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a b", T.StringType())])
    typed = ranges.read_csv_ranges(spark, write(tmp_path / "b.csv", '﻿k,v\n1,"a\nb"\n2,\n'), schema, split_bytes=2)
    assert typed.schema == schema and rows(typed) == [(1, "a\nb"), (2, None)]
    assert rows(ranges.read_csv_ranges(spark, write(tmp_path / "c.csv", 'k,v\n1,"open\nto the end'), split_bytes=4)) == [(1, "open\nto the end")]
    assert ranges.read_csv_ranges(spark, write(tmp_path / "d.csv", "k,v\n"), split_bytes=4).columns == ["k", "v"]
    assert ranges.read_csv_ranges(spark, write(tmp_path / "e.csv", ""), split_bytes=4).count() == 0
    with pytest.raises(ValueError, match="encoding"):
        ranges.read_csv_ranges(spark, path, encoding="latin1")


def test_a_long_field_over_many_ranges(spark, tmp_path):
    text = "\n".join(f'line {i}, with "quotes"' for i in range(2_000))
    path = write(tmp_path / "long.csv", "k,v\n1," + field(text, '"') + '\n2,"x\ny"\n')
    found = ranges.read_csv_ranges(spark, path, split_bytes=500, escape='"')
    assert rows(found) == [(1, text), (2, "x\ny")]
    pieces = ranges._pieces(spark, path, "\n", 500)
    assert pieces.select(F.spark_partition_id()).distinct().count() > 20


@pytest.mark.parametrize("read, end", [(ranges.read_json_ranges, "json"), (ranges.read_csv_ranges, "csv")])
def test_smaller_ranges_make_no_more_tasks(spark, tmp_path, read, end):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    records = [(i, f'"{i}", {{}}\n' * (1 + i % 5)) for i in range(1_500)]
    if end == "json":
        path = write(tmp_path / "a.json", json.dumps([{"k": k, "v": v} for k, v in records]))
    else:
        path = write(tmp_path / "a.csv", "k,v\n" + "".join(f"{k},{field(v, chr(34))}\n" for k, v in records))
    options = {"escape": '"'} if end == "csv" else {}
    small, large = (read(spark, path, schema, split_bytes=size, **options) for size in (200, 400))
    assert ranges._pieces(spark, path, "\n", 200).rdd.getNumPartitions() > 150
    assert small.rdd.getNumPartitions() == large.rdd.getNumPartitions() < 100
    assert rows(large) == sorted(records, key=repr)


def test_ranges_of_one_task():
    """Ranges of several files in one batch, and one range in two batches."""
    import pyarrow as pa

    def batch(*found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], ["file", "start", "value"])

    batches = [batch(("a", 0, "1"), ("a", 0, "2"), ("b", 0, "3"), ("b", 9, "4")), batch(("b", 9, "5"), ("a", 9, "6"))]
    assert list(ranges._ranges(iter(batches))) == [("a", 0, ["1", "2"]), ("b", 0, ["3"]), ("b", 9, ["4"]), ("b", 9, ["5"]), ("a", 9, ["6"])]


def test_ranges_stay_when_settings_change(spark, tmp_path):
    path = write(tmp_path / "a.csv", csv_text(random.Random(4), '"', n=60))
    cut = ranges.read_csv_ranges(spark, path, split_bytes=100, escape='"')
    before = rows(cut)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        assert rows(cut) == before and cut.count() == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    other = spark.createDataFrame([(i,) for i in range(60)], "id int")
    assert cut.join(other, "id").count() == 60


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text(alphabet='ab"\\{}[],: \né', max_size=8))
VALUE = st.recursive(LEAF, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.sampled_from(["x", "y}", 'z"']), v, max_size=3)), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["k", "{", 'q"']), VALUE, max_size=3), max_size=6), st.sampled_from([None, 2]), st.booleans())
def test_json_steps(objects, indent, array):
    """Pieces between closing braces, from state to state, give the objects back."""
    form = ranges.json_format()
    text = json.dumps(objects, indent=indent) if array else "\n".join(json.dumps(o, indent=indent) for o in objects)
    pieces = text.split("}")
    base, mode, depth, held, found = int(form.nested(pieces[0])), 0, 0, "", []
    for piece in pieces[:-1] + [p for p in pieces[-1:] if p]:
        mode, change = form.step(mode, piece + "}")
        depth, held = depth + change, held + piece + "}"
        if not mode and depth <= base:
            found.append(held.lstrip(" \n,["))
            held = ""
    assert [json.loads(f) for f in found if f.strip("]} \n")] == objects


@pytest.mark.parametrize("split", SIZES)
def test_json_as_whole_files(spark, tmp_path, split):
    rng = random.Random(split)
    values = ["a", "}", '{"', "]\n[", "\\", '\\"', "é漢"]

    def record(i):
        return {"id": i, "text": rng.choice(values), "list": [{"x": rng.choice(values)} for _ in range(rng.randint(0, 2))], "in": {"deep": {"n": i}}}

    write(tmp_path / "a.json", json.dumps([record(i) for i in range(40)]))
    write(tmp_path / "b.json", "﻿" * 0 + json.dumps([record(i) for i in range(40, 60)], indent=2) + "\n")
    write(tmp_path / "c.json", json.dumps(record(60), indent=1))
    write(tmp_path / "d.json", " [ ] \n")
    whole = spark.read.json(str(tmp_path), multiLine=True)
    cut = ranges.read_json_ranges(spark, str(tmp_path), split_bytes=split)
    assert cut.schema == whole.schema and rows(cut) == rows(whole) and cut.count() == 61


def test_json_lines_and_nothing(spark, tmp_path):
    path = write(tmp_path / "l.json", "".join(json.dumps({"i": i, "t": "{}" * i}) + "\n" for i in range(9)))
    assert ranges.read_json_ranges(spark, path, split_bytes=5).count() == 9
    assert ranges.read_json_ranges(spark, write(tmp_path / "e.json", "")).count() == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='a",\n\\;é', max_size=6), min_size=2, max_size=2), min_size=1, max_size=8), st.sampled_from(['"', "\\"]))
def test_csv_steps(values, escape):
    """Lines, from state to state, give the records back."""
    form = ranges.csv_format(escape=escape)
    lines = "\n".join(",".join(field(v, escape) for v in record) for record in values).split("\n")
    mode, held, found = 0, [], []
    for line in lines:
        mode, _ = form.step(mode, line)
        held.append(line)
        if not mode:
            found.append("\n".join(held))
            held = []
    assert found == [",".join(field(v, escape) for v in record) for record in values] and not held


def test_file_jobs(spark, tmp_path):
    """J2 over files with breaks, in ranges and as whole files."""
    path = write(tmp_path / "a.csv", csv_text(random.Random(9), '"'))
    spark.sql("create database if not exists ranged")
    try:
        cut = jobs.load_file_table(spark, path, "ranged.cut", split_bytes=50)
        whole = jobs.load_file_table(spark, path, "ranged.whole", multiLine=True)
        assert cut.rows == whole.rows == 25
        assert rows(tables.read_table(spark, "ranged.cut")) == rows(tables.read_table(spark, "ranged.whole"))
    finally:
        spark.sql("drop database ranged cascade")
