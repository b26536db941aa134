import os
import subprocess
import sys

from odd import documents
from pyspark.sql import functions as F

from tablewright.llm import shared

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

OUTSIDE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["op4_decontamination"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_library(tmp_path):
    """The session starts in another folder, and only the driver knows the path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", OUTSIDE.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in done.stdout, done.stderr[-2_000:]


def test_words():
    text = "A-b Ça x 1_2\0é".encode()
    assert shared.letter_words(text) == ["a".encode(), b"b", "Ça x".encode().lower(), b"1", b"2", "é".encode()]
    assert shared.blank_words("A\tB c \x0b\x1cD".encode()) == [b"a", "b c".encode(), b"\x1cd"]


def test_large_groups_are_cut(spark):
    rows = spark.range(100).withColumn("g", F.when(F.col("id") < 90, 0).otherwise(F.col("id")))
    sizes = rows.groupBy("g").count()
    parts = {r["g"]: r["parts"] for r in shared.with_parts(rows, sizes, ["g"], 20).collect()}
    assert parts[0] == 5 and set(parts.values()) == {1, 5}
    assert {r["parts"] for r in shared.with_parts(rows, sizes, ["g"], 50).collect()} == {1}


def test_names_and_results(spark):
    docs = documents(spark)
    assert shared.unused("cut", docs) == "cut_0" and shared.unused("new", docs) == "new"
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.LongType())])
    out = shared.with_result(docs, "text", "n", schema, lambda: lambda raw: (len(raw),))
    assert sum(r["n"]["n"] for r in out.collect()) == sum(len((r["text"] or "").encode()) for r in docs.collect())
