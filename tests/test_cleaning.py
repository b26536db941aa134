"""Quirks of the cleaning steps on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.functions.names import clean_name, clean_names
from tablewright.operators import cleaning


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("raw, clean", [
    (" Order Key ", "order_key"), ("Price (EUR)", "price_eur"), ("a-b.c/d", "a_b_c_d"), ("x", "x")])
def test_names(raw, clean):
    assert clean_name(raw) == clean
    assert clean_name(clean) == clean


def test_equal_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a-b", "a_b_2"])
    with pytest.raises(ValueError, match="a_b"):
        clean_names(df)
    assert clean_names(df, "first").collect() == [(1, 3)]
    assert clean_names(df, "suffix").columns == ["a_b", "a_b_3", "a_b_2"]


def test_duplicates_go_before_trimming(spark):
    df = spark.createDataFrame([("x",), ("x ",), ("x",)], "s string")
    cleaned, log = cleaning.clean(df, "t")
    assert [r["s"] for r in cleaned.collect()] == ["x", "x"]
    assert "copies of rows: 1 left out" in log


def test_blank_rows_are_not_empty_rows(spark):
    df = spark.createDataFrame([("  ", None), (None, None), (None, None), ("a", "b")], "s string, t string")
    cleaned, log = cleaning.clean(df, "t")
    assert rows(cleaned.select("s", "t")) == [("UNKNOWN", "UNKNOWN"), ("a", "b")]
    assert "empty rows: 2 left out" in log and "copies of rows: 0 left out" in log


def test_steps_one_by_one_equal_the_whole(spark):
    df = spark.createDataFrame(
        [(i % 40, float(i % 7) if i % 3 else None, f" {i % 9} " if i % 50 else "n/a", None if i % 5 else True)
         for i in range(200)], "k int, x double, n string, b boolean")
    whole, _ = cleaning.clean(df, "t", rel_error=0.0)
    step = cleaning.trim_blank(cleaning.dedupe(cleaning.drop_empty(df)))
    step = cleaning.drop_sparse(cleaning.fill_nulls(cleaning.infer_numeric(step), rel_error=0.0))
    assert whole.columns == ["k", "x", "n", "_ingested_at", "_source"]
    assert rows(whole.select("k", "x", "n")) == rows(step)


def test_cast_needs_more_than_the_threshold(spark):
    nine = spark.createDataFrame([(str(i),) for i in range(9)] + [("x",)], "s string")
    assert cleaning.infer_numeric(nine).dtypes == [("s", "string")]
    ten = spark.createDataFrame([(str(i),) for i in range(10)] + [("x",)], "s string")
    assert cleaning.infer_numeric(ten).dtypes == [("s", "double")]
    assert cleaning.infer_numeric(ten).filter("s is null").count() == 1
    assert cleaning.infer_numeric(spark.createDataFrame([(None,)], "s string")).dtypes == [("s", "string")]
    odd = spark.createDataFrame([("1e3",), ("NaN",), ("Infinity",)], "s string")
    assert cleaning.infer_numeric(odd).dtypes == [("s", "double")]


def test_numbers_in_text(spark):
    texts = ["1", "-1.5", "+.5", "5.", "1e3", "1E-3", "1d", "2F", "0x1p3", "0x1.8p1d", "NaN", "nan", "NAN", "inf", "-Inf",
             "+infinity", "Infinity", "-INFINITY", " 7 ", "\t8\n", "\x007\x1f", "", " ", ".", "-", "e", "1-URGENT", "n",
             "in", "d", "1,000", "1_0", "٣", "１", "--1", "1e", "0x", "true", "Nancy", "x" * 10_000, "\u00a01", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    compared = df.select("s", cleaning._as_number(F.col("s")).cast("string").alias("found"),
                         F.col("s").try_cast("double").cast("string").alias("expected")).collect()
    assert [(r["s"], r["found"]) for r in compared] == [(r["s"], r["expected"]) for r in compared]
    assert sum(r["found"] is not None for r in compared) >= 20


def test_fills(spark):
    df = spark.createDataFrame(
        [(None, 1.0, None, None), (2, float("nan"), None, "a"), (3, None, None, None)],
        "i int, f double, empty bigint, s string")
    filled = cleaning.fill_nulls(df, rel_error=0.0)
    assert rows(filled) == [(2, 1.0, 0, "UNKNOWN"), (2, 1.0, 0, "a"), (3, 1.0, 0, "UNKNOWN")]
    assert filled.dtypes == df.dtypes


def test_approximate_median_is_near(spark):
    df = spark.range(30_000).selectExpr("case when id % 3 = 0 then null else cast(id * id as double) end as x")
    fill = cleaning.medians(df, ["x"], 0.01)["x"]
    share = df.filter(F.col("x") <= fill).count() / 20_000
    assert abs(share - 0.5) <= 0.02


def test_nan_stays_where_no_value_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "f double")
    assert cleaning.fill_nulls(df).filter(F.isnan("f")).count() == 1


def test_median_of_int_is_cut(spark):
    df = spark.createDataFrame([(-3,), (None,), (5,), (8,)], "i int")
    assert rows(cleaning.fill_nulls(df, rel_error=0.0)) == [(-3,), (5,), (5,), (8,)]


def test_other_types_are_not_filled_but_dropped_when_sparse(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, None, None)] * 3 + [(1, day, None)], "k int, d date, b boolean")
    assert cleaning.fill_nulls(df).filter("d is null").count() == 3
    assert cleaning.drop_sparse(df).columns == ["k"]
    assert cleaning.drop_sparse(df, threshold=0.75).columns == ["k", "d"]


def test_void_columns_go_unless_there_are_no_rows(spark):
    df = spark.range(2).selectExpr("id", "null as nothing")
    assert cleaning.clean(df, "t")[0].columns == ["id", "_ingested_at", "_source"]
    assert cleaning.clean(df.limit(0), "t")[0].columns == ["id", "nothing", "_ingested_at", "_source"]


def test_empty_input(spark):
    df = spark.createDataFrame([], "i int, s string, d date")
    cleaned, log = cleaning.clean(df, "t")
    assert cleaned.count() == 0
    assert cleaned.columns == ["i", "s", "d", "_ingested_at", "_source"]
    assert "sparse columns: none left out" in log


def test_nothing_left_to_fill(spark):
    df = spark.createDataFrame(
        [(None if i % 3 else i, None if i % 4 else i * 1.5, None if i % 5 else f"t{i}") for i in range(60)],
        "i int, f double, s string")
    cleaned, _ = cleaning.clean(df, "t")
    assert cleaned.filter("i is null or f is null or s is null").count() == 0
    assert cleaned.count() <= 60
    assert {r[0] for r in cleaned.select("_source").distinct().collect()} == {"t"}


def test_no_scan_for_medians(spark, monkeypatch):
    """The default error needs no call beside the counts, and fills are near the median."""
    monkeypatch.setattr(cleaning, "medians", None)
    df = spark.range(9_000).select("id", F.when(F.col("id") % 9 > 0, F.col("id") * 1.0).alias("x"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("t"))
    for filled in (cleaning.clean(df, "s")[0], cleaning.fill_nulls(df.drop("t"))):
        for name in {"x", "t"} & set(filled.columns):
            assert abs(filled.where("id % 9 = 0").agg(F.max(name)).first()[0] - 4_500) <= 90
