"""Profiling on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profiling
from tablewright.operators.tables import choose_partition


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert profiling.profile_nulls(df).first()[2:] == (2, 66.67)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert [r["nulls"] for r in profiling.profile_nulls(df).collect()] == [0, 0]
    assert [r["distinct_values"] for r in profiling.profile_distinct(df).collect()] == [0, 0]
    assert profiling.duplicate_rows(df).first() == (0, 0)
    assert profiling.quality_score(df).first()[0] == 100.0
    assert [r["issue"] for r in profiling.issues(df).collect()] == [profiling.NO_ISSUES]
    assert profiling.size_report(df).first() == (0, 2, 0, 0.0)


def test_distinct_values(spark):
    long = "x" * 100
    df = spark.createDataFrame(
        [(0.0, long, b"a", {"a": 1, "b": 2}), (-0.0, long, b"a", {"b": 2, "a": 1}),
         (float("nan"), long + "y", b"b", None), (1.0, None, None, {"a": 1})],
        "f double, s string, y binary, m map<string,int>").selectExpr(
        "*", "array(s, cast(f as string)) as a", "named_struct('q', s) as t", "cast(f > 0 as boolean) as b",
        "cast(1 as smallint) as h", "date'2024-01-01' as d", "cast(1.5 as decimal(5,2)) as e")
    found = {r["name"]: r["distinct_values"] for r in profiling.profile_distinct(df).collect()}
    assert found == {"f": 2, "s": 2, "y": 2, "m": 2, "a": 4, "t": 3, "b": 2, "h": 1, "d": 1,
                     "e": 1}
    rough = {r["name"]: r["distinct_values"] for r in
             profiling.profile_distinct(df.select("f", "s"), rsd=0.02).collect()}
    assert rough["s"] == 2


def test_short_text_is_never_a_digest(spark):
    import hashlib
    long = "x" * 100
    digest = "#" + hashlib.sha256(long.encode()).hexdigest()
    df = spark.createDataFrame([(long,), (digest,)], "s string")
    assert profiling.profile_distinct(df).first()["distinct_values"] == 2


def test_duplicates(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, "a"), (None, "a"), (1.0, "b"), (1.0, "b"), (1.0, "b"), (2.0, None)],
                               "x double, s string")
    assert profiling.duplicate_rows(df).first() == (6, 3)


def test_issues_and_score(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert [r["issue"] for r in profiling.issues(df).collect()] == [
        "2 null values across 1 columns", "1 duplicate rows", "Column 'b' has >50% nulls — consider dropping"]
    assert profiling.quality_score(df).first()[0] == round(100 - 2 / 6 * 50 - 1 / 3 * 30, 1)


def test_samples(spark):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (4, "d"), (5, "e")], "k int, s string")
    samples = {r["name"]: r["sample"] for r in profiling.profile_samples(df, "k").collect()}
    assert samples == {"k": ["1", "2", "3"], "s": ["b", "c", "d"]}


@pytest.mark.parametrize("key", ["k", "t", "z", "d", "s", "constant", "holes"])
def test_samples_by_keys_of_any_type(spark, key):
    df = spark.range(0, 500, 1, 4).selectExpr(
        "id * 7919 % 500 as k", "timestamp'2024-01-01 00:00:00.5' + make_interval(0, 0, 0, 0, 0, 0, id) as t",
        "timestamp_ntz'2024-01-01' - make_interval(0, 0, 0, 0, 0, 0, id) as z", "cast(id / 7 as double) as d",
        "lpad(string(id * 31 % 500), 4, '0') as s", "1 as constant", "case when id < 498 then id end as holes",
        "case when id % 250 = 3 then id end as rare", "cast(null as int) as never")
    found = {r["name"]: r["sample"] for r in profiling.profile_samples(df, key).collect()}
    rows = df.select(*[F.col(c).cast("string") for c in df.columns], F.col(key).alias("key")).collect()
    for name in ("rare", "never", "k") if key != "constant" else ("rare", "never"):
        kept = sorted(((r["key"] is not None, r["key"], int(r[name])) for r in rows if r[name] is not None),
                      key=lambda x: (x[0], x[1] if x[0] else 0, x[2]))
        assert found[name] == [str(v) for _, _, v in kept[:3]]


def test_report(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, None)], "k int, `odd name.x` string")
    report = profiling.profile(df, "k", file="f.csv").first()
    assert (report["file"], report["rows"], report["columns"]) == ("f.csv", 2, 2)
    assert report["column_names"] == ["k", "odd name.x"]
    assert report["dtypes"] == {"k": "int", "odd name.x": "string"}
    assert report["schema"][1].asDict() == {
        "name": "odd name.x", "dtype": "string", "nulls": 1, "null_pct": 50.0, "unique": 1, "sample": ["a.b"]}
    assert [tuple(r) for r in report["preview"]] == [(1, "a.b"), (2, None)]


def test_partition_choice(spark):
    many = [(i, f"v{i}", "ab"[i % 2], dt.date(2024, 1, 1)) for i in range(200)]
    df = spark.createDataFrame(many, "i int, wide string, narrow string, day date")
    assert choose_partition(df) == "day"
    assert choose_partition(df.drop("day")) == "narrow"
    assert choose_partition(df.select("i", "wide")) is None
    assert choose_partition(df.selectExpr("i", "'one' as s")) is None
    assert choose_partition(df.selectExpr("i", "case when i > 3 then 'one' end as s")) == "s"
    assert choose_partition(df.selectExpr("array(day) as days", "current_timestamp() as _ingested_at")) is None
    assert choose_partition(df.limit(0).select("wide")) is None


def test_samples_across_a_clock_change(spark):
    """An hour that comes twice in the session's zone is two hours."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(200).selectExpr("timestamp_micros(1762059600000000 + id * 36000000) as at", "id", "string(id) as s")
        found = {r["name"]: r["sample"] for r in profiling.profile_samples(df, "at").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found["id"] == found["s"] == ["0", "1", "2"] and len(found["at"]) == 3


def test_many_samples(spark):
    found = {r["name"]: r["sample"] for r in profiling.profile_samples(spark.range(0, 1000, 1, 4).selectExpr("id", "id % 7 as m"), "id", 100).collect()}
    assert found["id"] == [str(i) for i in range(100)] and len(found["m"]) == 100


def test_report_has_no_join_and_no_local_rows(spark):
    df = spark.range(100).selectExpr("id", "string(id % 3) as s", "cast(null as int) as n")
    plan = profiling.profile(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ExistingRDD" not in plan
