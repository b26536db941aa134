"""Stored tables: partitions, replaces, deletes, merges."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablewright.operators import tables
from tablewright.operators.staging import scratch_dir, stage, staged
from tablewright.plans.storing import new_namespace


@pytest.fixture
def table(spark):
    return new_namespace(spark) + ".t"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(spark, table):
    return {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in spark.table(table).inputFiles()}


def test_partition_values_of_every_kind(spark, table):
    values = [None, "", "a b", "x/y", "100%", "k=v", "é:ü", "it's", "{1}", "[2]", "q?*", "back\\slash"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, part string")
    tables.create_or_replace(df, table, ["part"])
    # Parquet folders cannot tell an empty partition value from a missing one.
    assert rows(tables.read_table(spark, table)) == rows(df.withColumn("part", F.nullif("part", F.lit(""))))
    tables.overwrite_partitions(df.filter("part = 'x/y'").withColumn("id", F.lit(-1)), table)
    for gone in ("100%", "it's", "back\\slash"):
        tables.delete_where(spark, table, f"id = {values.index(gone)}", confirm=True)
    left = {r["part"]: r["id"] for r in tables.read_table(spark, table).filter("part is not null").collect()}
    assert left["x/y"] == -1 and set(left) == set(values) - {None, "", "100%", "it's", "back\\slash"}
    tables.delete_where(spark, table, "part is null", confirm=True)
    assert tables.read_table(spark, table).filter("part is null").count() == 0


def test_refresh_keeps_rows(spark, table):
    df = spark.range(100).selectExpr("id", "id % 3 as g")
    tables.create_or_replace(df, table, ["g"])
    tables.append(df.filter("g = 0"), table)
    done = tables.refresh(spark, table)
    assert (done.rows_read, done.rows_stored, done.snapshots) == (134, 134, None)
    assert rows(tables.read_table(spark, table)) == rows(df.union(df.filter("g = 0")))


def test_overwrite_of_an_unpartitioned_table_replaces_all(spark, table):
    tables.create_or_replace(spark.range(10), table)
    tables.overwrite_partitions(spark.range(3), table)
    assert tables.verify_count(spark, table) == 3


def test_overwrite_leaves_other_partitions_and_the_setting(spark, table):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    df = spark.range(30).selectExpr("id", "id % 3 as g")
    tables.create_or_replace(df, table, ["g"])
    tables.overwrite_partitions(df.filter("id = 4"), table)
    assert rows(tables.read_table(spark, table)) == rows(df.filter("g <> 1 or id = 4"))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_delete_keeps_rows_whose_condition_is_null(spark, table):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, v int")
    tables.create_or_replace(df, table)
    assert rows(tables.delete_where(spark, table, "v > 10")) == [(3, 50)]
    assert tables.verify_count(spark, table) == 3
    assert tables.delete_where(spark, table, "v > 10", confirm=True) is None
    assert rows(tables.read_table(spark, table)) == [(1, None), (2, 5)]
    before = files(spark, table)
    tables.delete_where(spark, table, "v > 1000", confirm=True)
    assert files(spark, table) == before  # nothing to delete, nothing written
    tables.delete_where(spark, table, "true", confirm=True)
    assert tables.read_table(spark, table).count() == 0


def test_delete_rewrites_only_partitions_with_hits(spark, table):
    tables.create_or_replace(spark.range(30).selectExpr("id", "id % 3 as g"), table, ["g"])
    before = files(spark, table)
    tables.delete_where(spark, table, "id = 4", confirm=True)
    changed = before ^ files(spark, table)
    assert changed and all(f.startswith("g=1/") for f in changed)
    tables.delete_where(spark, table, "g = 2", confirm=True)
    assert tables.verify_count(spark, table) == 19


def test_replace_changes_the_columns_and_may_read_the_table(spark, table):
    tables.create_or_replace(spark.range(2), table)
    tables.create_or_replace(spark.table(table).selectExpr("cast(id as string) as name", "1 as n"), table)
    assert tables.read_table(spark, table).dtypes == [("name", "string"), ("n", "int")]
    tables.replace_ctas(spark.table(table).withColumn("g", F.lit("x")), table, "g")
    assert tables.partition_columns(spark, table) == ["g"] and tables.verify_count(spark, table) == 2


def test_create_is_empty_once(spark, table):
    schema = spark.range(1).schema
    tables.create_table(spark, table, schema)
    assert tables.read_table(spark, table).count() == 0
    tables.append(spark.range(4), table)
    tables.create_table(spark, table, schema)
    assert tables.verify_count(spark, table) == 4


def test_columns_go_by_name_and_must_match(spark, table):
    tables.create_or_replace(spark.range(2).selectExpr("id", "'a' as v"), table)
    tables.append(spark.range(1).selectExpr("'b' as v", "cast(id as int) as id"), table)
    assert rows(tables.read_table(spark, table)) == [(0, "a"), (0, "b"), (1, "a")]
    with pytest.raises(ValueError, match="extra"):
        tables.append(spark.range(2).selectExpr("id", "'a' as v", "1 as x"), table)


def test_merge(spark, table):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (9, "z", "other")], "id int, v string, part string")
    tables.create_or_replace(df, table, ["part"])
    before = files(spark, table)
    # as in any table, the stored types stay
    updates = spark.createDataFrame([(2, "B", "x"), (3, "c", "w")], "id bigint, v string, part string")
    for _ in range(2):
        tables.merge(updates, table, "id")
        assert rows(tables.read_table(spark, table)) == [(1, "a", "x"), (2, "B", "x"), (3, "c", "w"), (9, "z", "other")]
    assert tables.read_table(spark, table).dtypes[0] == ("id", "int")
    assert any(f.startswith("part=other/") for f in before & files(spark, table))
    with pytest.raises(ValueError, match="repeats"):
        tables.merge(updates.union(updates), table, "id")


def test_merge_into_a_table_without_partitions(spark, table):
    tables.create_or_replace(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), table)
    tables.merge(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string"), table, "id")
    assert rows(tables.read_table(spark, table)) == [(1, "a"), (2, "B"), (3, "c")]


def test_write_table(spark, table):
    moment = dt.datetime(2024, 5, 6, 7, 8, 9)
    df = spark.createDataFrame([(1, moment), (2, None)], "id int, at timestamp")
    assert tables.write_table(df, table).rows == 2
    assert tables.read_table(spark, table).filter("at_day = date'2024-05-06'").count() == 1
    with pytest.raises(ValueError):
        tables.write_table(df, table, mode="merge")


def test_snapshots_need_a_format(spark, table):
    tables.create_or_replace(spark.range(1), table)
    with pytest.raises(ValueError, match="no snapshots"):
        tables.snapshots(spark, table)
    log = spark.createDataFrame([(1, None, "append", {"added-records": "7"}), (2, dt.datetime(2024, 1, 1), "append", None)],
                                "snapshot_id bigint, committed_at timestamp, operation string, summary map<string,string>")
    assert [(r["snapshot_id"], r["added_records"]) for r in tables.newest_snapshots(log).collect()] == [(2, None), (1, 7)]
    assert tables.newest_snapshots(log, 1).count() == 1


def test_describe(spark, table):
    assert tables.describe(spark, table).count() == 0
    tables.create_or_replace(spark.range(1).selectExpr("id", "1 as g"), table, ["g"])
    assert [tuple(r)[1:] for r in tables.describe(spark, table).collect()] == [("id", "bigint"), ("g", "int")]
    with pytest.raises(AnalysisException):
        tables.read_table(spark, table + "_absent")


def test_partition_pruning_reaches_the_scan(spark, table):
    tables.create_or_replace(spark.range(30).selectExpr("id", "cast(id % 3 as string) as g"), table, ["g"])
    plan = tables.read_table(spark, table).filter("g = '1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in plan


@pytest.mark.parametrize("values, chosen", [(100, "v"), (101, None), (1, None), (2, "v")])
def test_choice_counts_exactly(spark, values, chosen):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", f"case when id % {values} = 0 then null else string(id % {values}) end as v")
    assert tables.choose_partition(df) == chosen


def test_hot_partition_is_split_over_files(spark, table):
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "500k", "spark.sql.shuffle.partitions": "400"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 300_000, 1, 8).selectExpr("id", "sha2(string(id), 256) as v",
                                                      "case when id % 3 = 0 then id % 50 else 7 end as g")
        tables.create_or_replace(df, table, ["g"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stored = tables.read_table(spark, table)
    assert stored.count() == 300_000
    of_partition = Counter(f.rsplit("/", 2)[1] for f in stored.inputFiles())
    assert of_partition["g=7"] > 3
    assert sorted(of_partition.values())[len(of_partition) // 2] == 1


def test_stage_reads_back_what_it_wrote(spark):
    df = spark.range(10).selectExpr("id", "cast(null as date) as d")
    kept = stage(df)
    assert kept.dtypes == df.dtypes and rows(kept) == rows(df)
    with staged(df) as held:
        assert rows(held) == rows(df)
        path = held.inputFiles()[0]
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        spark.read.parquet(path).count()


class FakeSession:
    """A session of which only the settings matter."""

    def __init__(self, **settings):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: settings.get(key, default))})
        self.sparkContext = type("Context", (), {"_jsc": None})


def test_scratch_folder_is_a_shared_one():
    shared = FakeSession(**{"spark.checkpoint.dir": "hdfs://shared/scratch/"})
    assert scratch_dir(shared).startswith("hdfs://shared/scratch/") and scratch_dir(shared) != scratch_dir(shared)
    assert scratch_dir(FakeSession(**{"spark.sql.warehouse.dir": "file:/lake"})).startswith("file:/lake/.scratch/")


def test_tables_say_how_they_are_overwritten(spark):
    """No session setting changes while a table of this library is written; one of another maker still keeps its other partitions."""
    namespace = new_namespace(spark)
    key, seen = "spark.sql.sources.partitionOverwriteMode", []
    rows = spark.range(6).select("id", (F.col("id") % 3).alias("p"))
    tables.create_or_replace(rows, f"{namespace}.own", ["p"])
    rows.write.partitionBy("p").saveAsTable(f"{namespace}.other")
    tables.create_table(spark, f"{namespace}.made", rows.schema, ["p"])
    tables.append(rows, f"{namespace}.made")
    for name in ("own", "made", "other"):
        with tables._replacing_by_partition(spark, f"{namespace}.{name}"):
            seen.append(spark.conf.get(key).lower())
        tables.overwrite_partitions(spark.createDataFrame([(10, 1)], "id bigint, p bigint"), f"{namespace}.{name}")
        assert sorted(r["id"] for r in spark.table(f"{namespace}.{name}").collect()) == [0, 2, 3, 5, 10]
    assert seen == ["static", "static", "dynamic"] and spark.conf.get(key).lower() == "static"


def test_many_emptied_partitions_go_in_few_statements(spark, monkeypatch):
    namespace = new_namespace(spark)
    monkeypatch.setattr(tables, "DROPPED_AT_ONCE", 4)
    rows = spark.range(40).select("id", F.concat(F.lit("it's "), F.col("id") % 20).alias("p"), F.when(F.col("id") % 20 < 19, F.col("id") % 20).alias("q"))
    tables.create_or_replace(rows, f"{namespace}.many", ["p", "q"])
    asked, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: asked.append(text) or sql(self, text, *a, **k))
    tables.delete_where(spark, f"{namespace}.many", "id % 20 >= 10", confirm=True)
    assert sum("DROP IF EXISTS PARTITION" in t for t in asked) == 3
    assert sorted(r["id"] for r in spark.table(f"{namespace}.many").collect()) == [i for i in range(40) if i % 20 < 10]
    assert sql(spark, f"show partitions {namespace}.many").count() == 10


def test_merges_that_do_not_shuffle_the_table(spark):
    table = f"{new_namespace(spark)}.b"
    rows = spark.range(1_000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    tables.create_bucketed(rows, table, "k", 4)
    for round_ in range(2):
        changed = spark.range(900, 1_100 + round_).select(F.col("id").alias("k"), F.lit(f"new{round_}").alias("v"))
        plan = tables.merged_buckets(changed, table, "k", 4)._jdf.queryExecution().executedPlan().toString()
        before_table = plan[:plan.index("FileScan parquet")]
        path = [line for line in before_table.splitlines() if "Exchange" in line]
        assert not path and "SelectedBucketsCount: 4 out of 4" in plan
        tables.merge_bucketed(changed, table, "k")
        stored = {r["k"]: r["v"] for r in spark.table(table).collect()}
        assert stored == {k: "old" for k in range(900)} | {k: f"new{round_}" for k in range(900, 1_100 + round_)} and spark.table(table).count() == len(stored)
    tables.merge_bucketed(spark.table(table).where("k < 5").withColumn("v", F.lit("own")), table, "k")
    assert spark.table(table).where("v = 'own'").count() == 5
    with pytest.raises(ValueError, match="repeats"):
        tables.merge_bucketed(spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, v string"), table, "k")
    with pytest.raises(ValueError, match="buckets"):
        tables.merge_bucketed(rows, table, "v")
