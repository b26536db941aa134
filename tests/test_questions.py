"""SQL text: what runs, what is refused, what is reported."""

import pytest

from tablewright.operators import querying


@pytest.fixture(scope="module")
def numbers(spark):
    spark.range(120).createOrReplaceTempView("numbers")
    return "numbers"


@pytest.mark.parametrize("sql", [
    "select 1", "with a as (select 1 x) select * from a", "select * from numbers order by id limit 3",
    "describe table numbers", "show tables", "explain select 1", "values (1), (2)", "table numbers",
    "select id, count(*) from numbers group by id having count(*) > 1", "select 1 union select 2",
    "select 'delete from x' as text", "select 'a\nInsert b'", "show functions", "select 1 as `update`",
    "select * from numbers where id in (select max(id) from numbers)",
])
def test_reads(spark, numbers, sql):
    assert querying.guard_sql(spark, sql).reads


@pytest.mark.parametrize("sql", [
    "delete from numbers where id is null", "insert into t values (1)", "update t set a = 1", "drop table t",
    "create table t as select 1", "truncate table t", "alter table t add column x int",
    "with a as (select 1 x) insert into t select * from a", "from numbers insert into t select *",
    "merge into t using numbers s on t.id = s.id when matched then delete", "set x=1", "cache table numbers",
    "create or replace temp view v as select 1", "select 1; drop table t", "selec 1", "",
    "refresh table numbers", "select java_method('java.lang.System', 'nanoTime')", "select reflect('a', 'b')",
    "select * from numbers where id > (select try_reflect('a', 'b'))", "with a as (select java_method('a', 'b') x) select * from a",
    "select * from (select upper(java_method('a', 'b')) from numbers)",
])
def test_refusals(spark, numbers, sql):
    assert not querying.guard_sql(spark, sql).reads


def test_statement_column(spark):
    texts = {
        "SELECT * FROM t": True, " (select 1)": True, "-- note\nselect 1": True, "select 'drop table t'": True,
        "DELETE FROM t": False, "select 1; drop table t": False, "with a as (select 1) insert into t select * from a": False,
        "/* select */ drop table t": False, None: False, "": False, "select update from t": True, "select delete, `drop table` from t": True,
        "select java_method('a', 'b')": False, "select reflect ('a', 'b')": False, "from t insert into u select 1": False,
        "create or replace temp view v as select 1": False, "with a as (select 1) update t set x = 1": False,
    }
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    assert {r["sql"]: r["is_read"] for r in querying.guard_statements(df, "sql").collect()} == texts


def test_run_sql(spark, numbers):
    answer = querying.run_sql(spark, "select id from numbers order by id desc")
    assert (answer.rows.count(), answer.error, answer.rows.first()[0]) == (120, None, 119)
    assert querying.run_sql(spark, "select id from numbers where id < 3").rows.count() == 3


def test_run_sql_errors(spark, numbers):
    assert "no_such_table" in querying.run_sql(spark, "select * from no_such_table").error
    assert querying.run_sql(spark, "selec 1").error
    assert "id2" in querying.run_sql(spark, "select id2 from numbers").error
    assert "java_method" in querying.run_sql(spark, "select java_method('java.lang.System', 'nanoTime')").error
    refused = querying.run_sql(spark, "create or replace temp view made_up as select 1")
    assert "confirm" in refused.error and not spark.catalog.tableExists("made_up")
    assert querying.run_sql(spark, "create or replace temp view made_up as select 1", confirm=True).error is None
    assert spark.catalog.tableExists("made_up")


def test_filters(spark):
    df = spark.createDataFrame([("2019-20", "50%"), ("2021-22", "500"), (None, None)], "season string, note string")
    assert querying.fiscal_after(df, "season", 2020).count() == 1
    assert querying.where_like(df, "note", "0%").count() == 1
    assert querying.where_null(df, "note").count() == 1
    assert querying.numeric_stats(df).count() == 0


def test_no_limit_unless_asked_for(spark):
    assert querying.where_above(spark.range(200), "id", 9).count() == 190
    assert querying.where_above(spark.range(200), "id", 9, limit=50).count() == 50
    assert querying.top_n(spark.range(200)).count() == 10
