"""Requests, replies, logs and run lists on hand-made rows."""

import json

import pytest
from pyspark.sql import types as T

from tablewright.functions import text
from tablewright.operators import textjobs


COLUMNS = T.StructType([T.StructField("id", T.LongType()), T.StructField("a`b", T.StringType())])


def route(spark, request, compat):
    df = spark.createDataFrame([(request,)], "request string")
    return textjobs.route_requests(df, "request", "c.d.t", compat=compat, columns=COLUMNS).first()


@pytest.mark.parametrize("request_text, intent, sql", [
    ("salary above 100", "where_above", "SELECT * FROM c.d.t WHERE salary > 100 LIMIT 50"),
    ("fiscal_year > 2019", "fiscal_after", "SELECT * FROM c.d.t WHERE SUBSTR(year,1,4) > '2019' LIMIT 50"),
    ("which country", "row_count", "SELECT COUNT(*) as total_rows FROM c.d.t"),
    ("count null values per column", "row_count", "SELECT COUNT(*) as total_rows FROM c.d.t"),
    ("show all columns and types", "describe", "DESCRIBE TABLE c.d.t"),
    ("the history", "snapshots",
     "SELECT snapshot_id,committed_at,operation FROM c.d.t.snapshots ORDER BY committed_at DESC"),
    ("show 25 rows or 30", "top_n", "SELECT * FROM c.d.t LIMIT 25"),
    ("hello", "top_n", "SELECT * FROM c.d.t LIMIT 10"),
    ("größe above 5", "where_above", "SELECT * FROM c.d.t WHERE größe > 5 LIMIT 50"),
])
def test_routes(spark, request_text, intent, sql):
    row = route(spark, request_text, compat=True)
    assert (row["intent"], row["sql"]) == (intent, sql)


@pytest.mark.parametrize("request_text, intent", [
    ("which country", "top_n"), ("count null values per column", "null_check"),
    ("show min max avg for numeric columns", "numeric_stats"), ("count rows", "row_count"),
    ("show snapshots", "snapshots")])
def test_strict_routes(spark, request_text, intent):
    assert route(spark, request_text, compat=False)["intent"] == intent


def test_strict_routes_have_sql_without_limits(spark):
    assert route(spark, "salary above 100", False)["sql"] == "SELECT * FROM c.d.t WHERE salary > 100"
    assert route(spark, "count null values", False)["sql"] == (
        "SELECT COUNT(*) - COUNT(`id`) AS `id`, COUNT(*) - COUNT(`a``b`) AS `a``b` FROM c.d.t")
    stats = route(spark, "statistics", False)
    assert stats["sql"] == "SELECT MIN(`id`) AS `min_id`, MAX(`id`) AS `max_id`, AVG(`id`) AS `avg_id` FROM c.d.t" and stats["explanation"]
    with pytest.raises(ValueError, match="columns of the table"):
        textjobs.route_requests(spark.createDataFrame([("x",)], "request string"), "request", "t")


@pytest.mark.parametrize("name", ["value", "SQL", "intent"])
def test_columns_of_the_user_are_not_overwritten(spark, name):
    df = spark.createDataFrame([("top 5", "{}", 99.5)], f"request string, reply string, `{name}` double")
    with pytest.raises(ValueError, match=name.lower()):
        textjobs.route_requests(df, "request", "t", compat=True)
    with pytest.raises(ValueError, match=name.lower()):
        textjobs.resolve_requests(df, "request", "reply", "t", "c.t")


def test_strict_route_filters_the_named_column(spark):
    assert "SUBSTR(fiscal_year,1,4)" in route(spark, "fiscal_year > 2019", compat=False)["sql"]


@pytest.mark.parametrize("reply, sql, destructive", [
    ('{"sql": "select 1", "is_destructive": true}', "select 1", True),
    ('```json\n{"sql": "select 1"}\n```', "select 1", False),
    *[(f'{{"sql": "select 1", "is_destructive": {flag}}}', "select 1", True) for flag in ('"true"', "1", '"yes"', "0.5", "[1]", '{"a": 1}', '"false"')],
    *[(f'{{"sql": "select 1", "is_destructive": {flag}}}', "select 1", False) for flag in ("false", "0", "0.0", '""', "null", "[]", "{}")],
    ('{"sql": "DELETE FROM t", "is_destructive": false}', "DELETE FROM t", True), ('{"sql": "drop table t"}', "drop table t", True),
    ('{"is_destructive": true}', None, True),
    ('Here: {"sql": "select {x}"} bye', "select {x}", False),
    ('{"sql": null}', None, False), ('["sql"]', None, False), ('[{"sql": "select 1"}]', None, False),
    ('"{\\"sql\\": 1}"', None, False), ('[note] {"sql": "select 1"}', "select 1", False), ("{broken", None, False), ("", None, False),
    (None, None, False),
])
def test_replies(spark, reply, sql, destructive):
    row = textjobs.parse_replies(spark.createDataFrame([(reply,)], "reply string"), "reply").first()
    assert (row["sql"], row["is_destructive"], row["is_valid"]) == (sql, destructive, sql is not None)


@pytest.mark.parametrize("sql, qualified", [
    ("select * from t", "select * from c.d$1.t"), ("select * from c.d$1.t", "select * from c.d$1.t"),
    ("select * from my_t", "select * from my_t"), (None, None)])
def test_qualify(spark, sql, qualified):
    df = spark.createDataFrame([(sql,)], "sql string")
    assert textjobs.qualify_sql(df, "sql", "t", "c.d$1.t").first()[0] == qualified


def test_last_turns(spark):
    df = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(12)] + [(2, 0, "user", "x")],
                               "conv int, turn int, role string, text string")
    found = {r["conv"]: [t["text"] for t in r["context"]] for r in textjobs.last_turns(df, "conv", "turn").collect()}
    assert found == {1: [f"m{i}" for i in range(4, 12)], 2: ["x"]}  # four requests, four answers


def test_first_rule_wins_over_many_blocks(spark):
    rules = [(f"pattern {i:04d}", f"fix{i}", "") for i in range(250)] + [("PATTERN", "last", "note")]
    df = spark.createDataFrame([("a Pattern 0199 and pattern 0042",), ("pattern x",), ("other",), (None,)], "m string")
    found = [r["fix"] for r in textjobs.match_rules(df, "m", rules).collect()]
    assert found == ["fix42", "last", None, None]
    assert textjobs.match_rules(df, "m", []).first()["fix"] is None


def test_rules_keep_file_order(spark, tmp_path):
    rules = {f"p{i}": {"fix": f"f{9 - i}", "message": f"m{i}"} for i in (3, 1, 2, 0)}
    (tmp_path / "rules.json").write_text(json.dumps(rules, indent=2))
    read = textjobs.read_rules(spark, str(tmp_path / "rules.json"))
    assert [r[0] for r in read] == ["p3", "p1", "p2", "p0"] and read[0] == ("p3", "f6", "m3")


def test_requests_without_a_valid_reply_are_routed(spark):
    df = spark.createDataFrame([("top 5", '{"sql": "select * from t", "warning": "w"}'), ("top 5", "no idea")],
                               "request string, reply string")
    found = [(r["sql"], r["explanation"], r["warning"], r["is_valid"])
             for r in textjobs.resolve_requests(df, "request", "reply", "t", "c.d.t").collect()]
    assert found == [("select * from c.d.t", "", "w", True),
                     ("SELECT * FROM c.d.t LIMIT 5", "Show top 5 rows", "", False)]


def test_run_status(spark):
    lines = [
        (1, "job_a | run1 | success | e1 | s1 | x1"), (2, "job_a | run2 | FAILED | e2 | s2 | x2"),
        (3, " | job_b |  | run9 | nothing known | "), (4, "   "), (5, None), (6, "job_c | up_for_retry"),
        (7, "job_d | run | queued then running | e"),
        (8, "job_e | run1 | success | e1 | s1"), (9, "job_e | run2 | scheduled | e2 | s2"),
        (10, "job_f | run1 | queued | a"), (10, "job_f | run2 | running | b"),
    ]
    df = spark.createDataFrame(lines, "n int, line string")
    found = {r["job"]: tuple(r)[1:] for r in textjobs.run_status(df, "line", "n").collect()}
    assert found == {
        "job_a": ("failed", "run2", "e2", "s2"), "job_b": ("unknown", "", "", ""),
        "job_c": ("up_for_retry", "up_for_retry", "", ""), "job_d": ("running", "run", "e", ""),
        "job_e": ("success", "run1", "e1", "s1"), "job_f": ("running", "run2", "b", "")}
    header = ["dag_id", "run_id", "state", "execution_date", "start_date", "end_date"]
    named = {r["job"]: tuple(r)[3:] for r in textjobs.run_status(df, "line", "n", header).collect()}
    assert named["job_a"] == ("s2", "x2")


def test_error_tail_and_last_error(spark):
    long = "x" * 5000 + '"end"'
    df = spark.createDataFrame([(long,), ("a\n  real \nWarning: w\nINFO i\n \t\ngraphviz",), ("INFO only",), (None,)],
                               "t string")
    tails = [r["tail"] for r in textjobs.error_tail(df, "t").collect()]
    assert tails[0] == "x" * 3995 + '\\"end\\"' and tails[3] is None
    assert [r["last_error"] for r in textjobs.last_error(df, "t").collect()] == [
        long, "real", text.NO_ERROR_LINE, text.NO_ERROR_LINE]
