"""Queries over the table questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import querying, textjobs
from .contract import query
from .inputs import DIRTY_ORDERS, ACCOUNTS, REPLIES, table

_P = f"({ACCOUNTS.sql()}) p"
_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax"]


@query("top_n", f"select * from {_P} order by c_custkey limit 10")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.top_n(ACCOUNTS.frame(spark, sf_dir), 10, order_by="c_custkey")


@query("row_count", "select count(*) as total_rows from lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.row_count(table(spark, sf_dir, "lineitem"))


@query("count_by", """
    select l_returnflag, l_linestatus, count(*) as "count" from lineitem group by l_returnflag, l_linestatus""")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.count_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("where_eq", f"select * from {_P} where c_custkey = 42")
def where_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.where_eq(ACCOUNTS.frame(spark, sf_dir), "c_custkey", 42)


@query("where_above", "select * from lineitem where l_quantity > 45")
def where_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.where_above(table(spark, sf_dir, "lineitem"), "l_quantity", 45, limit=None)


@query("where_above_top", "select * from orders where o_totalprice > 300000 order by o_orderkey limit 50")
def where_above_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.where_above(table(spark, sf_dir, "orders"), "o_totalprice", 300000, limit=50, order_by="o_orderkey")


@query("fiscal_after", f"select * from {_P} where substr(season, 1, 4) > '2019'")
def fiscal_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.fiscal_after(ACCOUNTS.frame(spark, sf_dir), "season", 2019, limit=None)


@query("where_like", "select doc_id, lang, n_chars from documents where text like '%the%'")
def where_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return querying.where_like(documents, "text", "the").select("doc_id", "lang", "n_chars")


@query("null_check", f"with d as ({DIRTY_ORDERS.sql()}) " + " union all ".join(
    f"select '{c}' as name, count(*) - count({c}) as nulls from d"
    for c in ("o_orderkey", "o_custkey", "price", "prio", "code", "odate")))
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.null_check(DIRTY_ORDERS.frame(spark, sf_dir))


@query("numeric_stats", " union all ".join(
    f"select '{c}' as name, cast(min({c}) as double) as min, cast(max({c}) as double) as max, "
    f"round(avg({c}), 2) as avg from lineitem" for c in _NUMERIC))
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.numeric_stats(table(spark, sf_dir, "lineitem")).withColumn("avg", F.round("avg", 2))


@query("avg_of", "select round(avg(l_extendedprice), 2) as avg from lineitem")
def avg_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.avg_of(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("avg", F.round("avg", 2))


@query("where_null", f"select * from ({DIRTY_ORDERS.sql()}) d where price is null")
def where_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.where_null(DIRTY_ORDERS.frame(spark, sf_dir), "price")


@query("select_as", f"select c_custkey as id, c_name as name, 'web' as channel, 25 as rank, true as active from {_P}")
def select_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.select_as(ACCOUNTS.frame(spark, sf_dir), {
        "id": F.col("c_custkey"), "name": F.col("c_name"), "channel": "web", "rank": 25, "active": True})


_ANSWERED = "select o_custkey, sum(o_totalprice) as spent, count(*) as orders from {t} group by o_custkey"


@query("run_sql", f"""
    select o_custkey, round(spent, 2) as spent, orders from ({_ANSWERED.format(t="orders")}) a""")
def run_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("asked_orders")
    answer = querying.run_sql(spark, _ANSWERED.format(t="asked_orders"))
    if answer.error is not None:
        raise RuntimeError(answer.error)
    return answer.rows.withColumn("spent", F.round("spent", 2))


@query("where_above_all", "select * from orders where o_totalprice > 300000")
def where_above_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.where_above(table(spark, sf_dir, "orders"), "o_totalprice", 300000)


@query("fiscal_after_all", f"select * from {_P} where substr(season, 1, 4) > '2019'")
def fiscal_after_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querying.fiscal_after(ACCOUNTS.frame(spark, sf_dir), "season", 2019)


@query("guard_plans", f"""
    with r as ({REPLIES.sql()}), j as (
      select case when json_valid(reply) then reply
        when regexp_matches(reply, '(?s)\\{{.*\\}}') then regexp_extract(reply, '(?s)\\{{.*\\}}', 0) end as doc from r),
    s as (select regexp_replace(json_extract_string(doc, '$.sql'), '[0-9]+', '7', 'g') as sql from j)
    select sql, count(*) as replies, sql like 'SELECT%' as is_read from s where sql is not null group by sql""")
def guard_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the replies, their numbers aside, judged where they are."""
    parsed = textjobs.parse_replies(REPLIES.frame(spark, sf_dir), "reply")
    shapes = parsed.where("sql is not null").groupBy(F.regexp_replace("sql", "[0-9]+", "7").alias("sql")).agg(F.count("*").alias("replies"))
    return querying.guard_statements(shapes, "sql")


@query("guard_sql", f"""
    with r as ({REPLIES.sql()}), j as (
      select event_id, case when json_valid(reply) then reply
        when regexp_matches(reply, '(?s)\\{{.*\\}}') then regexp_extract(reply, '(?s)\\{{.*\\}}', 0) end as doc from r)
    select event_id, json_extract_string(doc, '$.sql') as sql,
      coalesce(json_extract_string(doc, '$.sql') like 'SELECT%', false) as is_read from j""")
def guard_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = textjobs.parse_replies(REPLIES.frame(spark, sf_dir), "reply").select("event_id", "sql")
    return querying.guard_statements(parsed, "sql")
