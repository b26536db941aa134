"""Queries over stored tables: every kind of write, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_identifier, clean_path
from ..operators import tables
from ..operators.profiling import profile_nulls
from ..operators.querying import count_by
from ..operators.staging import scratch_dir
from ..operators.textjobs import schema_text
from .contract import query
from .inputs import DIRTY_ORDERS, ACCOUNTS, table

SEASON = ["season"]

ACCOUNT_TYPES = [
    ("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"),
    ("balance", "decimal(10,2)"), ("area", "string"), ("tier", "string"), ("visits", "int"), ("season", "string"),
]


def new_namespace(spark: SparkSession) -> str:
    """A namespace of the session catalog, in a folder of its own."""
    name = f"n_{uuid.uuid4().hex}"
    tables.ensure_namespace(spark, name, scratch_dir(spark))
    return name


def _new_table(spark: SparkSession, name: str = "accounts") -> str:
    return f"{new_namespace(spark)}.{name}"


def _with_more_visits(accounts: DataFrame) -> DataFrame:
    return accounts.withColumn("visits", (F.col("visits") + 100).cast("int"))


@query("table_read", ACCOUNTS.sql())
def table_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_table(spark)
    tables.create_or_replace(ACCOUNTS.frame(spark, sf_dir), target, SEASON)
    return tables.read_table(spark, target)


@query("table_create", ACCOUNTS.sql())
def table_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    for _ in range(2):  # the second call finds the table and leaves it alone
        tables.create_table(spark, target, accounts.schema, SEASON)
    tables.append(accounts, target)
    return tables.read_table(spark, target)


@query("table_replace", f"select c_custkey, visits, season from ({ACCOUNTS.sql()}) p")
def table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts, target, SEASON)
    tables.create_or_replace(tables.read_table(spark, target).select("c_custkey", "visits", "season"), target)
    return tables.read_table(spark, target)


@query("table_overwrite_partitions", f"""
    select * replace (cast(case when season = '2020-21' then visits + 100 else visits end as integer) as visits)
    from ({ACCOUNTS.sql()}) p""")
def table_overwrite_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts, target, SEASON)
    tables.overwrite_partitions(_with_more_visits(accounts.filter("season = '2020-21'")), target)
    return tables.read_table(spark, target)


@query("table_ctas", f"""
    select p.*, (select count(distinct season) from ({ACCOUNTS.sql()}) q) as partitions
    from ({ACCOUNTS.sql()}) p""")
def table_ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts.limit(0), target)
    tables.replace_ctas(accounts, target, "season")
    stored = tables.read_table(spark, target)
    partitions = spark.sql(f"SHOW PARTITIONS {target}").count()
    return stored.withColumn("partitions", F.lit(partitions).cast("bigint"))


@query("table_append", ACCOUNTS.sql())
def table_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts.filter("season = '2019-20'"), target, SEASON)
    tables.append(accounts.filter("season = '2020-21'"), target)
    tables.append(accounts.filter("season = '2021-22'"), target)
    return tables.read_table(spark, target)


@query("table_merge", f"""
    select * replace (cast(case when tier = 'gold' then visits + 100 else visits end as integer) as visits)
    from ({ACCOUNTS.sql()}) p""")
def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts.filter("tier <> 'basic'"), target, SEASON)
    changed = _with_more_visits(accounts.filter("tier = 'gold'"))
    tables.merge(changed.unionByName(accounts.filter("tier = 'basic'")), target, "c_custkey")
    return tables.read_table(spark, target)


@query("table_merge_bucketed", f"""
    select * replace (cast(case when tier = 'gold' then visits + 200 when tier = 'basic' then visits + 100 else visits end as integer) as visits)
    from ({ACCOUNTS.sql()}) p""")
def table_merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges; neither shuffles the table."""
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_bucketed(accounts.filter("tier <> 'basic'"), target, "c_custkey", 8)
    tables.merge_bucketed(_with_more_visits(accounts.filter("tier <> 'silver'")), target, "c_custkey")
    tables.merge_bucketed(_with_more_visits(_with_more_visits(accounts.filter("tier = 'gold'"))), target, "c_custkey")
    return tables.read_table(spark, target)


@query("table_verify", "select count(*) as rows_written, count(*) as rows_stored from customer")
def table_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.create_or_replace(accounts, target, SEASON)
    stored = tables.verify_count(spark, target)
    return accounts.agg(F.count("*").alias("rows_written")).withColumn("rows_stored", F.lit(stored).cast("bigint"))


@query("table_write", f"""
    select p.*, (select 2 * count(*) from customer) as rows_stored
    from ({ACCOUNTS.sql()} union all {ACCOUNTS.sql()}) p""")
def table_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, accounts = _new_table(spark), ACCOUNTS.frame(spark, sf_dir)
    tables.write_table(accounts, target)
    written = tables.write_table(accounts, target, mode="append")
    return tables.read_table(spark, target).withColumn("rows_stored", F.lit(written.rows).cast("bigint"))


@query("staging_write", DIRTY_ORDERS.sql())
def staging_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.write_staging(DIRTY_ORDERS.frame(spark, sf_dir), scratch_dir(spark), "orders")
    return spark.read.parquet(path)


@query("namespace_ensure", f"""
    select season, count(*) as "count" from ({ACCOUNTS.sql()}) p group by season""")
def namespace_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    namespace = new_namespace(spark)
    tables.ensure_namespace(spark, namespace)  # it is there already
    tables.create_or_replace(ACCOUNTS.frame(spark, sf_dir), f"{namespace}.accounts", SEASON)
    listed = spark.catalog.listTables(namespace)
    return count_by(tables.read_table(spark, f"{namespace}.{listed[0].name}"), "season")


@query("refresh", f"""
    select p.*, (select count(*) from customer) as rows_read, (select count(*) from customer) as rows_stored
    from ({ACCOUNTS.sql()}) p""")
def refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_table(spark)
    tables.create_or_replace(ACCOUNTS.frame(spark, sf_dir), target, SEASON)
    done = tables.refresh(spark, target)
    return tables.read_table(spark, target).withColumns({
        "rows_read": F.lit(done.rows_read).cast("bigint"), "rows_stored": F.lit(done.rows_stored).cast("bigint")})


@query("snapshots", """
    select o_custkey as snapshot_id, cast(max(o_orderdate) as timestamp) as committed_at,
      case when o_custkey % 2 = 0 then 'append' else 'overwrite' end as operation, count(*) as added_records
    from orders group by o_custkey order by committed_at desc, snapshot_id desc limit 5""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain top-n: the newest rows of a table that has the columns of a snapshot log. No snapshots are read."""
    log = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("snapshot_id")).agg(
        F.max("o_orderdate").cast("timestamp_ntz").alias("committed_at"),
        F.create_map(F.lit("added-records"), F.count("*").cast("string")).alias("summary"),
    ).withColumn("operation", F.when(F.col("snapshot_id") % 2 == 0, "append").otherwise("overwrite"))
    return tables.newest_snapshots(log, limit=tables.SHOWN_SNAPSHOTS).drop("summary")


@query("delete_where", f"select * from ({DIRTY_ORDERS.sql()}) d where price is not null")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_table(spark, "orders")
    tables.create_or_replace(DIRTY_ORDERS.frame(spark, sf_dir), target)
    tables.delete_where(spark, target, "price is null", confirm=True)
    return tables.read_table(spark, target)


@query("delete_preview", f"select * from ({DIRTY_ORDERS.sql()}) d where price is null")
def delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _new_table(spark, "orders")
    tables.create_or_replace(DIRTY_ORDERS.frame(spark, sf_dir), target)
    return tables.delete_where(spark, target, "price is null")


@query("describe", " union all ".join(
    f"select {i} as position, '{n}' as name, '{t}' as type, count(\"{n}\") as filled from ({ACCOUNTS.sql()}) p"
    for i, (n, t) in enumerate(ACCOUNT_TYPES)))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and types of a stored table, with the values that each column holds."""
    target = _new_table(spark)
    tables.create_or_replace(ACCOUNTS.frame(spark, sf_dir), target, SEASON)
    nulls = profile_nulls(tables.read_table(spark, target))
    rows = tables.verify_count(spark, target)
    return tables.describe(spark, target).join(nulls.select("name", (rows - F.col("nulls")).alias("filled")), "name")


@query("schema_text", "select season, count(*) as rows_of_season, '" + ", ".join(f"{n}({t})" for n, t in ACCOUNT_TYPES) + f"""' as schema_text
    from ({ACCOUNTS.sql()}) p group by season""")
def schema_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema text beside the rows of each partition."""
    target = _new_table(spark)
    tables.create_or_replace(ACCOUNTS.frame(spark, sf_dir), target, SEASON)
    stored = tables.read_table(spark, target)
    seasons = stored.groupBy("season").agg(F.count("*").alias("rows_of_season"))
    return seasons.withColumn("schema_text", F.lit(schema_text(stored).first()[0]))


@query("choose_partition", f"""
    select 'c_mktsegment' as partition_column, c_mktsegment as value, count(*) as "count"
    from ({ACCOUNTS.sql()}) p group by c_mktsegment""")
def choose_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = ACCOUNTS.frame(spark, sf_dir)
    chosen = tables.choose_partition(accounts)
    groups = count_by(accounts, chosen)
    return groups.select(F.lit(chosen).alias("partition_column"), F.col(chosen).alias("value"), "count")


@query("clean_identifier", """
    select p_partkey, replace(replace(lower(trim(concat('  ', p_name, '-', p_brand, ' '))), ' ', '_'), '-', '_') as id,
      replace(concat('lake/', p_type, '/', p_name), ' ', '_') as path
    from part""")
def clean_names_of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey",
        clean_identifier(F.concat(F.lit("  "), "p_name", F.lit("-"), "p_brand", F.lit(" "))).alias("id"),
        clean_path(F.concat(F.lit(" /lake/"), "p_type", F.lit("/"), "p_name", F.lit("/ "))).alias("path"))
