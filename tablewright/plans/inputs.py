"""Inputs derived from the driver's tables: dirt, run lists, log lines, requests.

The expressions are portable SQL: Spark evaluates them over the tables, and the
same text serves as a common table expression for the oracle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Derived:
    """Projections of one table, stacked: ``(expressions, condition or None)`` each."""

    table: str
    parts: tuple[tuple[tuple[str, ...], str | None], ...]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir, self.table)
        stacked = None
        for expressions, condition in self.parts:
            rows = base.filter(condition) if condition else base
            rows = rows.selectExpr(*expressions)
            stacked = rows if stacked is None else stacked.union(rows)
        return stacked

    def sql(self) -> str:
        return " union all ".join(
            f"select {', '.join(expressions)} from {self.table}" + (f" where {condition}" if condition else "")
            for expressions, condition in self.parts
        )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DIRTY = (
    "o_orderkey", "o_custkey",
    "case when o_orderkey % 7 = 0 then null else o_totalprice end as price",
    "case when o_orderkey % 11 = 0 then '  ' when o_orderkey % 5 = 0 then concat(' ', o_orderpriority, ' ') "
    "else o_orderpriority end as prio",
    "case when o_orderkey % 20 = 0 then 'n/a' else cast(o_custkey as varchar(20)) end as code",
    "case when o_orderkey % 10 < 8 then null else o_orderdate end as odate",
)

#: Nulls, blanks, padded text, numbers as text, exact copies.
DIRTY_ORDERS = Derived("orders", ((_DIRTY, None), (_DIRTY, "o_orderkey % 13 = 0")))

#: The same with rows in which every column is null.
DIRTY_WITH_EMPTY = Derived("orders", DIRTY_ORDERS.parts + ((
    ("cast(null as bigint) as o_orderkey", "cast(null as bigint) as o_custkey", "cast(null as double) as price",
     "cast(null as varchar(20)) as prio", "cast(null as varchar(20)) as code", "cast(null as timestamp) as odate"),
    "o_orderstatus = 'P'"),))

_RUN_STATE = (
    "case when event_id % 7 = 3 then 'scheduled' when event_id % 5 = 0 then 'failed' when event_id % 5 = 1 then 'running' "
    "when event_id % 5 = 2 then 'queued' when event_id % 5 = 3 then 'up_for_retry' else 'success' end"
)
_DAY = "lpad(cast(1 + event_id % 28 as varchar(2)), 2, '0')"

#: Text run lists: job, run, state and three dates between bars.
RUN_LINES = Derived("events", ((("event_id",
    "concat('dag_', cast(user_id as varchar(20)), ' | manual__', lpad(cast(event_id as varchar(20)), 8, '0'), "
    f"' | ', {_RUN_STATE}, ' | 2024-01-', {_DAY}, ' | 2024-02-', {_DAY}, ' | 2024-03-', {_DAY}) as line"), None),))
RUN_HEADER = ["dag_id", "run_id", "state", "execution_date", "start_date", "end_date"]

_MESSAGE = (
    "case when event_id % 8 = 0 then 'psycopg2.OperationalError: Connection Refused' "
    "when event_id % 8 = 1 then 'Error: pg_config executable not found.' "
    "when event_id % 8 = 2 then 'sqlalchemy UndefinedTable: relation \"job\" does not exist' "
    "when event_id % 8 = 3 then 'OSError: [Errno 98] Address already in use' "
    "when event_id % 8 = 4 then 'InsufficientPrivilege: permission denied for schema public' "
    "else concat('ok ', event_type) end"
)

#: Log lines for the rule matcher.
ERROR_LINES = Derived("events", ((("event_id", f"{_MESSAGE} as message"), None),))

#: Error output of several lines, noise included.
ERROR_TEXTS = Derived("events", ((("event_id",
    f"concat('INFO start ', event_type, chr(10), case when event_id % 8 = 7 then 'INFO idle' else {_MESSAGE} end, "
    "chr(10), 'Warning: ', props, chr(10), '  ', chr(10), 'graphviz missing', chr(10)) as output"), None),))

_REQUEST = (
    "case when event_id % 8 = 0 then concat('show value above ', cast(event_id % 100 as varchar(20))) "
    "when event_id % 8 = 1 then 'Year greater than 2020' "
    "when event_id % 8 = 2 then 'show snapshot history' "
    "when event_id % 8 = 3 then 'How many rows in total' "
    "when event_id % 8 = 4 then 'describe the columns' "
    "when event_id % 8 = 5 then concat('top ', cast(1 + event_id % 30 as varchar(20))) "
    "when event_id % 8 = 6 then 'count null values per column' "
    "else 'hello' end as request"
)

_REPLY = (
    "case when event_id % 4 = 0 then concat('{\"sql\":\"SELECT * FROM events LIMIT ', "
    "cast(event_id % 50 as varchar(20)), '\",\"explanation\":\"first rows\",\"is_destructive\":false,\"warning\":\"\"}') "
    "when event_id % 4 = 1 then concat('Sure! ```json', chr(10), "
    "'{\"sql\":\"DELETE FROM events WHERE value IS NULL\",\"explanation\":\"drop nulls\","
    "\"is_destructive\":', case when event_id % 16 = 1 then 'true' when event_id % 16 = 5 then '\"true\"' "
    "when event_id % 16 = 9 then '1' else 'false' end, ',\"warning\":\"These rows cannot be brought back\"}', chr(10), '``` done') "
    "when event_id % 4 = 2 then 'I cannot answer that.' "
    "else '{\"explanation\":\"no sql key\"}' end as reply"
)

#: Plain-language requests, replies with and without valid JSON, and both.
REQUESTS = Derived("events", ((("event_id", _REQUEST), None),))
REPLIES = Derived("events", ((("event_id", _REPLY), None),))
DIALOGUES = Derived("events", ((("event_id", _REQUEST, _REPLY), None),))

#: Customers with a decimal balance, a tier, visits and a fiscal season.
ACCOUNTS = Derived("customer", ((
    ("cast(c_custkey as int) as c_custkey", "c_name", "cast(c_nationkey as int) as c_nationkey", "c_mktsegment",
     "cast(c_acctbal as decimal(10,2)) as balance",
     "case when c_nationkey % 3 = 0 then 'north' when c_nationkey % 3 = 1 then 'south' else 'east' end as area",
     "case when c_custkey % 3 = 0 then 'basic' when c_custkey % 3 = 1 then 'gold' else 'silver' end as tier",
     "cast(c_custkey % 31 as int) as visits",
     "case when c_custkey % 3 = 0 then '2019-20' when c_custkey % 3 = 1 then '2020-21' else '2021-22' end as season",
     ), None),))

#: Registry records with repeated keys.
REGISTRY = Derived("orders", ((
    ("concat('dag_', cast(o_custkey as varchar(20))) as dag_id", "o_orderkey as seq",
     "o_orderstatus as source", "cast(floor(o_totalprice) as bigint) as row_count",
     "concat('2024-01-', lpad(cast(1 + o_orderkey % 28 as varchar(2)), 2, '0'), ' 10:30') as created_at"), None),))

# Rules for the lines above, in order (pattern, fix, message).
ERROR_RULES = [
    ("pg_config executable", "add_client_headers", "The database client's headers are not there"),
    ("could not translate host name", "check_host", "The host has no address"),
    ("Connection Refused", "start_server", "Nothing listens at the address"),
    ("password authentication failed", "check_password", "The server refuses the password"),
    ("address already in use", "free_port", "Another process has the port"),
    ("permission denied for schema", "grant_schema", "The user may not use the schema"),
    ("insufficientprivilege", "grant_rights", "The user lacks a right"),
    ("UndefinedTable", "create_tables", "The tables have not been made"),
    ('relation "job"', "upgrade_tables", "The job table is missing"),
    ("no space left on device", "free_disk", "The disk is full"),
]

#: Messages that name a part and another with the same words, and rules for the names: one name may begin another.
PART_LINES = Derived("part", ((
    ("p_partkey", "concat('Lot ', cast(p_partkey as varchar(20)), ': ', p_name, ' ', p_brand, ' beside ', p_name, ' Brand#', "
     "cast(1 + p_partkey % 40 as varchar(20)), '.') as message"), None),))
PART_RULES = Derived("part", ((("concat(upper(p_name), ' ', p_brand) as pattern", "p_type", "p_size"), "p_partkey % 5 > 0"),))
