"""Queries over sources: files by format, workbooks, JDBC, typed ingest, the registry."""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import scratch_dir
from ..operators.tables import read_table
from ..sources import jdbc, registry
from ..sources.files import load_file, read_csv, read_json, read_parquet
from ..sources.ingest import ingest_typed
from ..sources.ranges import read_csv_ranges, read_json_ranges
from ..sources.workbooks import parse_workbooks
from ..streaming.arrivals import BATCH, load_new_files
from . import jobs
from .contract import query
from .inputs import DIRTY_ORDERS, ACCOUNTS, REGISTRY, table
from .storing import new_namespace

# Tasks get the functions of this module with their code, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CUSTOMER = "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"
# Inferred types: these whole numbers are read as int.
_CUSTOMER_INFERRED = (
    "select cast(c_custkey as integer) as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"
)


def _json_documents(df: DataFrame, path: str) -> None:
    """Write records as JSON arrays, one document per file; each Arrow batch makes one."""
    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": ["[" + ",".join(batch["record"]) + "]"]})

    records = df.select(F.to_json(F.struct(*df.columns)).alias("record"))
    records.mapInPandas(arrays, "value string").write.option("maxRecordsPerFile", 1).text(path)


@query("scan_csv", _CUSTOMER_INFERRED)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark) + "/customer.csv"
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path)


@query("scan_json", _CUSTOMER)
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark) + "/customer.json"
    customer = table(spark, sf_dir, "customer")
    _json_documents(customer, path)
    return read_json(spark, path).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in customer.schema.fields])


@query("scan_parquet", _CUSTOMER)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("load_by_extension", " union all ".join(
    f"select '{e}' as format, c_custkey, c_name, c_acctbal from customer" for e in ("csv", "json", "parquet")))
def load_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    customer.write.option("header", True).csv(f"{root}/customer.CSV")
    customer.write.parquet(f"{root}/customer.parquet")
    _json_documents(customer, f"{root}/customer.json")
    loaded = None
    for name in ("csv", "json", "parquet"):
        file = f"{root}/customer.{'CSV' if name == 'csv' else name}"
        rows = load_file(spark, file).select(
            F.lit(name).alias("format"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_acctbal")
        loaded = rows if loaded is None else loaded.union(rows)
    return loaded


#: Bytes of a range in the queries, small enough that small tables have many.
RANGE_BYTES = 1 << 16


@query("scan_csv_ranges", "select doc_id, text, lang from documents")
def scan_csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their line breaks, commas and quotes, from files that are read in ranges."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/documents.csv")
    return read_csv_ranges(spark, f"{path}/documents.csv", docs.schema, RANGE_BYTES, escape='"')


@query("scan_json_ranges", "select doc_id, text, lang from documents")
def scan_json_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from JSON arrays of many records."""
    path = scratch_dir(spark) + "/documents.json"
    _json_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return read_json_ranges(spark, path, split_bytes=RANGE_BYTES).select("doc_id", "text", "lang")


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(frame: pd.DataFrame) -> bytes:
    """A small workbook with a header row and one sheet; text cells are inline."""
    def cell(value) -> str:
        if value is None or value != value:
            return "<c/>"
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    rows = [list(frame.columns)] + frame.astype(object).values.tolist()
    sheet = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'
                           '<sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" '
                                      f'Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _workbooks(df: DataFrame) -> DataFrame:
    """Workbooks as ``(name, content)``; each Arrow batch makes one."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            yield pd.DataFrame({"name": [f"part-{part:06d}-{i:06d}.xlsx"], "content": [workbook_bytes(batch)]})

    return df.mapInPandas(build, "name string, content binary")


@query("scan_xlsx", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def scan_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return parse_workbooks(_workbooks(supplier), supplier.schema)


# --- JDBC -----------------------------------------------------------------
# The database is Derby inside the session's own process: no server, no port.
# Tasks in other processes cannot see it, so these queries need a local session.

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
_TEXT_COLUMNS = ", ".join(f"{c} VARCHAR(64)" for c in ("c_name", "c_mktsegment", "area", "tier", "season"))
_NEW_ROW = {
    "c_custkey": "-1", "c_name": "'one more'", "c_nationkey": "7", "c_mktsegment": "'MACHINERY'",
    "balance": "cast(12.34 as decimal(10,2))", "area": "'south'", "tier": "'gold'", "visits": "2", "season": "'2021-22'",
}
_NEW_ROW_SQL = "select " + ", ".join(f"{v} as {k}" for k, v in _NEW_ROW.items())
_DERBY_ROW_SQL = "select " + ", ".join(f'{v} as "{k}"' for k, v in _NEW_ROW.items()) + " from sysibm.sysdummy1"


def _database(spark: SparkSession, sf_dir: str, name: str = "accounts") -> str:
    """A fresh in-process database that holds the accounts; its URL."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")  # no derby.log
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    jdbc.append_jdbc(ACCOUNTS.frame(spark, sf_dir), url, name, {**DERBY, "createTableColumnTypes": _TEXT_COLUMNS})
    return url


@query("jdbc_scan", ACCOUNTS.sql())
def jdbc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jdbc.read_jdbc(spark, _database(spark, sf_dir), "accounts", DERBY, partition=('"c_custkey"', 4))


@query("jdbc_scan_even", f"select p.*, true as even from ({ACCOUNTS.sql()}) p")
def jdbc_scan_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of few values, cut within a value by the key; whether no range has over twice the rows of another."""
    read = jdbc.read_jdbc_even(spark, _database(spark, sf_dir), "accounts", '"visits"', 6, DERBY, '"c_custkey"')
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    return read.withColumn("even", F.lit(len(sizes) >= 5 and max(sizes) <= 2 * min(sizes)))


@query("jdbc_literal_row", f"{ACCOUNTS.sql()} union all {_NEW_ROW_SQL}")
def jdbc_literal_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark, sf_dir)
    literal = jdbc.read_jdbc_query(spark, url, _DERBY_ROW_SQL, DERBY)
    return jdbc.read_jdbc(spark, url, "accounts", DERBY).union(literal)


@query("jdbc_append", f"{ACCOUNTS.sql()} union all {ACCOUNTS.sql()}")
def jdbc_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark, sf_dir)
    jdbc.append_jdbc(ACCOUNTS.frame(spark, sf_dir), url, "accounts", DERBY)
    return jdbc.read_jdbc(spark, url, "accounts", DERBY, partition=('"c_custkey"', 4))


@query("jdbc_append_once", f"""
    with n as (select count(*) as arrived from customer)
    select p.*, arrived from ({ACCOUNTS.sql()} union all {ACCOUNTS.sql()}) p, n""")
def jdbc_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is repeated after it arrived adds nothing."""
    url, accounts = _database(spark, sf_dir), ACCOUNTS.frame(spark, sf_dir)
    props = {**DERBY, "createTableColumnTypes": _TEXT_COLUMNS}
    arrived = [jdbc.append_jdbc_once(accounts, url, "accounts", props, "first") for _ in range(2)]
    stored = jdbc.read_jdbc(spark, url, "accounts", DERBY, partition=('"c_custkey"', 4))
    return stored.withColumn("arrived", F.lit(sum(arrived)).cast("bigint"))


@query("jdbc_insert_check", f"""
    with n as (select count(*) as rows_before from customer), added as ({_NEW_ROW_SQL})
    select added.*, rows_before, rows_before + 1 as rows_after from added, n""")
def jdbc_insert_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs.insert_and_check(
        spark, _database(spark, sf_dir), "accounts", _DERBY_ROW_SQL, F.col("c_custkey") == -1, DERBY)
    return done.found.withColumns({
        "rows_before": F.lit(done.before).cast("bigint"), "rows_after": F.lit(done.after).cast("bigint")})


@query("jdbc_list_tables", """
    select 'APP' as db, 'accounts,squad' as tables, count(*) as rows_listed from customer""")
def jdbc_list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _database(spark, sf_dir)
    accounts = ACCOUNTS.frame(spark, sf_dir)
    jdbc.append_jdbc(accounts, url, "squad", {**DERBY, "createTableColumnTypes": _TEXT_COLUMNS})
    found = jdbc.find_table(spark, url, "SQUAD", DERBY).select("db", "rows")
    return (
        jdbc.list_tables(spark, url, DERBY)
        .withColumn("tables", F.lower(F.array_join("tables", ",")))
        .join(found, "db").select("db", "tables", F.col("rows").alias("rows_listed"))
    )


@query("jdbc_find_table", f"""
    select 'APP' as db, 'accounts' as "table", count(*) as "rows", '{",".join(_NEW_ROW)}' as "columns" from customer""")
def jdbc_find_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jdbc.find_table(spark, _database(spark, sf_dir), "Accounts", DERBY)
    return found.select("db", F.lower("table").alias("table"), "rows", F.array_join("columns", ",").alias("columns"))


@query("load_jdbc", ACCOUNTS.sql())
def load_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{new_namespace(spark)}.accounts"
    loaded = jobs.load_jdbc(spark, _database(spark, sf_dir), "accounts", target, DERBY, ('"c_custkey"', 4))
    return read_table(spark, loaded.table)


@query("load_file_table", f"""
    select * replace (cast(c_custkey as bigint) as c_custkey, cast(c_nationkey as bigint) as c_nationkey,
      cast(visits as bigint) as visits, cast(balance as double) as balance), concat(c_name, ', "new"', chr(10), tier) as note
    from ({ACCOUNTS.sql()}) p""")
def load_file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields hold commas, doubled quotes and line breaks."""
    root = scratch_dir(spark)
    note = F.concat("c_name", F.lit(', "new"\n'), "tier")
    accounts = ACCOUNTS.frame(spark, sf_dir).withColumn("note", note)
    accounts.write.option("header", True).option("escape", '"').csv(f"{root}/accounts.csv")
    return read_table(spark, jobs.load_file_table(spark, f"{root}/accounts.csv", f"{new_namespace(spark)}.accounts").table)


@query("load_new_files", f"""
    select p.*, (select count(*) from customer where c_custkey % 3 <> 1) as first_rows,
      (select count(*) from customer where c_custkey % 3 = 1) as second_rows, cast(0 as bigint) as third_rows
    from ({ACCOUNTS.sql()}) p""")
def load_growing_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive between the first run and the second; the third finds none."""
    root, target = scratch_dir(spark), f"{new_namespace(spark)}.accounts"
    accounts, counts = ACCOUNTS.frame(spark, sf_dir), []
    for arriving in ("tier <> 'gold'", "tier = 'gold'", "false"):
        if arriving != "false":
            accounts.filter(arriving).write.mode("append").parquet(f"{root}/in")
        counts.append(load_new_files(spark, f"{root}/in", target, f"{root}/taken", accounts.schema, "parquet").rows)
    named = zip(("first_rows", "second_rows", "third_rows"), counts)
    return read_table(spark, target).drop(BATCH).withColumns({n: F.lit(c).cast("bigint") for n, c in named})


@query("ingest_typed", f"""
    select o_orderkey, o_custkey, coalesce(price, 0.0) as price,
      nullif(prio, '') as prio, nullif(code, '') as code, cast(odate as varchar) as odate
    from ({DIRTY_ORDERS.sql()}) d""")
def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_typed(DIRTY_ORDERS.frame(spark, sf_dir))


# --- registry -------------------------------------------------------------

_REGISTRY_COLUMNS = "dag_id string, seq bigint, source string, row_count bigint, created_at string"


@query("registry_read", REGISTRY.sql())
def registry_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark) + "/registry.json"
    _json_documents(REGISTRY.frame(spark, sf_dir), path)
    absent = registry.read_registry(spark, path + ".absent", _REGISTRY_COLUMNS)
    return registry.read_registry(spark, path, _REGISTRY_COLUMNS).union(absent)


@query("registry_upsert", f"""
    with r as ({REGISTRY.sql()})
    select dag_id, seq, source, row_count, created_at, place from (
      select *, min(seq) over (partition by dag_id) as place,
        row_number() over (partition by dag_id order by (source = 'O') desc, seq desc) as newest from r)
    where newest = 1""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = REGISTRY.frame(spark, sf_dir)
    return registry.upsert(records.filter("source <> 'O'"), records.filter("source = 'O'"), "dag_id", "seq")


@query("registry_list", f"""
    select dag_id, seq, source, format('{{:,}}', row_count) || ' rows' as row_count,
      created_at || ':00' as created_at from ({REGISTRY.sql()}) r""")
def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = registry.list_registry(REGISTRY.frame(spark, sf_dir), order_by="seq")
    return listed.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
