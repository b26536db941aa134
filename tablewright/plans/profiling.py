"""Queries over the profiler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiling, sketches, tables
from ..operators.querying import row_count
from .contract import query
from .inputs import ACCOUNTS, DIRTY_ORDERS, table
from .storing import new_namespace

_DIRTY = {"o_orderkey": "bigint", "o_custkey": "bigint", "price": "double", "prio": "string", "code": "string",
          "odate": "timestamp_ntz"}
_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
           "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_D = f"with d as ({DIRTY_ORDERS.sql()})"
_WIDTH = len(_DIRTY)
_NULLS = " + ".join(f"count(*) - count({c})" for c in _DIRTY)
_DUPLICATES = "(select count(*) from d) - (select count(*) from (select distinct * from d) u)"


def _each(columns: dict[str, str], select: str) -> str:
    """One select per column, stacked; ``{c}`` is the column, ``{i}`` its position."""
    return " union all ".join(select.format(c=c, i=i, t=t) for i, (c, t) in enumerate(columns.items()))


def _samples(column: str, source: str, key: str) -> str:
    return (f"select string_agg(v, '|' order by k, v) from (select {key} as k, cast({column} as varchar) as v "
            f"from {source} where {column} is not null order by k, v limit 3) s")


@query("profile_nulls", f"{_D} " + _each(_DIRTY, """
    select {i} as position, '{c}' as name, count(*) - count({c}) as nulls,
      round((count(*) - count({c})) * 100.0 / count(*), 2) as null_pct from d"""))
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile_nulls(DIRTY_ORDERS.frame(spark, sf_dir))


@query("profile_distinct", f"{_D} " + _each(
    _DIRTY, "select {i} as position, '{c}' as name, count(distinct {c}) as distinct_values from d"))
def profile_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile_distinct(DIRTY_ORDERS.frame(spark, sf_dir))


@query("profile_distinct_approx", f"{_D} " + _each(
    _DIRTY, "select {i} as position, count(distinct {c}) as distinct_values, true as near from d"))
def profile_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates, marked by whether they lie within five standard deviations."""
    dirty = DIRTY_ORDERS.frame(spark, sf_dir)
    estimates = profiling.profile_distinct(dirty, rsd=0.02).withColumnRenamed("distinct_values", "estimate")
    exact = profiling.profile_distinct(dirty).drop("name")
    error = F.abs(F.col("estimate") / F.col("distinct_values") - 1)
    return estimates.join(exact, "position").select("position", "distinct_values", (error < 0.1).alias("near"))


@query("profile_samples", " union all ".join(
    f"select {i} as position, '{c}' as name, ({_samples(c, 'orders', 'o_orderkey')}) as sample"
    for i, c in enumerate(_ORDERS)))
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = profiling.profile_samples(table(spark, sf_dir, "orders"), order_by="o_orderkey")
    return samples.withColumn("sample", F.array_join("sample", "|"))


@query("profile_types", f"{_D} " + _each(
    _DIRTY, "select {i} as position, '{c}' as name, '{t}' as dtype, count({c}) as filled from d"))
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = DIRTY_ORDERS.frame(spark, sf_dir)
    rows = row_count(dirty).first()["total_rows"]
    filled = profiling.profile_nulls(dirty).select("position", (rows - F.col("nulls")).alias("filled"))
    return profiling.profile_types(dirty).join(filled, "position")


@query("profile_null_totals", f"""{_D}
    select {_NULLS} as total_nulls, {" + ".join(f"cast(count({c}) < count(*) as bigint)" for c in _DIRTY)} as null_columns
    from d""")
def profile_null_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.profile_null_totals(DIRTY_ORDERS.frame(spark, sf_dir))


@query("duplicate_rows", f"{_D} select count(*) as \"rows\", {_DUPLICATES} as duplicate_rows from d")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.duplicate_rows(DIRTY_ORDERS.frame(spark, sf_dir))


@query("duplicate_documents", """
    select count(*) as "rows",
      count(*) - (select count(*) from (select distinct text, lang, source from documents) u) as duplicate_rows
    from documents""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_FINDINGS = f"""{_D}, n as (select count(*) as total, {_NULLS} as nulls, {_DUPLICATES} as dups,
      {", ".join(f"count(*) - count({c}) as n_{c}" for c in _DIRTY)} from d),
    found as (
      select 0 as ord, nulls || ' null values across ' || ({" + ".join(f"cast(n_{c} > 0 as integer)" for c in _DIRTY)})
        || ' columns' as issue from n where nulls > 0
      union all select 1, dups || ' duplicate rows' from n where dups > 0
      {" ".join(f"union all select {i + 2}, 'Column ''{c}'' has >50% nulls — consider dropping' from n "
                f"where n_{c} * 2 > total" for i, c in enumerate(_DIRTY))})"""


@query("issues", f"""{_FINDINGS}
    select cast(row_number() over (order by ord) - 1 as integer) as position, issue from found""")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.issues(DIRTY_ORDERS.frame(spark, sf_dir))


_SCORE = f"greatest(0.0, round(100 - nulls * 50.0 / (total * {_WIDTH}) - dups * 30.0 / total, 1))"


@query("quality_score", f"""{_D}, n as (select count(*) as total, {_NULLS} as nulls, {_DUPLICATES} as dups from d)
    select {_SCORE} as quality_score from n""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.quality_score(DIRTY_ORDERS.frame(spark, sf_dir))


_BYTES = """sum(16 + case when price is null then 0 else 8 end + coalesce(strlen(prio), 0)
      + coalesce(strlen(code), 0) + case when odate is null then 0 else 8 end)"""


@query("size_report", f"""{_D}
    select count(*) as "rows", {_WIDTH} as "columns", cast({_BYTES} as bigint) as bytes,
      round({_BYTES} / 1024.0 / 1024.0, 2) as memory_mb from d""")
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.size_report(DIRTY_ORDERS.frame(spark, sf_dir))


@query("preview", "select * from orders order by o_orderkey limit 5")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.preview(table(spark, sf_dir, "orders"), order_by="o_orderkey")


def _schema_item(position: int, column: str, dtype: str) -> str:
    return f"""select {position} as i, '{column}:{dtype}:' || (count(*) - count({column})) || ':'
      || cast(round((count(*) - count({column})) * 100.0 / count(*), 2) as double) || ':' || count(distinct {column})
      || ':' || ({_samples(column, 'd', 'o_orderkey')}) as item from d"""


@query("profile", f"""{_FINDINGS},
    items as ({" union all ".join(_schema_item(i, c, t) for i, (c, t) in enumerate(_DIRTY.items()))}),
    size as (select round({_BYTES} / 1024.0 / 1024.0, 2) as memory_mb from d)
    select 'orders' as file, total as "rows", {_WIDTH} as "columns", memory_mb, {_SCORE} as quality_score,
      (select string_agg(issue, '; ' order by ord) from found) as issues,
      (select string_agg(item, '; ' order by i) from items) as schema,
      '{", ".join(_DIRTY)}' as column_names,
      '{", ".join(sorted(f"{c}={t}" for c, t in _DIRTY.items()))}' as dtypes,
      (select string_agg(k, ',') from (select o_orderkey as k from d order by k limit 5) p) as preview_keys
    from n, size""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = profiling.profile(DIRTY_ORDERS.frame(spark, sf_dir), order_by="o_orderkey", file="orders")
    item = lambda s: F.concat_ws(":", s["name"], s["dtype"], s["nulls"], s["null_pct"], s["unique"],
                                 F.array_join(s["sample"], "|"))
    return report.select(
        "file", "rows", "columns", "memory_mb", "quality_score",
        F.array_join("issues", "; ").alias("issues"),
        F.array_join(F.transform("schema", item), "; ").alias("schema"),
        F.array_join("column_names", ", ").alias("column_names"),
        F.array_join(F.array_sort(F.transform(F.map_entries("dtypes"),
                                              lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ", ").alias("dtypes"),
        F.array_join(F.transform("preview", lambda r: r["o_orderkey"].cast("string")), ",").alias("preview_keys"))


@query("profile_merged", f"""
    with p as ({ACCOUNTS.sql()})""" + " union all ".join(f"""
    select '{name}' as name, cast(count(*) as bigint) as "rows", cast(count(*) - count({name}) as bigint) as nulls, true as distinct_near,
      {median} as median_near, cast(3 as bigint) as first_scanned, cast(1 as bigint) as then_scanned from p"""
    for name, median in (("c_custkey", "true"), ("c_name", "cast(null as boolean)"), ("balance", "true"), ("area", "cast(null as boolean)"), ("visits", "true"))))
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept sketches, of all folders first and then of the one that got rows, beside the table's own counts and ranks."""
    columns = ["c_custkey", "c_name", "balance", "area", "visits"]
    namespace, accounts = new_namespace(spark), ACCOUNTS.frame(spark, sf_dir).select(*columns, "season")
    target, store = f"{namespace}.accounts", f"{namespace}.sketches"
    later = "season = '2020-21' and c_custkey % 2 = 0"
    tables.create_or_replace(accounts.filter(f"not ({later})"), target, ["season"])
    first = sketches.refresh_sketches(spark, target, store)
    tables.append(accounts.filter(later), target)
    then = sketches.refresh_sketches(spark, target, store)
    merged = {r["name"]: r for r in sketches.merged_profile(spark, target, store).collect()}
    stored, rows = tables.read_table(spark, target), []
    exact = stored.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for name in columns:
        found, near = merged[name], None
        if found["median_estimate"] is not None:
            below, upto = stored.agg(*[F.avg(F.expr(f"cast({name} {o} {found['median_estimate']!r}D as int)")) for o in ("<", "<=")]).first()
            near = below - sketches.RANK_ERROR <= 0.5 <= upto + sketches.RANK_ERROR
        distinct_near = abs(found["distinct_estimate"] - exact[name]) <= 0.04 * exact[name]
        rows.append((name, found["rows"], found["nulls"], distinct_near, near, first.scanned, then.scanned))
    return spark.createDataFrame(rows, "name string, rows bigint, nulls bigint, distinct_near boolean, median_near boolean, first_scanned bigint, then_scanned bigint")
