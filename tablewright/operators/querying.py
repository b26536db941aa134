"""Questions on one table: rows, counts, filters, statistics, and SQL text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from .profiling import _per_column, profile_nulls

# Fixed value: rows for a plain "first rows" question.
FIRST_ROWS = 10


def _limited(df: DataFrame, limit: int | None, order_by: str | None) -> DataFrame:
    if order_by is not None:
        df = df.orderBy(col(order_by))
    return df if limit is None else df.limit(limit)


def top_n(df: DataFrame, n: int = FIRST_ROWS, order_by: str | None = None) -> DataFrame:
    """The first ``n`` rows by ``order_by``, or any ``n`` rows (Q1)."""
    return _limited(df, n, order_by)


def row_count(df: DataFrame) -> DataFrame:
    """Number of rows (Q2)."""
    return df.agg(F.count("*").alias("total_rows"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per group, ordered by group (Q3)."""
    groups = [col(k) for k in keys]
    return df.groupBy(*groups).agg(F.count("*").alias("count")).orderBy(*groups)


def where_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value (Q4)."""
    return df.filter(col(column) == F.lit(value))


def where_above(df: DataFrame, column: str, value, limit: int | None = None,
                order_by: str | None = None) -> DataFrame:
    """Rows above a number (Q5), or the first ``limit`` of them."""
    return _limited(df.filter(col(column) > F.lit(value)), limit, order_by)


def fiscal_after(df: DataFrame, column: str, year: int | str, limit: int | None = None,
                 order_by: str | None = None) -> DataFrame:
    """Rows whose fiscal year text (``'2021-22'``) starts after a year (Q6), or the first ``limit`` of them."""
    later = F.substring(col(column), 1, 4) > F.lit(str(year))
    return _limited(df.filter(later), limit, order_by)


def where_like(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose text holds a substring; ``%`` and ``_`` are plain characters (Q7)."""
    return df.filter(col(column).contains(text))


def null_check(df: DataFrame) -> DataFrame:
    """Nulls per column (Q8)."""
    return profile_nulls(df).select("name", "nulls")


def numeric_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum and average of every numeric column (Q9). One scan."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "name string, min double, max double, avg double")
    stats = df.agg(*[
        measure(col(f.name)).cast("double").alias(f"{prefix}{i}")
        for i, f in enumerate(fields)
        for prefix, measure in (("lo", F.min), ("hi", F.max), ("av", F.avg))
    ])
    return _per_column(stats, fields, {"lo": "min", "hi": "max", "av": "avg"}).drop("position")


def avg_of(df: DataFrame, column: str) -> DataFrame:
    """Average of one column (Q10)."""
    return df.agg(F.avg(col(column)).alias("avg"))


def where_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value, the set a delete of null rows would remove (Q11)."""
    return df.filter(col(column).isNull())


def select_as(df: DataFrame, mapping: dict[str, Column | str | int | float | bool]) -> DataFrame:
    """Named columns and literals under new names (Q13).

    A ``Column`` is used as it is; any other value becomes a literal.
    """
    return df.select(*[
        (v if isinstance(v, Column) else F.lit(v)).alias(name) for name, v in mapping.items()
    ])


@dataclass(frozen=True)
class Verdict:
    """What a statement would do: ``reads`` or not, its plan, and an error if it does not parse."""

    reads: bool
    statement: str
    error: str | None = None


# Roots of plans that only read, nodes that write, and functions that run code outside of SQL.
READING_PLANS = {
    "Project", "Filter", "Aggregate", "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit",
    "Offset", "Distinct", "Union", "Intersect", "Except", "CTE", "UnresolvedWith", "WithWindowDefinition",
    "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "UnresolvedSubqueryColumnAliases",
    "SubqueryAlias", "Join", "Generate", "Pivot", "Unpivot", "DescribeRelation", "DescribeColumn",
    "DescribeQueryCommand", "ExplainCommand", "ShowTables", "ShowColumns", "ShowNamespaces", "ShowFunctions",
    "ShowPartitions", "ShowTableProperties", "ShowCreateTable", "ShowViews",
}
FOREIGN_CALLS = ("java_method", "reflect", "try_reflect")
_WRITING_NODE = re.compile(
    r"^(Insert|Delete|Update|Merge|Create|Replace|Drop|Alter|Truncate|Overwrite|Append|Write|Set|Add|Cache|Load)")


def _all_nodes(plan) -> Iterator[tuple[str, str]]:
    """Kind of each node of a parsed plan, and the name that a function has: plans, expressions, plans in these."""
    stack = [plan]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        yield kind, node.nameParts().mkString(".").lower() if kind == "UnresolvedFunction" else ""
        for inside in _parts_of(node):
            group = getattr(node, inside)()
            stack += [group] if inside in ("plan", "logicalPlan") else [group.apply(i) for i in range(group.size())]


#: What holds further nodes, for each class of node that has been met.
_parts: dict[str, tuple[str, ...]] = {}


def _parts_of(node) -> tuple[str, ...]:
    name = node.getClass().getName()
    if name not in _parts:
        known = {m.getName() for m in node.getClass().getMethods() if m.getParameterCount() == 0}
        _parts[name] = tuple(known & {"children", "innerChildren", "expressions", "plan", "logicalPlan"})
    return _parts[name]


def guard_sql(spark: SparkSession, sql: str) -> Verdict:
    """Class of a statement by the plan Spark parses from it (Q14).

    Nothing runs and nothing is looked up. A statement reads only if its root is a known reading
    plan, no node in it writes, and it calls no function that runs code outside of SQL.
    """
    try:
        nodes = list(_all_nodes(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)))
    except PySparkException as e:
        return Verdict(False, "unparsed", str(e))
    root = nodes[0][0]
    writing = next((kind for kind, _ in nodes if _WRITING_NODE.match(kind)), None)
    foreign = next((name for _, name in nodes if name.rpartition(".")[2] in FOREIGN_CALLS), None)
    return Verdict(root in READING_PLANS and not writing and not foreign, writing or foreign or root)


def _comment(depth: int) -> str:
    """A bracketed comment with comments in it, as many levels down as given."""
    inner = _comment(depth - 1) + "|" if depth else ""
    return rf"/\*(?:[^/*]++|{inner}/(?!\*)|\*(?!/))*+\*/"


# Text of a statement that is no code. A raw string has no escapes; a doubled mark stays inside.
COMMENT_LEVELS = 6
NO_CODE = "(?s)" + "|".join([
    r"--[^\n]*", _comment(COMMENT_LEVELS), r"(?<!\w)[rR](?:'[^']*'|\"[^\"]*\")",
    r"'(?:[^'\\]|\\.|'')*+'", r'"(?:[^"\\]|\\.|"")*+"', r"`(?:[^`]|``)*+`",
])


def reads(statement: Column) -> Column:
    """Whether a statement only reads (Q14), by its words; a null one doesn't.

    Comments, which may nest, and quoted text are blanked first; a mark that is not closed, or comments
    nested too deep, make it no read. A statement reads if it starts with a reading keyword, holds no
    second statement, no clause that writes, and no call of foreign code.
    """
    bare = F.regexp_replace(statement, NO_CODE, " ")
    objects = "table|view|temporary|temp|global|external|database|schema|namespace|function|catalog|index|user|role|or\\s+replace"
    found = (
        bare.rlike(r"(?i)^[\s(]*(select|with|describe|desc|show|explain|values|table|from)\b")
        & ~bare.rlike(r"(?i)\b(insert\s+(into|overwrite)|delete\s+from|update\s+\S+\s+set|merge\s+into|truncate\s+table|(grant|revoke)\s+\S+\s+on)\b")
        & ~bare.rlike(rf"(?i)\b(create|drop|alter)\s+({objects})\b")
        & ~bare.rlike(rf"(?i)\b({'|'.join(FOREIGN_CALLS)})\s*\(")
        & ~bare.rlike(r";\s*\S") & ~bare.rlike(r"/\*|['\"`]")
    )
    return F.coalesce(found, F.lit(False))


def guard_statements(df: DataFrame, column: str) -> DataFrame:
    """Add ``is_read`` for a whole table of statements (Q14)."""
    return df.withColumn("is_read", reads(col(column)))


@dataclass(frozen=True)
class Answer:
    """All rows of an answer, or the error text in place of an exception."""

    rows: DataFrame | None = None
    error: str | None = None


def run_sql(spark: SparkSession, sql: str, confirm: bool = False) -> Answer:
    """Run a SQL string (Q12). A statement that changes data needs ``confirm``.

    The answer is a table like any other: the caller takes, counts or stores its rows.
    """
    try:
        verdict = guard_sql(spark, sql)
        if verdict.error is not None:
            return Answer(error=verdict.error)
        if not verdict.reads and not confirm:
            return Answer(error=f"{verdict.statement} is not a read; confirm to run it")
        return Answer(spark.sql(sql))
    except PySparkException as e:
        return Answer(error=str(e))
