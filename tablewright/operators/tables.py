"""Writing, reading and refreshing tables of a catalog.

Tables have identifiers (``sales.orders``, ``lake.sales.orders``). In the session catalog they are
Parquet tables, written with Spark's own writers, their partition columns last; a V2 catalog with a table format does the same
with its own commands, and alone has snapshots and conflict checks between writers. With Parquet
tables two writers of one table must take turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass
from hashlib import sha256
from itertools import islice
from threading import Lock

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from .staging import staged

# Column groups that never partition a table, and what counts as a category.
METADATA_COLUMNS = ("_ingested_at", "_source")
MIN_CATEGORIES, MAX_CATEGORIES = 2, 100
SHOWN_SNAPSHOTS = 5
#: Partitions that one statement drops.
DROPPED_AT_ONCE = 500
#: With this option in its description, a table's overwrites replace only the partitions that occur.
BY_PARTITION = "partitionOverwriteMode"

_MOMENTS = (T.TimestampType, T.TimestampNTZType)


def quoted(identifier: str) -> str:
    return ".".join(f"`{part}`" for part in identifier.split("."))


def has_format(spark: SparkSession, table: str) -> bool:
    """Whether a table format of a V2 catalog stores the table, not the session catalog."""
    parts = table.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    return catalog != "spark_catalog"


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """Create the namespace if it is absent (K8)."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {quoted(namespace)}{place}")


def table_exists(spark: SparkSession, table: str) -> bool:
    """Whether the table has been created."""
    return spark.catalog.tableExists(table)


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns whose values name the folders of a Parquet table."""
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def _spread(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Rows of a partition together; adaptive execution splits hot partitions and merges small ones."""
    return df.hint("rebalance", *[col(p) for p in partition_by]) if partition_by else df


def _new_table(df: DataFrame, partition_by: list[str]) -> DataFrameWriter:
    """The writer of a new Parquet table."""
    writer = _spread(df, partition_by).write.format("parquet").partitionBy(*partition_by)
    return writer.option(BY_PARTITION, "dynamic") if partition_by else writer


def create_table(spark: SparkSession, table: str, schema: T.StructType, partition_by: list[str] = ()) -> None:
    """Create an empty table with these columns if it is absent (K3)."""
    if not table_exists(spark, table):
        writer = spark.createDataFrame([], schema).writeTo(table).using("parquet")
        if partition_by and not has_format(spark, table):
            writer = writer.option(BY_PARTITION, "dynamic")
        (writer.partitionedBy(*map(col, partition_by)) if partition_by else writer).create()


def create_or_replace(df: DataFrame, table: str, partition_by: list[str] = ()) -> None:
    """Create the table or replace its rows and columns (K4); ``df`` may read the table itself."""
    spark, partition_by = df.sparkSession, list(partition_by)
    if has_format(spark, table):
        writer = df.writeTo(table)
        (writer.partitionedBy(*map(col, partition_by)) if partition_by else writer).createOrReplace()
        return
    with staged(df) as rows:
        _new_table(rows, partition_by).mode("overwrite").saveAsTable(table)


def replace_ctas(df: DataFrame, table: str, partition_col: str | None = None) -> None:
    """Drop the table and create it from ``df`` (K6); ``df`` may read the table itself."""
    partition_by = [partition_col] if partition_col else []
    with staged(df) as rows:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
        writer = _spread(rows, partition_by).write.partitionBy(*partition_by) if has_format(df.sparkSession, table) else _new_table(rows, partition_by)
        writer.saveAsTable(table)


def conformed(df: DataFrame, table: str) -> DataFrame:
    """Columns in the order and types of the table; other columns raise."""
    fields = read_table(df.sparkSession, table).schema.fields
    missing = [f.name for f in fields if f.name not in df.columns]
    extra = [n for n in df.columns if n not in {f.name for f in fields}]
    if missing or extra:
        raise ValueError(f"columns differ from the table: missing {missing}, extra {extra}")
    return df.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def append(df: DataFrame, table: str) -> None:
    """Add rows to an existing table (K7)."""
    rows = conformed(df, table)
    if has_format(df.sparkSession, table):
        rows.writeTo(table).append()
    else:
        _spread(rows, partition_columns(df.sparkSession, table)).write.insertInto(table)


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replace the partitions that occur in ``df``, or all of an unpartitioned table (K5).

    ``df`` must not read the table itself.
    """
    rows = conformed(df, table)
    if has_format(df.sparkSession, table):
        rows.writeTo(table).overwritePartitions()
        return
    by = partition_columns(df.sparkSession, table)
    with _replacing_by_partition(df.sparkSession, table) if by else nullcontext():
        _spread(rows, by).write.mode("overwrite").insertInto(table)


_session_setting = Lock()


@contextmanager
def _replacing_by_partition(spark: SparkSession, table: str) -> Iterator[None]:
    """Tables of this library say in their own description how they are overwritten.

    For others the session says it while they are written, one at a time.
    """
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").where("col_name = 'Storage Properties'").first()
    if described and f"{BY_PARTITION}=dynamic" in described["data_type"]:
        yield
        return
    key = "spark.sql.sources.partitionOverwriteMode"
    with _session_setting:
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")
        try:
            yield
        finally:
            spark.conf.set(key, before)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The current rows."""
    return spark.table(table)


def write_staging(df: DataFrame, root: str, table: str) -> str:
    """Overwrite ``<root>/staging/<table>_cleaned`` as Parquet; return the path (K2)."""
    path = f"{root.rstrip('/')}/staging/{table}_cleaned"
    df.write.mode("overwrite").parquet(path)
    return path


def verify_count(spark: SparkSession, table: str) -> int:
    """Rows of the stored table (K10), from file footers where the format has them."""
    return read_table(spark, table).count()


def newest_snapshots(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Snapshots (snapshot_id, committed_at, operation, summary), newest first, with the rows each added (M1)."""
    added = F.try_element_at("summary", F.lit("added-records")).cast("bigint")
    newest = log.withColumn("added_records", added).orderBy(F.col("committed_at").desc(), F.col("snapshot_id").desc())
    return newest if limit is None else newest.limit(limit)


def snapshots(spark: SparkSession, table: str, limit: int | None = None) -> DataFrame:
    """Snapshots of a table whose format keeps them (M1); others raise."""
    if not has_format(spark, table):
        raise ValueError(f"{table} has no snapshots: the session catalog keeps none")
    return newest_snapshots(spark.table(f"{table}.snapshots").select("snapshot_id", "committed_at", "operation", "summary"), limit)


def describe(spark: SparkSession, table: str) -> DataFrame:
    """Columns as ``(position, name, type)`` in order; no rows if the table cannot be read (M2)."""
    try:
        fields = read_table(spark, table).schema.fields
    except AnalysisException:
        fields = []
    return spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "position int, name string, type string")


def delete_where(spark: SparkSession, table: str, condition: str, confirm: bool = False) -> DataFrame | None:
    """Rows a delete would remove; with ``confirm`` remove them.

    A row goes only if the condition is true: a condition that is null keeps it. Only partitions
    that hold such a row are written again.
    """
    if not confirm:
        return read_table(spark, table).filter(condition)
    if has_format(spark, table):
        spark.sql(f"DELETE FROM {quoted(table)} WHERE {condition}")
    else:
        hit = F.coalesce(F.expr(condition), F.lit(False))
        _rewrite(spark, table, read_table(spark, table).filter(hit), lambda touched: touched.filter(~hit))
    return None


def merge(df: DataFrame, table: str, key: str) -> None:
    """Store rows by key: replace equal keys, insert new ones (K13). A key that repeats in ``df`` raises.

    Only partitions that lose or gain a row are written again.
    """
    spark = df.sparkSession
    with staged(conformed(df, table)) as updates:
        twice = updates.groupBy(col(key)).count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"the key {twice[0]!r} repeats in the rows to merge")
        if has_format(spark, table):
            (updates.alias("s").mergeInto(table, F.expr(f"{quoted(table)}.`{key}` = s.`{key}`"))
             .whenMatched().updateAll().whenNotMatched().insertAll().merge())
            return
        keys, current = updates.select(col(key)), read_table(spark, table)
        replaced = current.join(keys, key, "left_semi").select(*map(col, current.columns))
        _rewrite(spark, table, replaced.unionByName(updates), lambda touched: touched.join(keys, key, "left_anti").select(
            *map(col, touched.columns)).unionByName(updates))


def create_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Create or replace a Parquet table whose rows are kept in buckets by a key, for ``merge_bucketed``."""
    with staged(df.repartition(buckets, col(key))) as rows:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
        rows.repartition(buckets, col(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def merged_buckets(updates: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """The rows of a bucketed table after a merge. Updates go to the table's buckets; the table's rows stay where they are."""
    current = read_table(updates.sparkSession, table)
    placed = updates.repartition(buckets, col(key))
    kept = current.join(placed.select(col(key)).hint("merge"), key, "left_anti").select(*map(col, current.columns))
    return kept.unionByName(placed)


def merge_bucketed(df: DataFrame, table: str, key: str) -> None:
    """Store rows by key in a bucketed table: replace equal keys, insert new ones (K13). A key that repeats in ``df`` raises.

    The table's rows are never shuffled, only ``df``. All buckets are written again, to a table that then takes the
    place of the old one. ``df`` may read the table itself.
    """
    spark = df.sparkSession
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").collect()}
    if described.get("Bucket Columns") != f"[`{key}`]":
        raise ValueError(f"{table} is not in buckets by {key}")
    buckets, following = int(described["Num Buckets"]), f"{table}__next"
    with staged(conformed(df, table)) as updates:
        twice = updates.groupBy(col(key)).count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"the key {twice[0]!r} repeats in the rows to merge")
        spark.sql(f"DROP TABLE IF EXISTS {quoted(following)}")
        merged_buckets(updates, table, key, buckets).write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(following)
    spark.sql(f"DROP TABLE {quoted(table)}")
    spark.sql(f"ALTER TABLE {quoted(following)} RENAME TO {quoted(table)}")


def _rewrite(spark: SparkSession, table: str, cause: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write the partitions again that hold a row of ``cause``: ``change`` makes their new rows.

    Partitions left without rows are dropped.
    """
    by, current = partition_columns(spark, table), read_table(spark, table)
    if not by:
        if not cause.isEmpty():
            with staged(change(current)) as rows:
                overwrite_partitions(rows, table)
        return
    with staged(cause.select(*map(col, by)).distinct()) as places:
        same = [current[p].eqNullSafe(places[p]) for p in by]
        touched = current.join(places, same, "left_semi")
        with staged(change(touched)) as rows:
            left = rows.select(*map(col, by)).distinct()
            emptied = places.join(left, [places[p].eqNullSafe(left[p]) for p in by], "left_anti")
            overwrite_partitions(rows, table)
            _drop_partitions(spark, table, by, emptied)


def _drop_partitions(spark: SparkSession, table: str, by: list[str], emptied: DataFrame) -> None:
    """Drop the partitions that ``emptied`` names, ``DROPPED_AT_ONCE`` in a statement. A name for each, no rows."""
    def literal(value: str | None) -> str:
        return "null" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    names = emptied.select(*[col(p).cast("string") for p in by]).toLocalIterator()
    while some := list(islice(names, DROPPED_AT_ONCE)):
        specs = [", ".join(f"`{p}` = {literal(v)}" for p, v in zip(by, row)) for row in some]
        spark.sql(f"ALTER TABLE {quoted(table)} DROP IF EXISTS " + ", ".join(f"PARTITION ({spec})" for spec in specs))


def choose_partition(df: DataFrame) -> str | None:
    """A column to partition by (M3): the first date or timestamp column, else the
    first string column with 2 to 100 values, else none. A missing value is one of them.

    One scan: a task stops noting a column's values at 101, which is enough to tell.
    """
    fields = [f for f in df.schema.fields if f.name not in METADATA_COLUMNS]
    for f in fields:
        if isinstance(f.dataType, (T.DateType, *_MOMENTS)):
            return f.name
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None

    def some_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in texts]
        for batch in batches:
            for values, column in zip(seen, batch.columns):
                if len(values) <= MAX_CATEGORIES:
                    values.update(islice((v.as_py() for v in column.unique()), 2 * MAX_CATEGORIES))
        rows = [(i, "" if v is None else sha256(v.encode()).hexdigest()) for i, values in enumerate(seen) for v in values]
        yield pa.RecordBatch.from_pydict({"place": pa.array([r[0] for r in rows], pa.int32()), "value": pa.array([r[1] for r in rows], pa.string())})

    noted = df.select(*map(col, texts)).mapInArrow(some_values, "place int, value string").distinct()
    counts = {r["place"]: r["count"] for r in noted.groupBy("place").count().collect()}
    return next((n for i, n in enumerate(texts) if MIN_CATEGORIES <= counts.get(i, 0) <= MAX_CATEGORIES), None)


def partition_by_day(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """A timestamp partitions by its day, in a new column ``<column>_day``; others as they are."""
    if isinstance(df.schema[column].dataType, _MOMENTS):
        day = f"{column}_day"
        return df.withColumn(day, F.to_date(col(column))), day
    return df, column


@dataclass(frozen=True)
class Written:
    """Outcome of a write: rows stored, and the newest snapshot where the format keeps them."""

    table: str
    rows: int
    snapshot: Row | None = None


def write_table(
    df: DataFrame, table: str, partition_col: str | None = None, mode: str = "overwrite"
) -> Written:
    """Create the namespace, write in one of two modes, count, and report the snapshot.

    ``overwrite`` drops and creates the table, partitioned by ``partition_col`` or
    by the column that ``choose_partition`` finds; ``append`` adds to the table.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"unknown mode: {mode!r}")
    spark = df.sparkSession
    if "." in table:
        ensure_namespace(spark, table.rpartition(".")[0])
    if mode == "append":
        append(df, table)
    else:
        column = partition_col or choose_partition(df)
        if column:
            df, column = partition_by_day(df, column)
        replace_ctas(df, table, column)
    newest = snapshots(spark, table, limit=1).first() if has_format(spark, table) else None
    return Written(table, verify_count(spark, table), newest)


@dataclass(frozen=True)
class Refreshed:
    """Outcome of a refresh: rows before and after, and the newest snapshots where there are any."""

    rows_read: int
    rows_stored: int
    snapshots: DataFrame | None


def refresh(spark: SparkSession, table: str, shown: int | None = SHOWN_SNAPSHOTS) -> Refreshed:
    """Read all rows and write them back (K9); with a table format, as a new snapshot."""
    with staged(read_table(spark, table)) as rows:
        before = rows.count()
        overwrite_partitions(rows, table)
    return Refreshed(before, verify_count(spark, table), snapshots(spark, table, shown) if has_format(spark, table) else None)
