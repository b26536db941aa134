"""Profiles that are merged, not computed again: sketches kept for each folder of a table.

A table's files lie in folders, one for each partition. For each folder and column the store keeps rows, nulls,
a sketch of the distinct values and one of the ranks of numbers. A refresh lists the files, scans the folders whose
files have changed, and adds their sketches; a profile unites the sketches of the folders as they are now.
Rows of a folder's earlier state stay in the store, unused, until ``compact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.values import FLOATS, group_key, present
from . import tables
from .quantiles import sketched
from .staging import staged

#: Registers of a distinct sketch, as a power of two: a standard error of about 1.04 / sqrt(2^14), 0.8 percent.
REGISTERS = 14
RANK_ERROR = 0.01
#: Folders that one scan reads.
FOLDERS_AT_ONCE = 10_000

STORE_SCHEMA = (
    "folder string, state bigint, position int, name string, dtype string, rows bigint, nulls bigint, "
    "distinct_sketch binary, rank_sketch binary"
)
_NUMBERS = (T.IntegralType, T.DecimalType, *FLOATS)


@dataclass(frozen=True)
class Sketched:
    """What a refresh has done: folders of the table, and how many of them were scanned."""

    folders: int
    scanned: int


def folders(spark: SparkSession, table: str) -> DataFrame:
    """(folder, place, state): each folder of a Parquet table, as scans name it and as readers take it, and a number for its files, their sizes and times.

    Files are listed, not read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
        .load(_location(spark, table)).select("path", "length", "modificationTime", F.col("_metadata.file_path").alias("file")))
    return files.groupBy(_parent("file").alias("folder"), _parent("path").alias("place")).agg(
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("state"))


def _parent(path: str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _location(spark: SparkSession, table: str) -> str:
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {tables.quoted(table)}").where("col_name = 'Location'").first()
    return found["data_type"]


def _key(f: T.StructField) -> Column:
    """A value as text or a whole number, which is what distinct sketches take."""
    key = group_key(col(f.name), f.dataType)
    if isinstance(f.dataType, T.IntegralType):
        return key.cast("bigint")
    return F.when(key == 0, F.lit("0")).otherwise(key.cast("string")) if isinstance(f.dataType, FLOATS) else key.cast("string")


def sketch(df: DataFrame, by: Column) -> DataFrame:
    """A row for each group and column of ``df``: (folder, position, name, dtype, rows, nulls, distinct_sketch, rank_sketch).

    One scan. Partial sketches meet in the shuffle, a few KB for each group, column and task.
    """
    fields = df.schema.fields
    measures = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        number = isinstance(f.dataType, _NUMBERS)
        measures += [
            F.count(present(col(f.name), f.dataType)).alias(f"n{i}"),
            F.hll_sketch_agg(_key(f), REGISTERS).alias(f"d{i}"),
            (sketched(col(f.name), f.dataType, RANK_ERROR) if number else F.max(F.lit(None).cast("binary"))).alias(f"q{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_sketch"), F.col(f"q{i}").alias("rank_sketch"))
        for i, f in enumerate(fields)])
    return df.groupBy(by.alias("folder")).agg(*measures).select("folder", F.inline(rows))


def refresh_sketches(spark: SparkSession, table: str, store: str) -> Sketched:
    """Sketch the folders of a table that have changed since the last refresh, and append that to the table ``store``.

    A refresh that is repeated after a failure may append a folder's sketches again; a profile takes them once.
    """
    tables.create_table(spark, store, spark.createDataFrame([], STORE_SCHEMA).schema)
    schema, root = tables.read_table(spark, table).schema, _location(spark, table)
    with staged(folders(spark, table)) as now:
        known = tables.read_table(spark, store).select("folder", "state")
        changed = now.join(known, ["folder", "state"], "left_anti")
        names, scanned = changed.orderBy("folder").toLocalIterator(), 0
        while some := list(islice(names, FOLDERS_AT_ONCE)):
            rows = spark.read.schema(schema).option("basePath", root).parquet(*[r["place"] for r in some])
            states = spark.createDataFrame([(r["folder"], r["state"]) for r in some], "folder string, state bigint")
            tables.append(sketch(rows, _parent("_metadata.file_path")).join(states, "folder"), store)
            scanned += len(some)
        return Sketched(now.count(), scanned)


def _current(spark: SparkSession, table: str, store: str) -> DataFrame:
    """The store's rows for the folders as they are now, each once."""
    rows = tables.read_table(spark, store).join(folders(spark, table).select("folder", "state"), ["folder", "state"])
    return rows.dropDuplicates(["folder", "state", "name"])


def merged_profile(spark: SparkSession, table: str, store: str) -> DataFrame:
    """(position, name, dtype, rows, nulls, distinct_estimate, median_estimate) of each column, from the stored sketches.

    Rows and nulls are exact. The table's rows are not read; folders that changed since the last refresh
    are left out until the next one.
    """
    merged = _current(spark, table, store).groupBy("name").agg(
        F.max("position").alias("position"), F.max_by("dtype", "folder").alias("dtype"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("rank_sketch").alias("ranks"))
    median = F.when(F.kll_sketch_get_n_double("ranks") > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5)))
    return merged.select("position", "name", "dtype", "rows", "nulls", "distinct_estimate", median.alias("median_estimate"))


def compact(spark: SparkSession, table: str, store: str) -> None:
    """Rewrite a store without the rows of folders that are gone or have changed."""
    tables.create_or_replace(_current(spark, table, store).select(*tables.read_table(spark, store).columns), store)
