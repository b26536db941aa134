"""File scans. Paths may be files, folders or globs on any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .workbooks import read_xlsx


def _reader(spark: SparkSession, schema: T.StructType | str | None, options: dict):
    reader = spark.read.options(**options)
    return reader.schema(schema) if schema else reader


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header (S1). Without a schema, one extra pass infers the types.

    ``escape='"'`` reads quotes that are doubled inside a quoted field;
    ``multiLine=True`` reads line breaks inside one, at the price of a task per file.
    """
    return _reader(spark, schema, {"header": True, "inferSchema": schema is None, **options}).csv(path)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True, **options
) -> DataFrame:
    """JSON documents, each an array of records or one record.

    A document is read whole by one task. Large data belongs in one-record-per-line
    files, which split: ``multi_line=False``.
    """
    return _reader(spark, schema, {"multiLine": multi_line, **options}).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Parquet (S3)."""
    return _reader(spark, schema, options).parquet(path)


READERS = {".csv": read_csv, ".json": read_json, ".parquet": read_parquet, ".xlsx": read_xlsx}


def extension(path: str) -> str:
    """Lower-cased extension of the last part of a path, with its dot."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    stem, dot, suffix = last.rpartition(".")
    return (dot + suffix).lower() if stem else ""


def load_file(
    spark: SparkSession, path: str, on_unknown: str = "error", schema: T.StructType | None = None, **options
) -> DataFrame:
    """Read by extension (S5); an unknown one raises, or is read as CSV if ``on_unknown="csv"``.

    A known ``schema`` saves the pass over the data that infers one. Other options
    go to the reader.
    """
    if on_unknown not in ("error", "csv"):
        raise ValueError(f"unknown on_unknown: {on_unknown!r}")
    reader = READERS.get(extension(path))
    if reader is None:
        if on_unknown == "error":
            raise ValueError(f"unsupported file type: {extension(path) or path!r}")
        reader = read_csv
    return reader(spark, path, schema, **options)
