"""Loading a growing folder: each run takes the files that no run before has taken."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tables
from ..sources.files import extension, load_file

#: The partition column that names the stream and batch which stored a row.
BATCH = "load_batch"


@dataclass(frozen=True)
class Arrived:
    """What a run has stored: batches and rows."""

    table: str
    batches: int
    rows: int


def store_batch(rows: DataFrame, table: str, name: str) -> None:
    """Store a batch under its name; a batch that is stored again replaces itself."""
    tables.overwrite_partitions(rows.withColumn(BATCH, F.lit(name)), table)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps for its stream; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def load_new_files(
    spark: SparkSession, folder: str, table: str, checkpoint: str, schema: T.StructType | None = None,
    file_format: str | None = None, files_at_once: int | None = None, **options,
) -> Arrived:
    """Append the files of a folder that are new since the last run to a table.

    The checkpoint knows which files have been taken. A run takes what is there, in batches of
    ``files_at_once``, and ends. The table is partitioned by ``load_batch``: a batch whose run failed before its end
    was noted is taken again and replaces what it had stored, so that each file arrives once. The schema is that of the
    table, or is inferred from the files if there is no table yet. Rows of a file that changes after it
    was taken are not seen: new rows come in new files.
    """
    file_format = file_format or extension(folder).lstrip(".")
    if file_format not in ("csv", "json", "parquet"):
        raise ValueError(f"files of a known format, csv, json or parquet: {file_format!r}")
    defaults = {"csv": {"header": True}, "json": {"multiLine": True}, "parquet": {}}[file_format]
    options = {**defaults, **options}
    if tables.table_exists(spark, table):
        schema = T.StructType([f for f in tables.read_table(spark, table).schema if f.name != BATCH])
    elif schema is None:
        schema = load_file(spark, folder, **options).schema if extension(folder) else _inferred(spark, folder, file_format, options)
    tables.create_table(spark, table, T.StructType([*schema, T.StructField(BATCH, T.StringType())]), [BATCH])
    if files_at_once:
        options["maxFilesPerTrigger"] = files_at_once
    arriving = spark.readStream.format(file_format).schema(schema).options(**options).load(folder)

    def store(rows: DataFrame, number: int) -> None:
        store_batch(rows, table, f"{stream_id(rows.sparkSession, checkpoint)}-{number:08d}")

    running = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()
        spark.catalog.refreshTable(table)  # batches are stored by the stream's own session
    done = [p for p in running.recentProgress if p["numInputRows"]]
    return Arrived(table, len(done), sum(p["numInputRows"] for p in done))


def _inferred(spark: SparkSession, folder: str, file_format: str, options: dict) -> T.StructType:
    infer = {"inferSchema": True} if file_format == "csv" else {}
    return spark.read.options(**infer, **options).format(file_format).load(folder).schema
