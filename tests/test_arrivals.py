import pytest
from pyspark.sql import functions as F

from tablewright.operators import tables
from tablewright.streaming import arrivals


@pytest.fixture()
def namespace(spark):
    spark.sql("create database if not exists arriving")
    yield "arriving"
    spark.sql("drop database arriving cascade")


def stored(spark, table):
    return sorted((r["k"], r["v"]) for r in tables.read_table(spark, table).collect())


def add(spark, folder, lo, hi, file_format="parquet", **options):
    rows = spark.range(lo, hi).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    rows.coalesce(1).write.mode("append").options(**options).format(file_format).save(folder)


@pytest.mark.parametrize("file_format, options", [("parquet", {}), ("csv", {"header": True}), ("json", {})])
def test_each_file_once(spark, namespace, tmp_path, file_format, options):
    folder, checkpoint, table = f"{tmp_path}/in", f"{tmp_path}/done", f"{namespace}.{file_format}"
    read = {"multiLine": False} if file_format == "json" else {}
    for lo in (0, 10):
        add(spark, folder, lo, lo + 10, file_format, **options)
    first = arrivals.load_new_files(spark, folder, table, checkpoint, file_format=file_format, files_at_once=1, **read)
    assert (first.batches, first.rows) == (2, 20)
    add(spark, folder, 20, 30, file_format, **options)
    second = arrivals.load_new_files(spark, folder, table, checkpoint, file_format=file_format, **read)
    third = arrivals.load_new_files(spark, folder, table, checkpoint, file_format=file_format, **read)
    assert (second.batches, second.rows, third.rows) == (1, 10, 0)
    assert stored(spark, table) == [(i, f"v{i}") for i in range(30)]
    assert tables.read_table(spark, table).select(arrivals.BATCH).distinct().count() == 3


def test_a_batch_that_runs_twice_adds_nothing(spark, namespace, tmp_path, monkeypatch):
    """A run that dies after a batch was stored, before it was noted."""
    folder, checkpoint, table = f"{tmp_path}/in", f"{tmp_path}/done", f"{namespace}.twice"
    add(spark, folder, 0, 10)
    store = arrivals.store_batch

    def dies(rows, *where):
        store(rows, *where)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(arrivals, "store_batch", dies)
    with pytest.raises(Exception, match="lost after the write"):
        arrivals.load_new_files(spark, folder, table, checkpoint, file_format="parquet")
    assert len(stored(spark, table)) == 10
    monkeypatch.setattr(arrivals, "store_batch", store)
    add(spark, folder, 10, 15)
    arrivals.load_new_files(spark, folder, table, checkpoint, file_format="parquet")
    assert stored(spark, table) == [(i, f"v{i}") for i in range(15)]


def test_a_new_checkpoint_does_not_replace_what_is_stored(spark, namespace, tmp_path):
    folder, table = f"{tmp_path}/in", f"{namespace}.again"
    add(spark, folder, 0, 3)
    for checkpoint in ("a", "b"):
        arrivals.load_new_files(spark, folder, table, f"{tmp_path}/{checkpoint}", file_format="parquet")
    assert len(stored(spark, table)) == 6
    with pytest.raises(ValueError, match="format"):
        arrivals.load_new_files(spark, folder, table, f"{tmp_path}/c")
