"""Queries over the cleaning steps and the whole cleaning job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..operators import cleaning
from ..operators.staging import scratch_dir
from .contract import query
from .inputs import DIRTY_ORDERS, DIRTY_WITH_EMPTY
from .jobs import clean_file as clean_file_job

#: Raw headers that the name cleaner has to repair.
RAW_NAMES = ["Order Key", "Cust-Key", " Price (EUR)", "Prio", "Code.No", "Order/Date"]
_RENAMED = (
    "select o_orderkey as order_key, o_custkey as cust_key, price as price_eur, prio, code as code_no, "
    "odate as order_date from"
)
_TRIMMED = "o_orderkey, o_custkey, price, nullif(trim(prio), '') as prio, nullif(trim(code), '') as code, odate"


def _clean_oracle(source: str, rows: str) -> str:
    return f"""
    with typed as (
      select o_orderkey, o_custkey, price, nullif(trim(prio), '') as prio,
        try_cast(nullif(trim(code), '') as double) as code
      from (select distinct * from ({rows}) d) u
      where coalesce(cast(o_orderkey as varchar), cast(price as varchar), prio, code, cast(odate as varchar)) is not null),
    fill as (select quantile_disc(price, 0.5) as price, quantile_disc(code, 0.5) as code from typed)
    select t.o_orderkey as order_key, t.o_custkey as cust_key, coalesce(t.price, fill.price) as price_eur,
      coalesce(t.prio, 'UNKNOWN') as prio, coalesce(t.code, fill.code) as code_no, '{source}' as _source
    from typed t, fill"""


@query("clean", _clean_oracle("orders", DIRTY_WITH_EMPTY.sql()))
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = DIRTY_WITH_EMPTY.frame(spark, sf_dir).toDF(*RAW_NAMES)
    cleaned, _ = cleaning.clean(raw, "orders", rel_error=0.0)
    return cleaned.drop("_ingested_at")


@query("clean_file", _clean_oracle("orders_file", DIRTY_ORDERS.sql()))
def clean_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark)
    DIRTY_ORDERS.frame(spark, sf_dir).toDF(*RAW_NAMES).write.parquet(f"{root}/orders.parquet")
    path, _ = clean_file_job(spark, f"{root}/orders.parquet", root, "orders", "orders_file", rel_error=0.0)
    return spark.read.parquet(path).drop("_ingested_at")


@query("clean_names", f"{_RENAMED} ({DIRTY_ORDERS.sql()}) d")
def standard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_names(DIRTY_ORDERS.frame(spark, sf_dir).toDF(*RAW_NAMES))


@query("drop_empty", DIRTY_ORDERS.sql())
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_empty(DIRTY_WITH_EMPTY.frame(spark, sf_dir))


@query("dedupe", f"select distinct * from ({DIRTY_ORDERS.sql()}) d")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dedupe(DIRTY_ORDERS.frame(spark, sf_dir))


@query("trim_blank", f"select {_TRIMMED} from ({DIRTY_ORDERS.sql()}) d")
def trim_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.trim_blank(DIRTY_ORDERS.frame(spark, sf_dir))


@query("infer_numeric", f"""
    select o_orderkey, o_custkey, price, prio, try_cast(code as double) as code, odate
    from ({DIRTY_ORDERS.sql()}) d""")
def infer_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.infer_numeric(DIRTY_ORDERS.frame(spark, sf_dir))


@query("fill_nulls", f"""
    with t as (select {_TRIMMED} from ({DIRTY_ORDERS.sql()}) d),
    m as (select quantile_disc(price, 0.5) as median from t)
    select o_orderkey, o_custkey, coalesce(price, median) as price, coalesce(prio, 'UNKNOWN') as prio, code, odate
    from t, m""")
def fill_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.fill_nulls(cleaning.trim_blank(DIRTY_ORDERS.frame(spark, sf_dir)), rel_error=0.0)


def _near_median(values: DataFrame, column: str, used: float) -> bool:
    """Whether at most the default error, one in a hundred, of the values lies between a number and the median."""
    below, upto = values.agg(F.avg((F.col(column) < used).cast("int")), F.avg((F.col(column) <= used).cast("int"))).first()
    return below - 0.01 <= 0.5 <= upto + 0.01


@query("fill_nulls_default", f"""
    select o_orderkey, o_custkey, price, coalesce(prio, 'UNKNOWN') as prio, code, odate, true as near
    from (select {_TRIMMED} from ({DIRTY_ORDERS.sql()}) d) t""")
def fill_nulls_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the default error; the fills are shown as nulls again, and judged by their rank."""
    dirty = cleaning.trim_blank(DIRTY_ORDERS.frame(spark, sf_dir))
    filled = cleaning.fill_nulls(dirty)
    was_null = F.col("o_orderkey") % 7 == 0
    used = filled.filter(was_null).agg(F.min("price"), F.max("price")).first()
    near = used[0] == used[1] and _near_median(dirty, "price", used[0])
    return filled.withColumn("price", F.when(~was_null, F.col("price"))).withColumn("near", F.lit(near))


@query("clean_default", f"""
    with typed as (
      select o_orderkey, o_custkey, price, nullif(trim(prio), '') as prio, try_cast(nullif(trim(code), '') as double) as code
      from (select distinct * from ({DIRTY_ORDERS.sql()}) d) u)
    select o_orderkey as order_key, o_custkey as cust_key, price as price_eur, coalesce(prio, 'UNKNOWN') as prio, code as code_no,
      'orders' as _source, true as near from typed""")
def clean_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job with its default error; the fills are shown as nulls again, and judged by their rank."""
    cleaned, _ = cleaning.clean(DIRTY_ORDERS.frame(spark, sf_dir).toDF(*RAW_NAMES), "orders")
    fills = {"price_eur": F.col("order_key") % 7 == 0, "code_no": F.col("order_key") % 20 == 0}
    near, shown = True, cleaned.drop("_ingested_at")
    for name, was_null in fills.items():
        used = cleaned.filter(was_null).agg(F.min(name), F.max(name)).first()
        near = near and used[0] == used[1] and _near_median(cleaned.filter(~was_null), name, used[0])
        shown = shown.withColumn(name, F.when(~was_null, F.col(name)))
    return shown.withColumn("near", F.lit(near))


@query("drop_sparse", f"select o_orderkey, o_custkey, price, prio, code from ({DIRTY_ORDERS.sql()}) d")
def drop_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_sparse(DIRTY_ORDERS.frame(spark, sf_dir))


@query("add_metadata", f"select d.*, true as stamped, 'orders' as _source from ({DIRTY_ORDERS.sql()}) d")
def add_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = cleaning.add_metadata(DIRTY_ORDERS.frame(spark, sf_dir), "orders")
    return marked.withColumn("stamped", F.col("_ingested_at").isNotNull()).drop("_ingested_at")
