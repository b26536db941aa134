"""Registry of loads: one record per job, read, updated by key, and listed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import col

# The fields of a record and the format of its time.
REGISTRY_SCHEMA = (
    "dag_id string, table_name string, full_table string, warehouse string, hdfs_path string, "
    "row_count bigint, dag_file string, source string, created_at string"
)
TIME_FORMAT = "yyyy-MM-dd HH:mm"
PLACE = "place"


def read_registry(spark: SparkSession, path: str, schema: str = REGISTRY_SCHEMA) -> DataFrame:
    """Records from a JSON array; a missing file gives an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert(df: DataFrame, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """Newest record per key; an update wins over a stored record.

    ``place`` is the first order value ever seen for the key: a replaced record
    keeps its place, and a new key comes first when places go in falling order.
    One aggregate; a key with many records collapses before the shuffle.
    """
    columns = [c for c in df.columns if c != PLACE]
    both = df.withColumn("__update", F.lit(False)).unionByName(
        updates.withColumn("__update", F.lit(True)), allowMissingColumns=True)
    place = F.coalesce(col(PLACE), col(order_col)) if PLACE in both.columns else col(order_col)
    newest = both.groupBy(col(key)).agg(
        F.max_by(F.struct(*[col(c) for c in columns]), F.struct("__update", col(order_col))).alias("__r"),
        F.min(place).alias(PLACE),
    )
    return newest.select(*[F.col("__r").getField(c).alias(c) for c in columns], PLACE)


def list_registry(df: DataFrame, order_by: str = "created_at", key: str = "dag_id") -> DataFrame:
    """Records as shown to people: grouped digits, parsed time, newest first.

    Records of one time go by key, which also lets a busy minute spread over tasks.
    """
    shown = df.withColumns({
        "row_count": F.concat(F.format_number(col("row_count"), 0), F.lit(" rows")),
        "created_at": F.try_to_timestamp(col("created_at"), F.lit(TIME_FORMAT)),
    })
    return shown.orderBy(col(order_by).desc(), col(key))
