"""Typed ingest: every column becomes long, double, boolean or string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean_names, col
from ..functions.values import FLOATS

# Texts that stand for a missing value.
MISSING_TEXTS = ("nan", "None", "NaT", "<NA>", "")
# Texts of a file that stand for a missing value.
FILE_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _ingested(f: T.StructField) -> Column:
    c = col(f.name)
    if isinstance(f.dataType, T.IntegralType):
        value = F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    elif isinstance(f.dataType, FLOATS):
        value = F.coalesce(F.when(~F.isnan(c), c.cast("double")), F.lit(0.0))
    elif isinstance(f.dataType, T.BooleanType):
        value = F.coalesce(c, F.lit(False))
    else:
        text = c.cast("string")
        value = F.when(~text.isin(*MISSING_TEXTS), text)
    return value.alias(f.name)


def ingest_typed(df: DataFrame) -> DataFrame:
    """Clean the names, keep the first of equal names, and fix types and nulls.

    Integers become long with null as 0, floats double with null and NaN as 0.0,
    a null boolean is false; all else is text, with missing marks and empty text
    as null. One projection, no shuffle.
    """
    named = clean_names(df, on_collision="first")
    return named.select(*[_ingested(f) for f in named.schema.fields])


def without_marks(df: DataFrame) -> DataFrame:
    """Texts that mark a missing value become null.

    A text column that then holds numbers only becomes double, as it would have
    been without the marks. One pass counts; none if there are no text columns.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    bare = df.select(*[
        F.when(~col(n).isin(*FILE_MARKS), col(n)).alias(n) if n in texts else col(n) for n in df.columns])
    number = lambda n: col(n).try_cast("double")
    found = bare.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(texts) for k, f in (
        ("all", lambda n: F.count(col(n))), ("num", lambda n: F.count(number(n))), ("marks", lambda n: F.count(F.lit(1)) - F.count(col(n))))]).first()
    numeric = {n for i, n in enumerate(texts) if found[f"marks{i}"] and found[f"all{i}"] and found[f"all{i}"] == found[f"num{i}"]}
    return bare.select(*[number(n).alias(n) if n in numeric else col(n) for n in df.columns])
