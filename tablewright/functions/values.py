"""What counts as missing, and keys that make equal values group together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)

# Byte width of one stored value, for types whose values all have one width.
FIXED_WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8,
    "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}

LONG_TEXT = 64

NESTED = (T.ArrayType, T.MapType, T.StructType)


def present(c: Column, dtype: T.DataType) -> Column:
    """The value, with NaN turned into null so that both count as missing."""
    if isinstance(dtype, FLOATS):
        return F.when(~F.isnan(c), c)
    return c


def _short(text: Column) -> Column:
    return F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def group_key(c: Column, dtype: T.DataType) -> Column:
    """A short grouping key, equal exactly when the values are equal.

    Text longer than 64 bytes travels through the shuffle as a SHA-256 digest.
    The digest carries a ``#`` and is 65 bytes long, so it can never equal a
    value that was short enough to stay as it is. Nested values become JSON, with
    the entries of a map in order.
    """
    if isinstance(dtype, T.StringType):
        return _short(c)
    if isinstance(dtype, T.BinaryType):
        return F.sha2(c, 256)
    if isinstance(dtype, T.MapType):
        return _short(F.to_json(F.array_sort(F.map_entries(c))))
    if isinstance(dtype, NESTED):
        return _short(F.to_json(c))
    return present(c, dtype)


def lane_key(c: Column, dtype: T.DataType) -> tuple[str, Column]:
    """``group_key`` in the widest type of its family, and the name of that type.

    Columns of one family share a lane, so that values of many columns can stand
    in few columns without being turned into text.
    """
    key = group_key(c, dtype)
    if isinstance(dtype, T.IntegralType):
        return "bigint", key.cast("bigint")
    if isinstance(dtype, FLOATS):
        return "double", key.cast("double")
    if isinstance(dtype, (T.BinaryType, *NESTED)):
        return "string", key
    return dtype.simpleString(), key


def byte_width(c: Column, dtype: T.DataType) -> Column:
    """Bytes the value takes; missing values take none."""
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        width = F.octet_length(c)
    elif isinstance(dtype, T.DecimalType):
        width = F.lit(8 if dtype.precision <= 18 else 16)
    elif dtype.simpleString() in FIXED_WIDTHS:
        width = F.lit(FIXED_WIDTHS[dtype.simpleString()])
    else:
        width = F.octet_length(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), width), F.lit(0)).cast("bigint")
