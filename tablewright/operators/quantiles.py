"""Exact quantiles of many columns at once, with bounded memory everywhere.

``approxQuantile`` with error 0 keeps every value in one summary. Here each
round counts the values of every column in some thousand buckets: a plain
aggregation whose partial results are small in each task and spread over the
cluster by bucket. The bucket that holds the wanted rank becomes the bracket of
the next round. The first round has buckets of equal ratio, which cover all
doubles and leave a bracket whose ends differ by some five percent; the others
have buckets of equal width. So there are at most about six rounds, whatever the
data, and mostly three.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.values import FLOATS

RATIO_BUCKETS, WIDTH_BUCKETS = 65_536, 2048
# Just over the logarithm of the smallest double, sign aside, and of the largest with that added.
SHIFT, SPAN = 746.0, 1460.0


# A sketch of size k misses a rank by under 2.296 / k^0.9723 of the values, 99 times in 100; the sizes it may have.
RANK_ERROR, RANK_POWER = 2.296, 0.9723
SMALLEST_SKETCH, LARGEST_SKETCH = 8, 65_535


def sketch_size(rel_error: float) -> int:
    """The size of a sketch whose ranks are off by at most ``rel_error`` of the values; a third of that is its usual bound."""
    size = math.ceil((3 * RANK_ERROR / rel_error) ** (1 / RANK_POWER))
    return min(LARGEST_SKETCH, max(SMALLEST_SKETCH, size))


def sketched(value: Column, dtype: T.DataType, rel_error: float) -> Column:
    """A mergeable sketch of the ranks of a number's values, as an aggregate; nulls and NaN are left out."""
    return F.kll_sketch_agg_double(_solid(value, dtype), sketch_size(rel_error))


def sketched_quantile(value: Column, dtype: T.DataType, rel_error: float, p: float = 0.5) -> Column:
    """A quantile from such a sketch, as an aggregate: null if there are no values.

    Sketches of tasks are merged, so it needs no pass of its own beside other aggregates. With more values than
    the sketch holds, runs may differ within the error.
    """
    return F.when(F.count(_solid(value, dtype)) > 0, F.kll_sketch_get_quantile_double(sketched(value, dtype, rel_error), F.lit(p)))


def _solid(value: Column, dtype: T.DataType) -> Column:
    number = value.cast("double")
    return F.when(~F.isnan(value), number) if isinstance(dtype, FLOATS) else number


@dataclass
class _Bracket:
    """Ends between which the answer lies, both being values of the column, and its rank inside."""

    low: float
    high: float
    rank: int


def exact_quantiles(df: DataFrame, columns: list[str], p: float = 0.5) -> dict[str, float | None]:
    """The smallest value with at least ``p`` of the non-missing values at or below it.

    Nulls and NaN are left out; a column without values gives ``None``. Values are compared as
    doubles: whole numbers beyond 2^53 come back as the nearest double.
    """
    answers: dict[str, float | None] = dict.fromkeys(columns)
    pending: dict[str, _Bracket | None] = dict.fromkeys(columns)
    while pending:
        found = _narrow(df, pending, p)
        for name, bracket in found.items():
            if bracket.low == bracket.high:
                answers[name] = bracket.low
        pending = {name: b for name, b in found.items() if b.low < b.high}
    return answers


def _ratio_bucket(value: Column) -> Column:
    """Buckets of equal ratio, negative values in mirrored order, zero in one of its own."""
    size = F.least(F.log(F.abs(value)) + SHIFT, F.lit(SPAN))
    place = F.when(value > 0, size).when(value < 0, -size).otherwise(0.0)
    return F.least(F.floor((place + SPAN) / (2 * SPAN) * RATIO_BUCKETS), F.lit(RATIO_BUCKETS - 1))


def _width_bucket(value: Column, b: _Bracket) -> Column:
    """Buckets of equal width; the two ends never share one."""
    return F.least(F.floor((value - F.lit(b.low)) / F.lit(b.high - b.low) * WIDTH_BUCKETS), F.lit(WIDTH_BUCKETS - 1))


def _narrow(df: DataFrame, pending: dict[str, _Bracket | None], p: float) -> dict[str, _Bracket]:
    """One round: the bucket of each column that holds the wanted rank."""
    values, cells = [], []
    for i, (name, b) in enumerate(pending.items()):
        value = col(name).cast("double")
        inside = ~F.isnan(value) if b is None else value.between(b.low, b.high)
        values.append(F.when(inside, value).alias(f"v{i}"))
        v = F.col(f"v{i}")
        bucket = _ratio_bucket(v) if b is None else _width_bucket(v, b)
        cells += [F.lit(i), v, bucket]
    stacked = df.select(*values).select(F.stack(F.lit(len(pending)), *cells).alias("column", "value", "bucket"))
    histogram = (
        stacked.filter(F.col("value").isNotNull())
        .groupBy("column", "bucket")
        .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    buckets = Window.partitionBy("column")
    ranks = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for i, b in enumerate(pending.values()):
        first = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(p) * F.col("total")))
        ranks = ranks.when(F.col("column") == i, first if b is None else F.lit(b.rank).cast("bigint"))
    chosen = (
        histogram
        .withColumns({
            "upto": F.sum("n").over(buckets.orderBy("bucket")),
            "total": F.sum("n").over(buckets),
        })
        .withColumn("rank", ranks)
        .filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("column", "low", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )
    names = list(pending)
    return {names[r["column"]]: _Bracket(r["low"], r["high"], r["rank"]) for r in chosen.collect()}
