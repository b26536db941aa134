"""Profiling: nulls, distinct values, samples, duplicates, issues, quality score.

Results are small tables (one row per column, or one row). One-row results are
put together by a union and an aggregate, never by a cross join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.values import NESTED, byte_width, group_key, lane_key, present

# The texts of the findings, and that of a report without any.
NULLS_FOUND = (" null values across ", " columns")
DUPLICATES_FOUND = " duplicate rows"
MOSTLY_NULL = "Column '{}' has >50% nulls — consider dropping"
NO_ISSUES = "No major issues found ✅"

SKETCH_GROUPS = 256
BOUND_GROUPS = 64


def _per_column(one_row: DataFrame, fields: list[T.StructField], measures: dict[str, str]) -> DataFrame:
    """Turn one row of ``<measure><position>`` columns into a row per column."""
    return one_row.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            *[F.col(f"{prefix}{i}").alias(alias) for prefix, alias in measures.items()],
        )
        for i, f in enumerate(fields)
    ])))


def _merge_rows(parts: Iterable[DataFrame]) -> DataFrame:
    """One row out of one-row tables with different columns."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.first(col(c), ignorenulls=True).alias(c) for c in rows.columns])


def _null_pct(nulls: Column, rows: Column) -> Column:
    return F.round(nulls * 100 / F.nullif(rows, F.lit(0)), 2)


def profile_nulls(df: DataFrame) -> DataFrame:
    """Nulls and null percent per column, NaN included (P1). One scan."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count(present(col(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(fields)],
    )
    nulls = counts.select(*[(F.col("rows") - F.col(f"n{i}")).alias(f"n{i}") for i in range(len(fields))],
                          *[_null_pct(F.col("rows") - F.col(f"n{i}"), F.col("rows")).alias(f"p{i}")
                            for i in range(len(fields))])
    return _per_column(nulls, fields, {"n": "nulls", "p": "null_pct"})


def profile_types(df: DataFrame) -> DataFrame:
    """Position, name and type of each column."""
    return df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"))
        for i, f in enumerate(df.schema.fields)])))


def _of_position(values: str, i: int, default: Column) -> Column:
    """The value of a column in a map from positions."""
    return F.coalesce(F.try_element_at(values, F.lit(i)), default)


def _by_position(rows: DataFrame, value: str) -> Column:
    """Rows (position, value), at most one for each column, as one map."""
    return F.map_from_entries(F.collect_list(F.struct("position", value))).alias(value)


def profile_distinct(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """Distinct non-missing values per column.

    Exact: the columns are stacked and grouped once, so no row is copied per
    aggregate and a hot value collapses on the map side. With ``rsd`` sketches of
    about that standard error, in one scan and without a shuffle of values.
    """
    fields = df.schema.fields
    if rsd is not None:
        return _per_column(distinct_estimates(df, rsd), fields, {"d": "distinct_values"})
    counted = _distinct_counts(df)
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), _of_position("distinct_values", i, F.lit(0)).alias("distinct_values"))
        for i, f in enumerate(fields)])))


def _distinct_counts(df: DataFrame) -> DataFrame:
    """One row: distinct values by position, without columns that have none."""
    counted = _distinct_values(df).groupBy("position").agg(F.count("*").alias("distinct_values"))
    return counted.agg(_by_position(counted, "distinct_values"))


def distinct_estimates(df: DataFrame, rsd: float = 0.05) -> DataFrame:
    """One row with the estimated distinct values of each column as ``d<position>``.

    Sketches meet in two steps, so that no task merges one from every other task.
    """
    size = min(max(math.ceil(math.log2((1.04 / rsd) ** 2)), 4), 21)
    keys = [lane_key(col(f.name), f.dataType) for f in df.schema.fields]
    prepared = df.select(
        F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("salt"),
        *[(key if lane in ("bigint", "string") else (key + 0.0 if lane == "double" else key).cast("string"))
          .alias(f"v{i}") for i, (lane, key) in enumerate(keys)])
    numbers = range(len(keys))
    partial = prepared.groupBy("salt").agg(*[F.hll_sketch_agg(f"v{i}", size).alias(f"s{i}") for i in numbers])
    return partial.agg(*[
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"s{i}")), F.lit(0)).alias(f"d{i}") for i in numbers])


def _stacked(df: DataFrame, lanes_of: list[tuple[str, Column]], *keep: Column) -> tuple[DataFrame, list[str]]:
    """Rows ``(kept columns, position, lanes)``, and the names of the lanes.

    There is a lane per type, given with each column's expression; a row has a value
    in one lane. Missing values have no row.
    """
    lanes = list(dict.fromkeys(lane for lane, _ in lanes_of))
    kept = [f"k{i}" for i in range(len(keep))]
    prepared = df.select(*[c.alias(k) for c, k in zip(keep, kept)],
                         *[value.alias(f"v{i}") for i, (_, value) in enumerate(lanes_of)])
    cells: list[Column] = []
    for i, (lane, _) in enumerate(lanes_of):
        cells.append(F.lit(i))
        cells += [F.col(f"v{i}") if lane == other else F.lit(None).cast(other) for other in lanes]
    names = [f"lane{j}" for j in range(len(lanes))]
    stacked = prepared.select(*kept, F.stack(F.lit(len(lanes_of)), *cells).alias("position", *names))
    return stacked.filter(F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in names])), names


def _distinct_values(df: DataFrame) -> DataFrame:
    """Distinct ``(position, lanes)``."""
    return _stacked(df, [lane_key(col(f.name), f.dataType) for f in df.schema.fields])[0].distinct()


def _sample_lane(f: T.StructField) -> tuple[str, Column]:
    if isinstance(f.dataType, (*NESTED, T.BinaryType)):
        return "string", col(f.name).cast("string")
    return f.dataType.simpleString(), present(col(f.name), f.dataType)


def _key_bounds(df: DataFrame, order_by: str, n: int) -> list[Column | None]:
    """For each column a key that at least ``n`` of its rows do not exceed, if there is one.

    Rows fall into groups at random; ``n`` groups have ``n`` different smallest rows,
    so the ``n``-th smallest of the group minima is such a key. A plain aggregation.
    """
    fields, key_type = df.schema.fields, df.schema[order_by].dataType
    # a moment goes through the driver as its microseconds, free of any time zone
    is_moment = isinstance(key_type, T.TimestampType)
    plain = F.unix_micros if is_moment else lambda c: c
    keyed = df.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(max(BOUND_GROUPS, 2 * n))).alias("g"),
        *[F.when(present(col(f.name), f.dataType).isNotNull(), col(order_by)).alias(f"k{i}")
          for i, f in enumerate(fields)])
    smallest = keyed.groupBy("g").agg(*[F.min(f"k{i}").alias(f"k{i}") for i in range(len(fields))])
    bounds = smallest.agg(*[
        plain(F.get(F.array_sort(F.collect_list(f"k{i}")), F.lit(n - 1))).cast("string").alias(f"k{i}")
        for i in range(len(fields))]).first()
    typed = (lambda b: F.timestamp_micros(F.lit(int(b)))) if is_moment else lambda b: F.lit(b).cast(key_type)
    return [None if bound is None else typed(bound) for bound in bounds]


def profile_samples(df: DataFrame, order_by: str, n: int = 3) -> DataFrame:
    """The first ``n`` non-missing values per column as text, in key order.

    A first scan bounds the keys that can matter, so that hardly a row is left to
    sort. Of those each task keeps ``n`` per column, and only these become text.
    """
    fields = df.schema.fields
    return _samples(df, order_by, n).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), _of_position("sample", i, _NO_SAMPLE()).alias("sample"))
        for i, f in enumerate(fields)])))


def _NO_SAMPLE() -> Column:
    return F.array().cast("array<string>")


def _samples(df: DataFrame, order_by: str, n: int = 3) -> DataFrame:
    """One row: samples by position, without columns that have none."""
    key = col(order_by)
    bounds = _key_bounds(df, order_by, n)
    known = [b for b in bounds if b is not None]
    wanted = key.isNull()
    if known:
        wanted = wanted | (key <= (F.greatest(*known) if len(known) > 1 else known[0]))
    for f, bound in zip(df.schema.fields, bounds):
        if bound is None:  # hardly a row has a value
            wanted = wanted | col(f.name).isNotNull()
    df = df.filter(wanted)
    lanes_of = [
        (lane, value if bound is None else F.when((key <= bound) | key.isNull(), value))
        for (lane, value), bound in zip(map(_sample_lane, df.schema.fields), bounds)
    ]
    long, lanes = _stacked(df, lanes_of, key)
    first = Window.partitionBy("position").orderBy("k0", *lanes)
    ranked = (
        long.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
        .select("position", "rank", F.coalesce(*[F.col(lane).cast("string") for lane in lanes]).alias("value"))
    )
    collected = ranked.groupBy("position").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"])
        .alias("sample"))
    return collected.agg(_by_position(collected, "sample"))


def _row_width(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [byte_width(col(f.name), f.dataType) for f in df.schema.fields])


def _facts(df: DataFrame, sized: bool = False) -> DataFrame:
    """One row: rows, duplicate rows, and nulls per column as ``n<position>``.

    One grouping by all columns yields all of it: copies of a row meet on the map
    side, long text travels as a digest, and a null key is a null value. ``sized``
    adds ``bytes``: equal rows have one width, so the width can be a key as well.
    """
    fields = df.schema.fields
    keys = {f"k{i}": group_key(col(f.name), f.dataType) for i, f in enumerate(fields)}
    if sized:
        keys["width"] = _row_width(df)
    groups = df.select(*[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.count("*").alias("copies"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return groups.agg(
        total(F.col("copies")).alias("rows"),
        total(F.col("copies") - 1).alias("duplicate_rows"),
        *([total(F.col("copies") * F.col("width")).alias("bytes")] if sized else []),
        *[total(F.when(F.col(f"k{i}").isNull(), F.col("copies")).otherwise(0)).alias(f"n{i}")
          for i in range(len(fields))],
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows and how many of them repeat another row (P6). Nulls and NaN equal themselves."""
    return _facts(df).select("rows", "duplicate_rows")


def profile_null_totals(df: DataFrame) -> DataFrame:
    """Nulls in all, and how many columns have any (P5)."""
    return profile_nulls(df).agg(
        F.sum("nulls").alias("total_nulls"),
        F.count_if(F.col("nulls") > 0).alias("null_columns"),
    )


def _null_sums(width: int) -> tuple[Column, Column]:
    nulls = [F.col(f"n{i}") for i in range(width)]
    total = reduce(lambda a, b: a + b, nulls)
    columns = reduce(lambda a, b: a + b, [F.when(n > 0, 1).otherwise(0) for n in nulls])
    return total, columns


def _issue_list(fields: list[T.StructField]) -> Column:
    total, columns = _null_sums(len(fields))
    rows, duplicates = F.col("rows"), F.col("duplicate_rows")
    findings = F.array_compact(F.array(
        F.when(total > 0, F.concat(total.cast("string"), F.lit(NULLS_FOUND[0]),
                                   columns.cast("string"), F.lit(NULLS_FOUND[1]))),
        F.when(duplicates > 0, F.concat(duplicates.cast("string"), F.lit(DUPLICATES_FOUND))),
        *[F.when(F.col(f"n{i}") * 2 > rows, F.lit(MOSTLY_NULL.format(f.name)))
          for i, f in enumerate(fields)],
    ))
    return F.when(F.size(findings) > 0, findings).otherwise(F.array(F.lit(NO_ISSUES)))


def issues(df: DataFrame) -> DataFrame:
    """Findings in order: nulls, duplicates, columns over half null; else one line."""
    return _facts(df).select(F.posexplode(_issue_list(df.schema.fields)).alias("position", "issue"))


def _score(width: int) -> Column:
    total, _ = _null_sums(width)
    cells = F.greatest(F.col("rows") * width, F.lit(1))
    rows = F.greatest(F.col("rows"), F.lit(1))
    return F.greatest(
        F.lit(0.0), F.round(100 - total / cells * 50 - F.col("duplicate_rows") / rows * 30, 1))


def quality_score(df: DataFrame) -> DataFrame:
    """100 less up to 50 for nulls and up to 30 for duplicates, one decimal."""
    return _facts(df).select(_score(len(df.columns)).alias("quality_score"))


def size_report(df: DataFrame) -> DataFrame:
    """Rows, columns, and the size of the values in bytes and MB (P9). One scan."""
    sized = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(_row_width(df)), F.lit(0)).alias("bytes"))
    return sized.select("rows", F.lit(len(df.columns)).alias("columns"), "bytes", _megabytes().alias("memory_mb"))


def _megabytes() -> Column:
    return F.round(F.col("bytes") / 1024 / 1024, 2)


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """``n`` rows; the first by ``order_by`` where given, else any (P10)."""
    return (df.orderBy(col(order_by)) if order_by else df).limit(n)


def profile(df: DataFrame, order_by: str, file: str | None = None) -> DataFrame:
    """The whole report in one nested row.

    The grouping by all columns runs once: the summary and the nulls per column
    read the same shuffle.
    """
    fields = df.schema.fields
    facts = _facts(df, sized=True)
    summary = facts.select(
        F.lit(file).alias("file"),
        "rows",
        F.lit(len(fields)).alias("columns"),
        _megabytes().alias("memory_mb"),
        _issue_list(fields).alias("issues"),
        _score(len(fields)).alias("quality_score"),
        F.lit([f.name for f in fields]).alias("column_names"),
        F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())]).alias("dtypes"),
        *[f"n{i}" for i in range(len(fields))],
    )
    top = preview(df, order_by=order_by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(col(order_by).alias("k"), F.struct(*map(col, df.columns)).alias("r")))),
            lambda s: s["r"]).alias("preview"))
    schema = F.array(*[
        F.struct(
            F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("nulls"),
            _null_pct(F.col(f"n{i}"), F.col("rows")).alias("null_pct"), _of_position("distinct_values", i, F.lit(0)).alias("unique"),
            _of_position("sample", i, _NO_SAMPLE()).alias("sample"))
        for i, f in enumerate(fields)])
    return _merge_rows([summary, _distinct_counts(df), _samples(df, order_by), top]).select(
        "file", "rows", "columns", "memory_mb", schema.alias("schema"), "issues", "quality_score",
        "column_names", "dtypes", "preview")
