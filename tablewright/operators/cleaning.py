"""Cleaning: names, empty rows, duplicates, blanks, types, fills, sparse columns.

The steps have a fixed order and each has its own function. Points to know:

- Duplicates go **before** trimming, so rows that become equal by trimming both
  stay; a row of blanks only is not empty yet when empty rows go.
- Sparse columns go **after** filling, so a column of a filled type is never
  sparse. Only boolean, date, timestamp, decimal, short, byte, binary and nested
  columns can be dropped. An all-null int column becomes all 0.
- Up to 10 % of unparsable text in a cast column becomes null and then the
  median. The log names every cast column.
- ``isNull`` does not see NaN, but a fill of a float column replaces NaN too: NaN
  is filled only in columns that also hold a null.
- The median of an int column is cut to int. ``trim`` takes spaces, not tabs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import clean_names, col
from ..functions.values import FLOATS
from .quantiles import exact_quantiles, sketched_quantile
from .staging import scratch_dir, stage

# The types that get a median, and the text for missing strings.
MEDIAN_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
MISSING_TEXT = "UNKNOWN"


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


# What a number can start and end with, and what the cast skips around it.
NUMBER_STARTS = list("0123456789+-.nNiI")
NUMBER_ENDS = list("0123456789.dDfFnNyY")
SKIPPED = "".join(map(chr, range(33)))


def _as_number(c: Column) -> Column:
    """The text as a double, or null.

    A failed cast costs an exception that holds the whole text, so the ends of the
    text are looked at first: they rule out most words and all prose.
    """
    text = F.btrim(c, F.lit(SKIPPED))
    likely = F.left(text, F.lit(1)).isin(NUMBER_STARTS) & F.right(text, F.lit(1)).isin(NUMBER_ENDS)
    return F.when(likely, c.try_cast("double"))


def _count_columns(counts: dict[str, Column]) -> tuple[list[Column], dict[str, str]]:
    """Aliases that survive any column name."""
    aliases = {key: f"a{i}" for i, key in enumerate(counts)}
    return [counts[key].alias(aliases[key]) for key in counts], aliases


def _aggregate(df: DataFrame, measures: dict[str, Column]) -> dict:
    columns, aliases = _count_columns(measures)
    row = df.agg(*columns).first()
    return {key: row[aliases[key]] for key in measures}


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is missing."""
    return df.dropna(how="all")


def dedupe(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (C3). Copies meet on the map side first."""
    return df.dropDuplicates()


def trim_blank(df: DataFrame) -> DataFrame:
    """Trim strings, then turn empty strings into null (C4)."""
    return df.select(*[
        F.nullif(F.trim(col(f.name)), F.lit("")).alias(f.name) if _is_text(f) else col(f.name)
        for f in df.schema.fields
    ])


def _numeric_text(values: dict[str, tuple[int, int]], threshold: float) -> list[str]:
    return [name for name, (filled, parsed) in values.items() if filled and parsed / filled > threshold]


def numeric_text_columns(df: DataFrame, threshold: float = 0.9) -> list[str]:
    """String columns of which more than ``threshold`` of the values are numbers."""
    texts = [f.name for f in df.schema.fields if _is_text(f)]
    if not texts:
        return []
    measures = {}
    for name in texts:
        measures[name, "filled"] = F.count(col(name))
        measures[name, "parsed"] = F.count(_as_number(col(name)))
    found = _aggregate(df, measures)
    return _numeric_text({n: (found[n, "filled"], found[n, "parsed"]) for n in texts}, threshold)


def infer_numeric(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Cast mostly numeric string columns to double; the rest becomes null."""
    casts = set(numeric_text_columns(df, threshold))
    return df.select(*[_as_number(col(c)).alias(c) if c in casts else col(c) for c in df.columns])


def medians(df: DataFrame, columns: list[str], rel_error: float) -> dict[str, float]:
    """Median per column in one call; 0.0 for a column without values."""
    if not columns:
        return {}
    if rel_error > 0:
        found = _aggregate(df, {c: sketched_quantile(col(c), df.schema[c].dataType, rel_error) for c in columns})
    else:
        found = exact_quantiles(df, columns)
    return {c: 0.0 if found[c] is None else found[c] for c in columns}


def _medians_found(found: dict, columns: list[str]) -> dict[str, float]:
    return {c: 0.0 if found[c, "median"] is None else found[c, "median"] for c in columns}


def _filled(c: Column, dtype: T.DataType, value: float | str) -> Column:
    if isinstance(dtype, FLOATS):
        c = F.when(~F.isnan(c), c)
    return F.coalesce(c, F.lit(value).cast(dtype))


def fill_nulls(df: DataFrame, rel_error: float = 0.01) -> DataFrame:
    """Fill numbers with the median and strings with ``UNKNOWN``.

    One scan counts the nulls and sketches the medians. ``rel_error`` 0 gives the exact
    median, in a few more scans of the columns that hold nulls. Columns of other types,
    and columns without nulls, stay as is.
    """
    fillable = [f for f in df.schema.fields if _is_text(f) or isinstance(f.dataType, MEDIAN_TYPES)]
    if not fillable:
        return df
    measures: dict = {f.name: F.count_if(col(f.name).isNull()) for f in fillable}
    if rel_error > 0:
        measures |= {(f.name, "median"): sketched_quantile(col(f.name), f.dataType, rel_error) for f in fillable if not _is_text(f)}
    found = _aggregate(df, measures)
    holes = {f.name: f.dataType for f in fillable if found[f.name]}
    numbers = [name for name, dtype in holes.items() if not isinstance(dtype, T.StringType)]
    values = _medians_found(found, numbers) if rel_error > 0 else medians(df, numbers, 0.0)
    return df.select(*[
        _filled(col(c), holes[c], values.get(c, MISSING_TEXT)).alias(c) if c in holes else col(c)
        for c in df.columns
    ])


def drop_sparse(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Drop columns of which more than ``threshold`` is null."""
    nulls = _aggregate(df, {
        None: F.count("*"), **{c: F.count_if(col(c).isNull()) for c in df.columns},
    })
    rows = max(nulls[None], 1)
    return df.select(*[col(c) for c in df.columns if nulls[c] / rows <= threshold])


def add_metadata(df: DataFrame, source: str) -> DataFrame:
    """Add ``_ingested_at`` and ``_source``."""
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source": F.lit(source)})


def clean(
    df: DataFrame,
    source: str,
    *,
    numeric_threshold: float = 0.9,
    rel_error: float = 0.01,
    sparse_threshold: float = 0.7,
    on_collision: str = "error",
    staging_path: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """All eight steps in order, with a log line each.

    One shuffle and one staged Parquet copy, whatever the number of columns:

    1. Group by all columns and count the copies. The count carries the rows lost
       to empty rows and duplicates, exact under task retries.
    2. One aggregation of the staged copy counts values, numbers and nulls, and
       sketches the medians; ``rel_error`` 0 adds scans for exact ones.
    3. One projection casts, fills, drops and adds the metadata.

    The result reads the staged copy, at ``staging_path`` or under the scratch
    folder; the caller may remove it once the result is written.
    """
    log: list[str] = []
    named = clean_names(df, on_collision)
    log.append("names: cleaned")

    void = [f.name for f in named.schema.fields if isinstance(f.dataType, T.NullType)]
    solid = [f for f in named.schema.fields if f.name not in void]
    names = [f.name for f in solid]
    missing = F.lit(True)
    for f in solid:
        gone = col(f.name).isNull()
        missing = missing & (gone | F.isnan(col(f.name)) if isinstance(f.dataType, FLOATS) else gone)
    copies, empty = "__copies", "__empty"
    staging_path = staging_path or scratch_dir(df.sparkSession)
    grouped = named.groupBy(*[col(n) for n in names]).agg(F.count("*").alias(copies))
    trimmed = grouped.select(
        *[
            F.nullif(F.trim(col(f.name)), F.lit("")).alias(f.name) if _is_text(f) else col(f.name)
            for f in solid
        ],
        F.col(copies),
        missing.alias(empty),
    )
    staged = stage(trimmed, staging_path)

    measures: dict = {
        "read": F.sum(copies),
        "empty": F.sum(F.when(F.col(empty), F.col(copies))),
        "kept": F.count_if(~F.col(empty)),
    }
    for f in solid:
        value = F.when(~F.col(empty), col(f.name))
        measures[f.name, "filled"] = F.count(value)
        if _is_text(f):
            measures[f.name, "parsed"] = F.count(_as_number(value))
        if rel_error > 0 and (_is_text(f) or isinstance(f.dataType, MEDIAN_TYPES)):
            number, dtype = (_as_number(value), T.DoubleType()) if _is_text(f) else (value, f.dataType)
            measures[f.name, "median"] = sketched_quantile(number, dtype, rel_error)
    found = _aggregate(staged, measures)
    rows = found["kept"]
    dropped_empty = found["empty"] or 0
    log.append(f"empty rows: {dropped_empty} left out")
    log.append(f"copies of rows: {(found['read'] or 0) - dropped_empty - rows} left out")
    log.append("texts: trimmed, blank ones made null")

    casts = set(_numeric_text(
        {f.name: (found[f.name, "filled"], found[f.name, "parsed"]) for f in solid if _is_text(f)},
        numeric_threshold,
    ))
    live = staged.filter(~F.col(empty)).select(*[
        _as_number(col(n)).alias(n) if n in casts else col(n) for n in names
    ])
    log += [f"numbers in text: {n} is double now" for n in names if n in casts]

    nulls = {n: rows - found[n, "parsed" if n in casts else "filled"] for n in names}
    holes = {
        f.name: f.dataType for f in live.schema.fields
        if nulls[f.name] and (_is_text(f) or isinstance(f.dataType, MEDIAN_TYPES))
    }
    numbers = [n for n, dtype in holes.items() if not isinstance(dtype, T.StringType)]
    values: dict[str, float | str] = dict(_medians_found(found, numbers) if rel_error > 0 else medians(live, numbers, 0.0))
    for n in holes:
        values.setdefault(n, MISSING_TEXT)
        what = f"median {values[n]}" if n in numbers else MISSING_TEXT
        log.append(f"missing values: {nulls[n]} of {n} are {what} now")

    sparse = [n for n in names if n not in holes and nulls[n] / max(rows, 1) > sparse_threshold]
    lost = sparse + (void if rows else [])
    log.append(f"sparse columns: {', '.join(lost) or 'none'} left out")

    result = live.select(*[
        F.lit(None).alias(n) if n in void
        else _filled(col(n), holes[n], values[n]).alias(n) if n in holes
        else col(n)
        for n in named.columns if n not in lost
    ])
    log.append("metadata: time and source added")
    return add_metadata(result, source), log
