"""Excel workbooks (.xlsx): first sheet, header row, a folder of files in parallel."""

from __future__ import annotations

import datetime as dt
import decimal
import io
import re
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col

# Tasks get the functions of this module with their code, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS_PER_BATCH = 5000
# Built-in number formats that show a date or time, and the days serial dates count from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH_1900, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _text(element) -> str:
    """Text of a string item without its phonetic hints."""
    if element is None:
        return ""
    parts = [t.text or "" for t in element.findall(f"{MAIN}t")]
    parts += [t.text or "" for run in element.findall(f"{MAIN}r") for t in run.findall(f"{MAIN}t")]
    return "".join(parts)


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_text(item) for item in root.findall(f"{MAIN}si")]


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, dt.datetime]:
    """Path of the first sheet, and the day its serial dates count from."""
    workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
    properties = workbook.find(f"{MAIN}workbookPr")
    since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
    relation = workbook.find(f"{MAIN}sheets/{MAIN}sheet").get(RELATION)
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == relation)
    path = target.lstrip("/") if target.startswith("/") else "xl/" + target
    return path, EPOCH_1904 if since_1904 else EPOCH_1900


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for custom in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", custom.get("formatCode", ""))
        if re.search("[dmyhs]", code, re.IGNORECASE) and "General" not in code:
            dates.add(int(custom.get("numFmtId")))
    styles = root.findall(f"{MAIN}cellXfs/{MAIN}xf")
    return {i for i, style in enumerate(styles) if int(style.get("numFmtId", 0)) in dates}


def _moment(serial: float, epoch: dt.datetime) -> dt.datetime:
    return epoch + dt.timedelta(milliseconds=round(serial * 86_400_000))


def _cell(cell, shared: list[str], dates: set[int], epoch: dt.datetime):
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return _text(cell.find(f"{MAIN}is"))
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return value == "1"
    if kind in ("str", "d"):
        return value
    if int(cell.get("s", 0)) in dates:
        return _moment(float(value), epoch)
    return float(value) if re.search(r"[.eE]", value) else int(value)


def sheet_rows(content: bytes) -> Iterator[tuple[list, dt.datetime]]:
    """Rows of the first sheet as lists of values, read piece by piece."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, epoch = _first_sheet(book)
        shared, dates = _shared_strings(book), _date_styles(book)
        with book.open(path) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                values: list = []
                for position, cell in enumerate(row.findall(f"{MAIN}c")):
                    reference = cell.get("r")
                    index = _column_index(reference) if reference else len(values)
                    values += [None] * (index + 1 - len(values))
                    values[index] = _cell(cell, shared, dates, epoch)
                yield values, epoch
                row.clear()


def _convert(value, dtype: T.DataType, epoch: dt.datetime):
    """A cell as the wanted type; a value that does not fit becomes null."""
    if value is None:
        return None
    try:
        if isinstance(dtype, T.StringType):
            if isinstance(value, dt.datetime) and value.time() == dt.time():
                value = value.date()
            return str(value) if not isinstance(value, bool) else str(value).lower()
        if isinstance(dtype, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(
                str(value).strip().lower())
        if isinstance(dtype, T.IntegralType):
            return int(value) if float(value) == int(float(value)) else None
        if isinstance(dtype, T.DecimalType):
            return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-dtype.scale))
        if isinstance(dtype, T.FractionalType):
            return float(value)
        if isinstance(value, dt.datetime):
            moment = value
        else:
            moment = dt.datetime.fromisoformat(value) if isinstance(value, str) else _moment(float(value), epoch)
        return moment.date() if isinstance(dtype, T.DateType) else moment
    except (ValueError, TypeError, OverflowError, decimal.InvalidOperation):
        return None


def _data_rows(content: bytes) -> Iterator[tuple[list[str], list, dt.datetime]]:
    header: list[str] | None = None
    for values, epoch in sheet_rows(content):
        if header is None:
            header = ["" if v is None else str(v) for v in values]
        elif any(v is not None for v in values):
            yield header, values, epoch


def parse_workbooks(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of workbooks held in a binary column ``content``; columns go by header name."""
    names, types = schema.names, [f.dataType for f in schema.fields]
    moments = [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        values = pd.DataFrame(rows, columns=names, dtype=object)
        return values.assign(**{n: pd.to_datetime(values[n]) for n in moments})

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for content in batch["content"]:
                positions = None
                for header, values, epoch in _data_rows(content):
                    if positions is None:
                        positions = [header.index(n) if n in header else -1 for n in names]
                    rows.append(tuple(
                        _convert(values[p] if 0 <= p < len(values) else None, t, epoch)
                        for p, t in zip(positions, types)))
                    if len(rows) >= ROWS_PER_BATCH:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    return files.select("content").mapInPandas(parse, schema)


def _headers(files: DataFrame) -> DataFrame:
    def first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                header = next(sheet_rows(content), ([], None))[0]
                yield pd.DataFrame({"position": range(len(header)),
                                    "name": ["" if v is None else str(v) for v in header]})

    return files.select("content").mapInPandas(first_rows, "position int, name string")


# Types a text column may get, in order, and what all its values must look like.
INFERRED = {
    "int": None, "bigint": None, "double": None, "boolean": "(?i)^(true|false)$",
    "date": r"^\d{4}-\d\d-\d\d$", "timestamp": r"^\d{4}-\d\d-\d\d([ T]\d\d:\d\d.*)?$",
}


def _fits(c: Column, dtype: str) -> Column:
    bad = c.try_cast(dtype).isNull()
    if INFERRED[dtype] is not None:
        bad = bad | ~c.rlike(INFERRED[dtype])
    return F.count_if(c.isNotNull() & bad) == 0


def infer_types(texts: DataFrame) -> DataFrame:
    """Give all-text columns the first of ``INFERRED`` that fits all values. One scan."""
    checks = []
    for i, name in enumerate(texts.columns):
        choice = F.when(F.count(col(name)) == 0, "string")
        for dtype in INFERRED:
            choice = choice.when(_fits(col(name), dtype), dtype)
        checks.append(choice.otherwise("string").alias(f"t{i}"))
    types = texts.agg(*checks).first()
    return texts.select(*[col(c).cast(types[i]).alias(c) for i, c in enumerate(texts.columns)])


def read_xlsx(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Workbooks of a file or folder (S4), one task per group of files.

    Without a schema, the columns are those of all the headers, and the types are
    inferred from the values in an extra pass.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    if schema is not None:
        return parse_workbooks(files, schema)
    named = _headers(files).filter("name <> ''").groupBy("name").agg(F.min("position").alias("position"))
    names = [r["name"] for r in named.orderBy("position", "name").collect()]
    texts = parse_workbooks(files, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return infer_types(texts)
