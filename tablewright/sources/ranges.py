"""CSV with line breaks inside quotes, and JSON documents, read by many tasks for each file.

Spark's text reader cuts a file into ranges of bytes and gives each range's pieces: lines of a CSV file,
or what lies between closing braces of a JSON document. Whether a piece ends a record depends on all
before it, through a small state: in quotes or not, and for JSON the depth. So each range is scanned
once for every mode in which it may begin; a range then maps the state before it to the state after it,
and the maps are composed in file order, one row for each range. With its state known, each range is
cut into records, and Spark's own parsers read these. Only records that cross a border of ranges are
shuffled, in two or more fragments. A task takes as many ranges as Spark's own scan would give it bytes,
so that small ranges don't make more tasks.
"""

from __future__ import annotations

import math
import re
import sys
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get the functions of this module with their code, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Format(NamedTuple):
    """How a text is cut: what ends a piece, whether that belongs to it, and the steps from state to state.

    ``step(mode, piece)`` gives the mode after the piece and the change of depth. A record ends with a
    piece after which the mode is 0 and the depth that of the file's records: 1 where ``nested`` says so
    of the file's first piece, else 0.
    """

    separator: str
    kept: bool
    modes: int
    step: Callable[[int, str], tuple[int, int]]
    nested: Callable[[str], bool]


def csv_format(sep: str = ",", quote: str = '"', escape: str = "\\") -> Format:
    """Lines; mode 1 is inside quotes. Quotes count only where they open a field."""
    q, e = re.escape(quote), re.escape(escape)
    body = f"(?:[^{q}]|{q}{q})*+" if escape == quote else f"(?:[^{q}{e}]|{e}.|{e}$)*+"
    close = re.compile(f"{body}{q}", re.DOTALL)

    def step(mode: int, line: str) -> tuple[int, int]:
        if quote not in line:
            return mode, 0
        at = 0
        while True:
            if not mode and line.startswith(quote, at):
                mode, at = 1, at + 1
            if mode:
                found = close.match(line, at)
                if found is None:
                    return 1, 0
                mode, at = 0, found.end()
            at = line.find(sep, at) + 1
            if not at:
                return 0, 0

    return Format("\n", False, 2, step, lambda first: False)


_STRINGS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_REST = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)


def json_format() -> Format:
    """Objects of an array, or one after the other; mode 1 is inside a string."""
    def step(mode: int, piece: str) -> tuple[int, int]:
        if mode:
            found = _REST.match(piece)
            if found is None:
                return 1, 0
            piece = piece[found.end():]
        bare = _STRINGS.sub("", piece)
        bare, opened, _ = bare.partition('"')
        return int(bool(opened)), bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")

    return Format("}", True, 2, step, lambda first: first.lstrip("\ufeff \t\r\n").startswith("["))


class State(NamedTuple):
    """What is known where a range begins: mode, depth, depth of the file's records, and the range where the open record began."""

    mode: int
    depth: int
    base: int
    owner: int


def _cores(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)


def _pieces(spark: SparkSession, path: str | list[str], separator: str, split_bytes: int | None) -> DataFrame:
    """(file, start, value): what lies between separators, and the first byte of its range.

    The scan keeps its ranges when executors come and go or settings change, since its relation is made in
    a session of its own; a view brings it back to the caller's.
    """
    pinned = spark.newSession()
    pinned.conf.set("spark.sql.files.minPartitionNum", str(_cores(spark)))
    pinned.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes or spark.conf.get("spark.sql.files.maxPartitionBytes")))
    pinned.conf.set("spark.sql.files.openCostInBytes", str(split_bytes or spark.conf.get("spark.sql.files.openCostInBytes")))
    text = pinned.read.text(path, lineSep=separator)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    view = f"pieces_{uuid.uuid4().hex}"
    pieces.createGlobalTempView(view)
    found = spark.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}")
    spark.catalog.dropGlobalTempView(view)
    return found


#: Tasks for each core, at least: ranges differ in what they cost.
WAVES = 4


def _shared(spark: SparkSession, pieces: DataFrame, path: str | list[str]) -> DataFrame:
    """The same ranges, several to a task where they are smaller than what Spark's scan of the files gives a task."""
    plain = spark.read.text(path).rdd.getNumPartitions()
    return pieces.coalesce(max(plain, WAVES * _cores(spark)))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, first byte, pieces) of runs of rows of one range; a range that lies in several batches has as many runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch["file"].dictionary_encode(), batch["start"].to_numpy()
        codes = files.indices.to_numpy()
        borders = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
        for lo, hi in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
            yield files[lo].as_py(), int(starts[lo]), batch["value"].slice(lo, hi - lo).to_pylist()


def _scan_task(form: Format) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each range: for each mode before it the mode after it, the change of depth, and the lowest depth where a record could end."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nested, ends = None, False, []

        def row() -> pa.RecordBatch:
            found = [{"mode": m, "depth": d, "lowest": None if low == math.inf else low} for m, d, low in ends]
            return pa.RecordBatch.from_pylist([{"file": now[0], "start": now[1], "nested": nested, "ends": found}], _SCANNED)

        for file, start, pieces in _ranges(batches):
            if (file, start) != now:
                if now is not None:
                    yield row()
                now, nested = (file, start), not start and form.nested(pieces[0])
                ends = [(mode, 0, math.inf) for mode in range(form.modes)]
            for i, (mode, depth, lowest) in enumerate(ends):
                for piece in pieces:
                    mode, change = form.step(mode, piece + form.separator if form.kept else piece)
                    depth += change
                    if not mode and depth < lowest:
                        lowest = depth
                ends[i] = mode, depth, lowest
        if now is not None:
            yield row()

    return apply


_END = pa.struct([("mode", pa.int64()), ("depth", pa.int64()), ("lowest", pa.int64())])
_SCANNED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nested", pa.bool_()), ("ends", pa.list_(_END))])


def _composed(rows: list) -> dict[tuple[str, int], State]:
    """The state where each range begins, from one row for each range: the driver has a list of these to plan a scan at all."""
    states: dict[tuple[str, int], State] = {}
    file, now = None, State(0, 0, 0, 0)
    for row in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if row["file"] != file:
            file, now = row["file"], State(0, 0, int(row["nested"]), row["start"])
        states[file, row["start"]] = now
        end = row["ends"][now.mode]
        ended = end["lowest"] is not None and now.depth + end["lowest"] <= now.base
        now = State(end["mode"], now.depth + end["depth"], now.base, row["start"] if ended else now.owner)
    return states


#: A batch of records goes to Spark when it has so many, or so many characters were read for it.
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 22


def _cut_task(form: Format, known: Callable[[], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = known()
        now, out, held, size = None, [], [], 0
        at: State | None = None
        owner, first = 0, False

        def fragment() -> None:
            if held:
                out.append((form.separator.join(held) + form.separator, now[0], owner, now[1], True, first))
                held.clear()

        for file, start, pieces in _ranges(batches):
            if (file, start) != now:
                fragment()
                if (file, start) not in states:
                    raise ValueError(f"{file} was cut into other ranges before, at {start} now")
                now, at = (file, start), State(*states[file, start])
                owner, first = at.owner, not start
            mode, depth, base, _ = at
            for piece in pieces:
                mode, change = form.step(mode, piece + form.separator if form.kept else piece)
                depth += change
                held.append(piece)
                if mode or depth > base:
                    continue
                whole = owner == start
                out.append((form.separator.join(held) + (form.separator if form.kept or not whole else ""), file, owner, start, not whole, first))
                held.clear()
                owner, first = start, False
            at = State(mode, depth, base, owner)
            size += sum(map(len, pieces))
            if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                yield _record_batch(out)
                out.clear()
                size = 0
        fragment()
        yield _record_batch(out)

    return apply


_RECORD = "value string, file string, owner bigint, start bigint, cut boolean, first boolean"


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
    return pa.RecordBatch.from_arrays(columns, ["value", "file", "owner", "start", "cut", "first"])


def records(spark: SparkSession, path: str | list[str], form: Format, split_bytes: int | None = None) -> DataFrame:
    """(value, first): the records of all files, whole; ``first`` marks the first of each file.

    ``split_bytes`` is the size of a range, by default that of Spark's scans. A compressed file is one range.
    """
    pieces = _shared(spark, _pieces(spark, path, form.separator, split_bytes), path)
    scanned = pieces.mapInArrow(_scan_task(form), "file string, start bigint, nested boolean, ends array<struct<mode: bigint, depth: bigint, lowest: bigint>>")
    known = spark.sparkContext.broadcast({place: tuple(state) for place, state in _composed(scanned.collect()).items()})
    cut = pieces.mapInArrow(_cut_task(form, lambda: known.value), _RECORD)
    whole = cut.where("not cut").select("value", "first")
    parts = F.array_sort(F.collect_list(F.struct("start", "value", "first")))
    joined = cut.where("cut").groupBy("file", "owner").agg(parts.alias("parts")).select(
        F.array_join("parts.value", "").alias("value"), F.element_at("parts.first", 1).alias("first"))
    if not form.kept:
        joined = joined.select(F.expr(f"substr(value, 1, length(value) - {len(form.separator)})").alias("value"), "first")
    return whole.union(joined)


def _strings(df: DataFrame):
    """One text column as a Dataset of strings, which Spark's readers take."""
    return getattr(df._jdf, "as")(df.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


#: Options that change how a text is cut in ways that ranges don't know.
UNKNOWN = ("lineSep", "encoding", "charset", "comment", "multiLine", "unescapedQuoteHandling", "charToEscapeQuoteEscaping")


def read_csv_ranges(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, split_bytes: int | None = None, **options,
) -> DataFrame:
    """CSV with a header and line breaks inside quotes, each file read by many tasks.

    The rows are those of ``multiLine``. ``sep``, ``quote``, ``escape`` and what else ``from_csv`` knows
    may be given. The first record of each file is its header; ``header=False`` says there is none.
    Without a schema, one more pass infers the types. Lines end with a line feed, with or without a
    carriage return; the text is UTF-8.
    """
    if refused := [o for o in options if o in UNKNOWN]:
        raise ValueError(f"ranges don't know {', '.join(refused)}; read_csv does")
    options = {"quote": '"', "escape": "\\", "sep": ",", **options}
    header = str(options.pop("header", True)).lower() == "true"
    infer = str(options.pop("inferSchema", True)).lower() == "true"
    form = csv_format(options["sep"], options["quote"], options["escape"])
    found = records(spark, path, form, split_bytes)
    value = F.regexp_replace(F.when(F.col("first"), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), r"\r\z", "")
    found = found.select(value.alias("value"), "first").where("value <> ''")
    options = {**options, "multiLine": "true"}
    texts = {k: str(v) for k, v in options.items()}
    body = found.where("not first") if header else found
    if schema is None:
        reader = found.sparkSession.read.options(**options)
        lines = found.where("first").select("value").limit(1) if header else body.select("value").limit(1)
        names = reader.option("header", header)._jreader.csv(_strings(lines)).columns()
        if not list(names):
            return spark.createDataFrame([], T.StructType())
        kinds = DataFrame(reader.option("header", False).option("inferSchema", infer)._jreader.csv(_strings(body.select("value"))), found.sparkSession).schema
        kinds = {f.name: f.dataType for f in kinds}
        schema = T.StructType([T.StructField(n, kinds.get(f"_c{i}", T.StringType())) for i, n in enumerate(names)])
    return body.select(F.from_csv("value", _ddl(schema), texts).alias("row")).select("row.*")


def read_json_ranges(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, split_bytes: int | None = None, **options,
) -> DataFrame:
    """JSON documents, each an array of objects or objects one after the other, each file read by many tasks.

    The rows are those of ``multiLine``. Without a schema, one more pass infers it. The text is UTF-8.
    """
    found = records(spark, path, json_format(), split_bytes)
    value = F.regexp_replace("value", "^[\ufeff\\s,\\[]+", "")
    found = found.select(value.alias("value")).where(~F.col("value").rlike(r"^[\s\]}]*$"))
    if schema is None:
        reader = found.sparkSession.read.options(**options)
        schema = DataFrame(reader._jreader.json(_strings(found)), found.sparkSession).schema
    return found.select(F.from_json("value", schema, {k: str(v) for k, v in options.items()}).alias("row")).select("row.*")
