"""Helpers shared by the operators: words, per-text functions, hot groups, samples."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import stage as staged

ROWS_AT_ONCE = 256

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library's code to the executors of a session, once, as ``--py-files`` would."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = f"{tempfile.mkdtemp(prefix='code-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)


_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 32 for b in range(256))


def letter_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and all beyond ASCII, with A-Z in lower case."""
    return text.translate(_FOLD).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.lower().split()


def with_result(
    df: DataFrame, text: str, result: str, schema: T.StructType,
    start: Callable[[], Callable[[bytes], tuple]],
) -> DataFrame:
    """``df`` with a struct column ``result``, computed from the bytes of each whole text.

    ``start`` runs once per Python task and gives the function for one text. Only the text
    column goes to Python; a null text counts as empty. The function is declared
    non-deterministic, so that a filter over its result doesn't run it twice.
    """
    arrow = pa.struct([(f.name, _arrow_type(f.dataType)) for f in schema])

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = start()
        for batch in batches:
            parts = [pa.array([], type=arrow)]
            for at in range(0, len(batch), ROWS_AT_ONCE):  # results become Arrow soon, to hold few Python objects
                rows = [dict(zip(schema.names, one(v.as_py()), strict=True)) for v in batch[at:at + ROWS_AT_ONCE]]
                parts.append(pa.array(rows, type=arrow))
            yield pa.concat_arrays(parts)

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(apply, schema).asNondeterministic()
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return df.withColumn(result, udf(raw))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def per_text(
    docs: DataFrame, schema: T.StructType, start: Callable[[], Callable[[bytes], tuple]], keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep`` of ``docs``, and what ``start()`` gives for each text."""
    name = unused("result", docs)
    out = with_result(docs.select(*keep, "text"), "text", name, schema, start)
    return out.select(*keep, f"{name}.*")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or the name with a number that no frame has as a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1 + len(taken)))) if n.lower() not in taken)


#: Large groups up to which their sizes go to every task; more are joined by a shuffle.
SENT_GROUPS = 100_000


def with_parts(rows: DataFrame, sizes: DataFrame, keys: list[str], part: int) -> DataFrame:
    """``rows`` with ``parts``: into how many parts of ``part`` rows a group of over twice that size is cut, else 1.

    ``sizes`` has a row for each group: its keys and ``count``. Without large groups nothing is joined.
    """
    large = staged(sizes.where(F.col("count") > 2 * part).select(*keys, F.ceil(F.col("count") / part).cast("int").alias("parts")))
    n = large.count()
    if n == 0:
        return rows.withColumn("parts", F.lit(1))
    joined = rows.join(F.broadcast(large) if n <= SENT_GROUPS else large, keys, "left")
    return joined.withColumn("parts", F.coalesce("parts", F.lit(1)))


def label_fold(column: str, folds: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


#: Bytes after which a text counts no more: its terms are hashed, so what a text adds to a sample is bounded.
COUNTED = 1 << 18


def _first(df: DataFrame, place: F.Column, rows: int) -> DataFrame:
    """The first ``rows`` rows by a 64-bit hash, then by id.

    A bound on the hash keeps about as many rows in all tasks together, or else each task would send as many.
    """
    share = (rows + 6 * rows**0.5 + 50) / max(1, df.count())
    near = df
    while share < 1:
        near = df.where(place < int((share - 0.5) * (1 << 64)))
        if near.count() >= rows:
            break
        share, near = 2 * share, df
    return near.orderBy(place, "doc_id").limit(rows)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: F.Column, rows: int, megabytes: int,
) -> DataFrame:
    """(doc_id, text, y): labelled documents, at most ``rows`` of them and ``megabytes`` of text.

    Only ids that have a label and a text count. The order of the sample is a hash of the id. Repeated
    labels of an id vote; a tie counts as 1. Of several texts of an id the smallest in order of code points
    is taken, so that an id gives one row. Texts are whole, but count for ``COUNTED`` bytes at most. One that
    doesn't fit into what is left is passed over, and later ones are taken; if none fits, the smallest is.
    Only ids, labels and sizes come to the driver, at most ``rows`` of them.
    """
    place = F.xxhash64(F.col("doc_id").cast("string"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    votes = (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
        .join(texts.select("doc_id"), "doc_id", "left_semi")
    )
    spark, votes = docs.sparkSession, staged(votes)
    chosen = spark.createDataFrame(_first(votes, place, rows).collect(), votes.schema)
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    size = F.least(F.octet_length("text"), F.lit(COUNTED)).alias("size")
    sizes = one.select("doc_id", "y", size).orderBy(place, "doc_id").collect()
    taken, left = [], megabytes * 1_000_000
    for row in sizes:
        if row["size"] <= left:
            left -= row["size"]
            taken.append((row["doc_id"], row["y"]))
    if sizes and not taken:
        least = min(sizes, key=lambda r: r["size"])
        taken.append((least["doc_id"], least["y"]))
    sample = texts.join(F.broadcast(spark.createDataFrame(taken, votes.schema)), "doc_id")
    return sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
