"""Alignment of two tokenizers by incidence matrices of tokens and bytes.

Both tokenizers cut the same bytes. A has a row for each token of the first, B for each of the second,
and a column for each byte; A·Bᵀ has an entry for each pair of tokens that overlap, and its value is the
number of bytes they share. Byte offsets where both end cut the tokens into groups, and the product of
the token-by-group matrices has an entry for each pair of tokens of one group. The matrices are compressed
sparse rows in numpy, built for a block of documents at once, and multiplied by Gustavson's row products,
some rows at a time.

An id pair's count is the number of documents that hold it linked. Tasks count their own documents before
the shuffle. The counts come back to the documents as one sorted table while that has at most a given
number of pairs; beyond that, each block of documents asks for its own pairs by a join.

Defined cases: a text that is null or empty, or that a tokenizer changes (a normaliser, U+2581 in the
text), has no tokens and no links. Null and repeated ids count row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import scratch_dir
from .shared import staged
from .tokens import ByteTokens, PieceTokens, broadcast_tokens

#: Bytes and documents of a block; products expanded at once; pairs that a task holds; pairs that are sent to every task.
BLOCK_BYTES, BLOCK_DOCS, EXPANDED, HELD, SENT = 1 << 18, 4_096, 1 << 21, 1 << 21, 2_000_000


class Csr(NamedTuple):
    """A matrix of ones: row r has the columns ``columns[starts[r]:starts[r + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray

    def transposed(self, width: int) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        if np.any(self.columns[1:] < self.columns[:-1]):
            rows = rows[np.argsort(self.columns, kind="stable")]
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(self.columns, minlength=width)))), rows)


def bytes_of_tokens(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from the offsets where tokens end."""
    starts = np.concatenate(([0], ends))
    return Csr(starts, np.arange(starts[-1]))


def groups_of_tokens(ends: np.ndarray, borders: np.ndarray) -> Csr:
    """Tokens by groups, which end at ``borders``."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(borders, ends))


def product(left: Csr, right: Csr, expanded: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of left·right as (rows, columns, values), some rows at a time.

    Row i of the product adds up those rows of ``right`` that row i of ``left`` names.
    """
    sizes = np.diff(right.starts)[left.columns]
    work = np.concatenate(([0], np.cumsum(sizes)))[left.starts]
    lo, n = 0, len(left.starts) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(work, work[lo] + expanded, "right")) - 1))
        named = left.columns[left.starts[lo]:left.starts[hi]]
        many = sizes[left.starts[lo]:left.starts[hi]]
        rows, at = np.repeat(np.arange(lo, hi), np.diff(left.starts[lo:hi + 1])), right.starts[named]
        if (many != 1).any():
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows, at = np.repeat(rows, many), np.repeat(at, many) + within
        columns = right.columns[at]
        if len(rows):
            later = (rows[1:] > rows[:-1]) | (columns[1:] >= columns[:-1])
            if not later.all():
                order = np.lexsort((columns, rows))
                rows, columns = rows[order], columns[order]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1]))))
            yield rows[first], columns[first], np.diff(np.concatenate((first, [len(rows)])))
        lo = hi


class Block:
    """The tokens of some documents on one axis of bytes."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes: tuple[np.ndarray, np.ndarray]):
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (a, b))
        empty = [np.zeros(0, np.int64)]
        self.a, self.b = (np.concatenate(x + empty).astype(np.int64) for x in (a, b))
        self.a_ends, self.b_ends = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        self.doc_of_a = np.repeat(np.arange(len(a)), self.n_a)

    @cached_property
    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """The last token of each group, of A and of B: they end at the same offset."""
        at = np.searchsorted(self.b_ends, self.a_ends)
        same = np.flatnonzero(self.b_ends[at] == self.a_ends)  # both sides end together, so each place exists
        return same, at[same]

    @property
    def borders(self) -> np.ndarray:
        return self.a_ends[self.last[0]]

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A·Bᵀ: tokens of A, tokens of B, bytes that they share."""
        width = int(self.a_ends[-1]) if len(self.a_ends) else 0
        return product(bytes_of_tokens(self.a_ends), bytes_of_tokens(self.b_ends).transposed(width))

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of A and of B that lie in one group."""
        a, b = (groups_of_tokens(e, self.borders) for e in (self.a_ends, self.b_ends))
        return product(a, b.transposed(len(self.borders)))

    def group_texts(self, names: tuple[list[list[bytes]], list[list[bytes]]]) -> list[bytes]:
        """Each document's groups: `a1,a2|b1;a3|b2,b3`. ``names`` has each id followed by a comma, and by a group's mark."""
        closes, groups = [], []
        for ids, last in zip((self.a, self.b), self.last):
            closing = np.zeros(len(ids), bool)
            closing[last] = True
            closes.append(closing)
            groups.append(np.cumsum(closing) - closing)
        many_a, many_b = (last + 1 for last in self.last)  # tokens up to the end of each group
        place_a = np.arange(len(self.a)) + np.concatenate(([0], many_b))[groups[0]]
        place_b = np.arange(len(self.b)) + many_a[groups[1]]
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, place, closing, (inner, marked) in zip((self.a, self.b), (place_a, place_b), closes, names):
            for chosen, table in ((~closing, inner), (closing, marked)):
                out[place[chosen]] = table[ids[chosen]]
        sizes, marked = (self.n_a + self.n_b).tolist(), out.tolist()
        return [b"".join(marked[e - n:e])[:-1] for e, n in zip(accumulate(sizes), sizes)]


class _Pair:
    """Both tokenizers and what follows from them."""

    def __init__(self, a: ByteTokens, b: PieceTokens):
        self.a, self.b = a, b
        self.sizes = tuple(np.array([len(t) for t in x], np.int64) for x in (self._dense(a.bytes_of), b.bytes_of))
        self.kinds = tuple("<u2" if len(x) <= 1 << 16 else "<u4" for x in self.sizes)
        self.names = tuple(
            tuple(np.array([str(i).encode() + mark for i in range(len(x))], object) for mark in (b",", closing))
            for x, closing in zip(self.sizes, (b"|", b";")))

    @staticmethod
    def _dense(table: dict[int, bytes]) -> list[bytes]:
        return [table.get(i, b"") for i in range(1 + max(table))]

    def ids(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids, or none where either changes the text."""
        none = np.zeros(0, np.uint32)
        if not raw:
            return none, none
        text, spaced = raw.decode("utf-8", "replace"), b" " + raw
        both = self.a.ids(" " + text, special=False), self.b.ids(text)
        return both if self.a.decoded(both[0]) == spaced == self.b.decoded(both[1]) else (none, none)


def _start(a, b) -> _Pair:
    """One for each worker and pair of broadcasts."""
    held = a.value
    if not hasattr(held, "paired"):
        held.paired = _Pair(held, b.value)
    return held.paired


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, block bigint, a binary, b binary"


def _blocks(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch, int], tuple[np.ndarray, np.ndarray, int]]):
    """Rows of the batches in blocks: the batches' parts, and both sides' ids."""
    held, a, b, size = [], [], [], 0
    for batch in batches:
        begun = 0
        for at in range(len(batch)):
            ids_a, ids_b, n = read(batch, at)
            a.append(ids_a)
            b.append(ids_b)
            size += n
            if size >= BLOCK_BYTES or len(a) >= BLOCK_DOCS:
                yield [*held, batch.slice(begun, at + 1 - begun)], a, b
                held, a, b, size, begun = [], [], [], 0, at + 1
        if begun < len(batch):
            held.append(batch.slice(begun))
    if a:
        yield held, a, b


def _align_task(a, b) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _start(a, b), TaskContext.get().partitionId() << 33

        def read(batch: pa.RecordBatch, at: int):
            raw = batch["text"][at].as_py()
            return *pair.ids(raw), len(raw)

        for rows, of_a, of_b in _blocks(batches, read):
            block = Block(of_a, of_b, pair.sizes)
            n_links = np.zeros(len(of_a), np.int64)
            for links, _, _ in block.overlaps():
                n_links += np.bincount(block.doc_of_a[links], minlength=len(of_a))
            group_doc = block.doc_of_a[block.last[0]]
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in block.group_texts(pair.names)]
            raw = [pa.array([i.astype(kind).tobytes() for i in ids], pa.binary()) for ids, kind in zip((of_a, of_b), pair.kinds)]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([r["doc_id"] for r in rows]), pa.array(block.n_a), pa.array(block.n_b),
                pa.array(np.bincount(group_doc, minlength=len(of_a))), pa.array(n_links), pa.array(digests),
                pa.array(np.full(len(of_a), number)), *raw,
            ], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "a", "b"])
            number += 1

    return apply


def _reader(pair: _Pair):
    def read(batch: pa.RecordBatch, at: int):
        a, b = (np.frombuffer(batch[c][at].as_py(), k) for c, k in zip("ab", pair.kinds))
        return a, b, int(pair.sizes[0][a].sum())

    return read


def _keys(pair: _Pair, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and packed id pair of each link."""
    width = len(pair.sizes[1])
    for of_a, of_b, _ in block.overlaps():
        yield block.doc_of_a[of_a], block.a[of_a] * width + block.b[of_b]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _counts_of(pair: _Pair, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Packed id pairs of a block, and in how many of its documents each is linked."""
    found = list(_keys(pair, block))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = len(pair.sizes[0]) * len(pair.sizes[1])
    if len(block.n_a) * space >= 1 << 63:
        raise ValueError("vocabularies too large for 64-bit keys")
    keys = np.unique(np.concatenate([doc * space + key for doc, key in found])) % space
    return _added(keys, np.ones(len(keys), np.int64))


def _count_task(a, b, by_block: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pair, n) of a task's documents; or (block, pair, n) for each block."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _start(a, b)
        if by_block:
            for batch in batches:
                for number in batch["block"].unique():
                    rows = batch.filter(pc.equal(batch["block"], number))
                    for _, of_a, of_b in _blocks(iter([rows]), _reader(pair)):
                        keys, _ = _counts_of(pair, Block(of_a, of_b, pair.sizes))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number.as_py())), pa.array(keys)], ["block", "pair"])
            return
        held, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        for _, of_a, of_b in _blocks(batches, _reader(pair)):
            waiting.append(_counts_of(pair, Block(of_a, of_b, pair.sizes)))
            if sum(len(k) for k, _ in waiting) > max(len(held[0]), HELD // 4):
                held, waiting = _added(*(np.concatenate(x) for x in zip(held, *waiting))), []
                if len(held[0]) > HELD:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), ["pair", "n"])
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(held, *waiting))
        if len(keys):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _added(keys, counts))), ["pair", "n"])

    return apply


class PairCounts:
    """Packed id pairs, their counts, and whether each is the highest of its first id."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.pairs, self.counts, self.best = pairs, counts, best

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "counts": self.counts, "best": self.best}

    @cached_property
    def places(self) -> pd.Index:
        """The place of each pair, by a hash table that each worker makes once."""
        return pd.Index(self.pairs)

    def scores(self, pair: _Pair, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each document, links that are best, and the sum of the links' counts."""
        best, total = (np.zeros(len(block.n_a), np.int64) for _ in range(2))
        for doc, key in _keys(pair, block):
            at = self.places.get_indexer(key)
            best += np.bincount(doc[self.best[at]], minlength=len(best))
            ends = np.concatenate(([0], np.cumsum(self.counts[at])))
            edges = np.searchsorted(doc, np.arange(len(total) + 1))
            total += np.diff(ends[edges])
        return best, total


SCORED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _scored(pair: _Pair, table: PairCounts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, of_a, of_b in _blocks(batches, _reader(pair)):
        best, total = table.scores(pair, Block(of_a, of_b, pair.sizes))
        kept = {c: pa.concat_arrays([r[c] for r in rows]) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        kept |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        yield pa.RecordBatch.from_arrays([kept[n] for n in names], names)


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, block, a, b) of each whole text.

    ``a`` and ``b`` are the ids as little-endian unsigned numbers, of 16 bits where the vocabulary allows.
    """
    return _align(docs, *_broadcast(docs.sparkSession, byte_path, piece_path))


def _align(docs: DataFrame, a: Broadcast, b: Broadcast) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_align_task(a, b), f"doc_id {kind}, {ALIGNED}")


def _broadcast(spark: SparkSession, byte_path: str, piece_path: str) -> tuple[Broadcast, Broadcast]:
    return broadcast_tokens(spark, ByteTokens(byte_path)), broadcast_tokens(spark, PieceTokens(piece_path))


def links(aligned: DataFrame, byte_path: str, piece_path: str, of: str = "overlap") -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, n): each pair of token occurrences that are linked.

    ``of`` is "overlap", with ``n`` the bytes that both have, or "group", with ``n`` 1.
    """
    a, b = _broadcast(aligned.sparkSession, byte_path, piece_path)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _start(a, b)
        for rows, of_a, of_b in _blocks(batches, _reader(pair)):
            block = Block(of_a, of_b, pair.sizes)
            names = pa.concat_arrays([r["doc_id"] for r in rows])
            first_a, first_b = (np.cumsum(n) - n for n in (block.n_a, block.n_b))
            for left, right, value in block.overlaps() if of == "overlap" else block.shared_groups():
                doc = block.doc_of_a[left]
                columns = left - first_a[doc], right - first_b[doc], block.a[left], block.b[right], value
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc)), *map(pa.array, columns)], ["doc_id", "a_at", "b_at", "a_id", "b_id", "n"])

    kind = aligned.schema["doc_id"].dataType.simpleString()
    return aligned.select("doc_id", "a", "b").mapInArrow(apply, f"doc_id {kind}, a_at bigint, b_at bigint, a_id bigint, b_id bigint, n bigint")


def pair_counts(aligned: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(a_id, b_id, pair, count, best): in how many documents each id pair is linked; ``best`` if no pair of ``a_id`` has more."""
    return _pair_counts(aligned, *_broadcast(aligned.sparkSession, byte_path, piece_path))


def _pair_counts(aligned: DataFrame, a: Broadcast, b: Broadcast) -> DataFrame:
    width = len(b.value.bytes_of)
    partial = aligned.select("a", "b").mapInArrow(_count_task(a, b, False), "pair bigint, n bigint")
    counts = partial.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = staged(counts.select(F.expr(f"pair div {width}").alias("a_id"), (F.col("pair") % width).alias("b_id"), "pair", "count"))
    highest = counts.groupBy("a_id").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a_id").select("a_id", "b_id", "pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def score_links(docs: DataFrame, byte_path: str, piece_path: str, sent: int = SENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each whole text.

    ``n_best`` counts links whose pair no pair of the same first id exceeds; ``count_sum`` adds up the
    counts of all links. With over ``sent`` distinct pairs, blocks join theirs instead of getting all.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark)
    a, b = _broadcast(spark, byte_path, piece_path)
    written = _align(docs, a, b)
    written.write.option("compression", "zstd").parquet(path)
    aligned = spark.read.schema(written.schema).parquet(path)
    counts = staged(_pair_counts(aligned, a, b).select("pair", "count", "best"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORED}"
    if counts.count() <= sent:
        table = counts.toArrow()
        columns = (table[c].to_numpy() for c in ("pair", "count", "best"))
        everything = spark.sparkContext.broadcast(PairCounts(*columns))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _scored(_start(a, b), everything.value, batches)

        return aligned.mapInArrow(apply, schema)

    asked = aligned.select("block", "a", "b").mapInArrow(_count_task(a, b, True), "block bigint, pair bigint").distinct()
    answers = asked.join(counts, "pair").select("block", "pair", "count", "best")

    def meet(documents: pa.Table, found: pa.Table) -> pa.Table:
        columns = (found[c].to_numpy() for c in ("pair", "count", "best"))
        return pa.Table.from_batches(list(_scored(_start(a, b), PairCounts(*columns), iter(documents.combine_chunks().to_batches()))))

    return aligned.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)

