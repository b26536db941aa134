"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words of letters, digits and all
beyond ASCII. A window is ``width`` consecutive words of an item, or a whole shorter item. The
automaton holds every run of words of any item; streaming a document through it gives, at each
word, the length of the longest run that ends there. A length of ``width`` or more covers that
many words; the end of a whole short item covers the item. Words covered are hit; a document
is contaminated if at least one word in ``1 / coverage`` is hit.

The automaton grows with the benchmark, so its size is bounded: items are dealt to as many
shards as ``shard_words`` asks for, one automaton each. With several, each shard has a pass of its own
over the documents, so that the driver builds and a worker holds one at a time; only the hits of a text,
under its digest, are put together with those of other shards.

Defined cases: null texts have no words, and items without words no windows; items with null
ids are left out; an item id that repeats counts once; rows of documents may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import letter_words, staged, unused, with_result

WIDTH = 13
#: A document with fewer hit words than one in so many is clean.
COVERAGE = 20
#: Words of a shard's items: an automaton of as many different words takes some 200 MB.
SHARD_WORDS = 250_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
])
N_SCHEMA = T.StructType([T.StructField("n_words", T.LongType())])
CUT_SCHEMA = T.StructType([
    T.StructField("contaminated", T.BooleanType()), T.StructField("empty", T.BooleanType()), T.StructField("text", T.StringType()),
])


class Automaton:
    """Suffix automaton of many word sequences, with the item windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._mark(coded)
        self.shortest = min([width, *(len(c) for _, c in coded)])
        pairs = {a << 32 | b for _, codes in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence of ``last`` with ``c`` added."""
        following, link, length = self.next, self.link, self.length
        if c in following[last]:
            known = following[last][c]
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        state = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return state

    def _state(self, following: dict[int, int], length: int, link: int = 0) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the shorter sequences that arrive through ``p``."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """For each state: the state of its last ``width`` words, and the short items that it ends with."""
        link, length, width = self.link, self.length, self.width
        order = sorted(range(1, len(link)), key=length.__getitem__)
        self.window = [0] * len(link)
        for s in order:
            if length[s] >= width:
                self.window[s] = s if length[link[s]] < width else self.window[link[s]]
        self.items: dict[int, set[str]] = {}
        whole: dict[int, set[str]] = {}
        for name, codes in coded:
            s = 0
            for i, c in enumerate(codes, 1):
                s = self.next[s][c]
                if i >= width:
                    self.items.setdefault(self.window[s], set()).add(name)
            if len(codes) < width:
                whole.setdefault(s, set()).add(name)
        self.short: list[tuple[tuple[int, set[str]], ...]] = [()] * len(link)
        if whole:
            for s in order:
                own = ((length[s], whole[s]),) if s in whole else ()
                self.short[s] = self.short[link[s]] + own

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges [start, end) in which all words are known and all neighbours are neighbours in an item.

        No other place can hold a window, so only these go through the automaton.
        """
        if self.shortest == 1:
            good = np.flatnonzero(codes)
            if not len(good):
                return []
            cuts = np.flatnonzero(np.diff(good) > 1) + 1
            return [(int(g[0]), int(g[-1]) + 1) for g in np.split(good, cuts)]
        if len(codes) < self.shortest or not len(self.pairs):
            return []
        keys = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        edges = np.diff(np.concatenate(([0], (self.pairs[at] == keys).astype(np.int8), [0])))
        first, past = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = past - first + 1 >= self.shortest
        return list(zip(first[long].tolist(), (past[long] + 1).tolist(), strict=True))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges [start, end) of hit words, and the items with a window among them."""
        codes = np.fromiter((self.ids.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for first, past in self.candidates(codes):
            s = n = 0
            for j, c in enumerate(codes[first:past].tolist(), first + 1):
                while s and c not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if c in self.next[s]:
                    s, n = self.next[s][c], n + 1
                reach = 0
                if n >= self.width:
                    reach = n
                    found |= self.items[self.window[s]]
                for size, names in self.short[s]:
                    if size <= n:
                        reach = max(reach, size)
                        found |= names
                if reach:
                    start = j - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, j))
        return spans, found


def automata(items: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> list[Broadcast]:
    """One broadcast automaton for each shard of the items; a shard holds about ``shard_words`` words."""
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    texts = texts.where(F.col("item_id").isNotNull() & F.col("raw").isNotNull())
    # a word takes two bytes at least, with the blank
    size = texts.agg(F.coalesce(F.sum(F.octet_length("raw") / 2), F.lit(0.0)).alias("n")).first()["n"]
    shards = max(1, -(-int(size) // shard_words))
    out = []
    for k in range(shards):
        rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect()
        out.append(spark.sparkContext.broadcast(Automaton([(r["item_id"], letter_words(bytes(r["raw"]))) for r in rows], width)))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that neither overlap nor touch, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_all(shards: list[Broadcast], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for shard in shards:
        more, names = shard.value.scan(words)
        spans += more
        found |= names
    return _merged(spans) if len(shards) > 1 else spans, found


def _hit_row(shards: list[Broadcast]) -> Callable[[], Callable[[bytes], tuple]]:
    def start() -> Callable[[bytes], tuple]:
        def one(raw: bytes) -> tuple:
            words = letter_words(raw)
            spans, found = _scan_all(shards, words)
            return len(words), [a for a, _ in spans], [b for _, b in spans], sorted(found)
        return one
    return start


def _key() -> Column:
    """A text's digest; equal texts have equal hits."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def _hits(texts: DataFrame, shards: list[Broadcast]) -> DataFrame:
    """(key, n_words, spans, items) of the texts (key, text) that any shard hits, a pass for each shard."""
    parts = []
    for shard in shards:
        one = with_result(texts, "text", "hits", HITS_SCHEMA, _hit_row([shard])).where(F.size("hits.starts") > 0)
        parts.append(staged(one.select("key", "hits.*").dropDuplicates(["key"])))
    zipped = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    return reduce(DataFrame.union, parts).groupBy("key").agg(
        F.first("n_words").alias("n_words"), _merged_column(zipped).alias("spans"), names.alias("items"))


_SPANS = T.ArrayType(T.StructType([T.StructField("starts", T.LongType()), T.StructField("ends", T.LongType())]))


def _merged_column(spans: Column) -> Column:
    kind = pa.list_(pa.struct([("starts", pa.int64()), ("ends", pa.int64())]))

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [_merged([(s["starts"], s["ends"]) for s in row]) for row in batch.to_pylist()]
            yield pa.array([[{"starts": a, "ends": b} for a, b in row] for row in rows], kind)

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(apply, _SPANS)(spans)


def _count_words() -> Callable[[bytes], tuple]:
    return lambda raw: (len(letter_words(raw)),)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, starts, ends, items): ranges of hit words, and sorted ids of the items hit."""
    shards = automata(items, width, shard_words)
    docs = docs.select("doc_id", "text")
    if len(shards) == 1:
        return with_result(docs, "text", "hits", HITS_SCHEMA, _hit_row(shards)).select("doc_id", "hits.*")
    counted = with_result(docs.withColumn("key", _key()), "text", "counted", N_SCHEMA, _count_words)
    found = _hits(docs.select(_key().alias("key"), "text"), shards).select("key", "spans", "items")
    none = F.array().cast("array<bigint>")
    return counted.select("doc_id", "key", "counted.n_words").join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("spans.starts", none).alias("starts"), F.coalesce("spans.ends", none).alias("ends"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_digests(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (
        contamination(docs, items, width, shard_words)
        .withColumn("n_hit", n_hit)
        .select(
            "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        )
    )


def cut(raw: bytes, shards: list[Broadcast], coverage: int) -> tuple[bool, bytes]:
    """Whether the text is contaminated, and what is left of it without its hit spans.

    A cut brings new neighbours together, so the rest is scanned again until it is clean.
    """
    contaminated = False
    while True:
        words = letter_words(raw)
        spans, _ = _scan_all(shards, words)
        n_hit = sum(b - a for a, b in spans)
        if not n_hit or coverage * n_hit < len(words):
            return contaminated, raw
        contaminated = True
        raw = _without(raw, spans)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of some ranges."""
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, coverage: int = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with all hit spans cut out of contaminated texts; texts without words left go.

    Other rows stay as they are, those with null texts included.
    """
    shards = automata(items, width, shard_words)
    if len(shards) > 1:
        return _decontaminated(docs, shards, coverage)

    def start() -> Callable[[bytes], tuple]:
        def one(raw: bytes) -> tuple:
            contaminated, rest = cut(raw, shards, coverage)
            return contaminated, contaminated and not letter_words(rest), rest.decode("utf-8", "replace") if contaminated else None
        return one

    name = unused("cut", docs)
    out = with_result(docs, "text", name, CUT_SCHEMA, start).where(~F.col(f"{name}.empty"))
    text = F.when(F.col(f"{name}.contaminated"), F.col(f"{name}.text")).otherwise(F.col("text"))
    return out.withColumn("text", text).select(*docs.columns)


def _decontaminated(docs: DataFrame, shards: list[Broadcast], coverage: int) -> DataFrame:
    """The same with a pass for each shard; contaminated texts alone are cut and scanned again until all are clean."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["ends"] - s["starts"])
    texts, cut_texts = docs.select(_key().alias("key"), "text"), None
    while True:
        found = staged(_hits(texts, shards).where(coverage * hit >= F.col("n_words")).select("key", "spans"))
        if found.isEmpty():
            break
        dirty = texts.join(found, "key").dropDuplicates(["key"])
        rest = staged(dirty.select("key", _cut_column(F.col("text"), F.col("spans")).alias("text")))
        cut_texts = rest if cut_texts is None else staged(cut_texts.join(rest, "key", "left_anti").union(rest))
        texts = rest
    if cut_texts is None:
        return docs
    key, row = unused("key", docs), unused("rest", docs)
    left = with_result(cut_texts, "text", "counted", N_SCHEMA, _count_words)
    left = left.select(F.col("key").alias(key), F.struct("text", "counted.n_words").alias(row))
    out = docs.withColumn(key, _key()).join(left, key, "left").where(F.coalesce(F.col(f"{row}.n_words") > 0, F.lit(True)))
    return out.withColumn("text", F.when(F.col(row).isNotNull(), F.col(f"{row}.text")).otherwise(F.col("text"))).select(*docs.columns)


def _cut_column(text: Column, spans: Column) -> Column:
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, rows in batches:
            rests = [_without(r.as_py(), [(s["starts"], s["ends"]) for s in row.as_py()]) for r, row in zip(raws, rows)]
            yield pa.array([r.decode("utf-8", "replace") for r in rests], pa.string())

    apply.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(apply, "string")(text.cast("binary"), spans)
