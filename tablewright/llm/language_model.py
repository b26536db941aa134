"""An interpolated modified Kneser-Ney bigram model, counted in Spark, mapped into workers' memory.

Tokens are the words between ASCII white space, with A-Z in lower case, and one end per text; a text's
first token has a start as its context. Words are known by 64-bit hashes.

Counting takes three shuffles, each of sorted, packed arrays that are summed before they are sent:

1. words: each task counts its words; each range of hashes is merged, sorted and written as one file.
   A word's number is its place over all files.
2. bigrams: pairs of numbers, dealt by the context; contexts with more than an even share of the tokens
   are dealt by both words. Each part is merged, sorted and written as one file.
3. for each word, from the merged bigrams: the words before it (its continuation count), and how many of
   its followers occur once, twice and more often; written as one file for each range of words.

A worker maps the files and finds words and bigrams by binary search. Where the shared folder isn't a
mounted one, it first copies them to a file of its own that has no name and goes with the worker. The
model takes about 40 bytes a word and 12 a bigram; each worker's disk or page cache must hold it.

Defined cases: null and empty texts have the end only; words not in training take the share of
continuations left over, as does every word after a context not in training; without training texts
every probability is 1; ids that are null are in training; rows may repeat.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import ceil, log2
from tempfile import TemporaryFile

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import scratch_dir
from .shared import blank_words, label_fold

#: Bytes of text for each part of the model, distinct words and tokens that a task holds, and tokens scored at once.
PART_BYTES, HELD_WORDS, HELD_TOKENS, AT_ONCE = 32_000_000, 300_000, 3_000_000, 200_000
#: Discounts where the counts of counts don't give any.
PLAIN = (0.5, 1.0, 1.5)

_END = b" "  # no word holds a blank
_PACKED = "target int, kind int, n int, keys binary, counts binary"
_NUMBERS = "target int, kind int, numbers array<bigint>"
_WORDS, _ONCE, _TWICE, _OFTEN, _BEFORE, _SIZE, _COUNTS = range(7)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of all values by their rank, which leaves runs of zeros to compress."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _pack(target: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> dict:
    """A row of sorted keys, as differences, and their counts."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return {"target": target, "kind": kind, "n": len(keys), "keys": _planes(steps), "counts": _planes(counts.astype(np.uint64))}


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the rows, sorted, with the sums of their counts."""
    keys, counts = [], []
    for n, k, c in zip(table["n"].to_pylist(), table["keys"], table["counts"], strict=True):
        plane = lambda v: np.ascontiguousarray(np.frombuffer(v.as_buffer(), np.uint8).reshape(8, n).T).view(np.uint64).ravel()
        keys.append(np.cumsum(plane(k), dtype=np.uint64))
        counts.append(plane(c))
    return _summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.uint64),) * 2


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if order is None:
        sums = np.diff(np.concatenate((first, [len(keys)])))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else counts
    return keys[first], sums.astype(np.uint64)


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """One file of the arrays. A task that runs again writes the same, and puts it in place whole."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    store.move(own, f"{path}/{name}")


def _map(folder: str, name: str, size: int) -> np.ndarray:
    """The bytes of a file of the model, mapped."""
    if not size:
        return np.zeros(0, np.uint8)
    store, path = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", np.uint8, "r")
    own = TemporaryFile()  # noqa: SIM115  the map keeps it
    with store.open_input_stream(f"{path}/{name}") as source:
        while block := source.read(1 << 24):
            own.write(block)
    own.flush()
    return np.memmap(own, np.uint8, "r")


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(32))


@dataclass
class Model:
    """Where the files lie and how large they are; the numbers that all words share."""

    folder: str
    bits: int
    word_sizes: list[int] = field(default_factory=list)
    bigram_sizes: list[int] = field(default_factory=list)
    tokens: int = 0
    texts: int = 0
    discounts: tuple[float, ...] = PLAIN
    low_discounts: tuple[float, ...] = PLAIN
    low_total: int = 0
    low_left: float = 0.0
    start_left: float = 0.0

    @property
    def words(self) -> int:
        return sum(self.word_sizes)

    @property
    def start(self) -> int:
        """The number of the start, after all words."""
        return self.words

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.word_sizes))).astype(np.int64)

    def part_of_words(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)

    def part_of_bigrams(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        """By the context; a context with more than an even share of the tokens by both words."""
        hot = context_counts > self.tokens >> self.bits
        return self.part_of_words(_mixed(np.where(hot, keys, keys >> np.uint64(32))))


class Files:
    """The mapped files of a model, and searches in them."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def _get(self, kind: str, part: int, *sizes: tuple[type, int]) -> list[np.ndarray]:
        if (kind, part) not in self.maps:
            data, at, views = _map(self.model.folder, f"{kind}-{part}", sum(n * np.dtype(t).itemsize for t, n in sizes)), 0, []
            for t, n in sizes:
                size = n * np.dtype(t).itemsize
                views.append(data[at:at + size].view(t))
                at += size
            self.maps[kind, part] = views
        return self.maps[kind, part]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each hash; -1 and 0 for one not in training."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        offsets = self.model.offsets
        for part, rows in _by_part(self.model.part_of_words(hashes)):
            n = self.model.word_sizes[part]
            known, sums = self._get("words", part, (np.uint64, n), (np.uint64, n))
            at, found = _search(known, hashes[rows])
            numbers[rows[found]] = offsets[part] + at[found]
            counts[rows[found]] = sums[at[found]]
        return numbers, counts

    def counts_of(self, contexts: np.ndarray) -> np.ndarray:
        """Counts of words by their numbers; for the start, the number of texts."""
        out = np.full(len(contexts), self.model.texts, np.int64)
        known = np.flatnonzero(contexts < self.model.words)
        offsets = self.model.offsets
        for part, rows in _by_part(np.searchsorted(offsets, contexts[known], side="right") - 1):
            n = self.model.word_sizes[part]
            _, sums = self._get("words", part, (np.uint64, n), (np.uint64, n))
            out[known[rows]] = sums[contexts[known[rows]] - offsets[part]]
        return out

    def neighbours(self, numbers: np.ndarray) -> np.ndarray:
        """For each number: words before it, followers that occur once, twice, more often."""
        out = np.zeros((4, len(numbers)), np.int64)
        known = np.flatnonzero((numbers >= 0) & (numbers < self.model.words))
        offsets = self.model.offsets
        for part, rows in _by_part(np.searchsorted(offsets, numbers[known], side="right") - 1):
            n = self.model.word_sizes[part]
            views = self._get("neighbours", part, *[(np.uint32, n)] * 4)
            for k, view in enumerate(views):
                out[k, known[rows]] = view[numbers[known[rows]] - offsets[part]]
        return out

    def bigrams(self, keys: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(keys), np.int64)
        for part, rows in _by_part(self.model.part_of_bigrams(keys, context_counts)):
            n = self.model.bigram_sizes[part]
            known, sums = self._get("bigrams", part, (np.uint64, n), (np.uint32, n))
            rows = rows[np.argsort(keys[rows])]  # neighbours in the file are searched one after the other
            at, found = _search(known, keys[rows])
            counts[rows[found]] = sums[at[found]]
        return counts


def _by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    cuts = np.flatnonzero(np.diff(parts[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(parts[rows[0]]), rows


def _search(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and which of them hold what was wanted."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


_opened: dict[str, Files] = {}


def _files(model: Model) -> Files:
    """The files of the model that this worker has used last."""
    if model.folder not in _opened:
        _opened.clear()
        _opened[model.folder] = Files(model)
    files = _opened[model.folder]
    files.model = model  # it knows more after each step
    return files


def _batches(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for v in batch.column(0):
            yield v.as_py() or b""


def _count_words(model: Model) -> Callable:
    def sums(counts: Counter) -> pa.RecordBatch:
        hashes = np.fromiter(map(_hash, counts), np.uint64, len(counts))
        keys, n = _summed(hashes, np.fromiter(counts.values(), np.uint64, len(counts)))
        return _batches([_pack(part, _WORDS, keys[rows], n[rows]) for part, rows in _by_part(model.part_of_words(keys))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for text in _texts(batches):
            counts.update(blank_words(text))
            counts[_END] += 1
            if len(counts) > HELD_WORDS:
                yield sums(counts)
                counts = Counter()
        yield sums(counts)

    return apply


def _merge_words(model: Model) -> Callable[[pa.Table], pa.Table]:
    def apply(table: pa.Table) -> pa.Table:
        part = table["target"][0].as_py()
        keys, counts = _unpack(table)
        _write(model.folder, f"words-{part}", keys, counts)
        return _numbers([(part, _SIZE, [len(keys), int(counts.sum())])])

    return apply


def _numbers(rows: list[tuple[int, int, list[int]]]) -> pa.Table:
    names = ("target", "kind", "numbers")
    schema = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("numbers", pa.list_(pa.int64()))])
    return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)


class Numbered:
    """The tokens of some texts: word numbers and counts of the distinct ones, and each token's place among them."""

    def __init__(self, texts: list[list[bytes]], files: Files):
        places: dict[bytes, int] = {}
        sizes = np.array([len(t) + 1 for t in texts])
        flat = [w for t in texts for w in (*t, _END)]
        for w in flat:
            if w not in places:
                places[w] = len(places)
        self.place = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.numbers, self.counts = files.words(np.fromiter(map(_hash, places), np.uint64, len(places)))

    def pairs(self, start: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and counts of each token's context, and the token's number."""
        of = self.numbers[self.place]
        context, count = np.empty_like(of), np.empty_like(of)
        context[1:], count[1:] = of[:-1], self.counts[self.place][:-1]
        context[self.first], count[self.first] = start, texts
        return context, count, of


def _in_blocks(texts: Iterator[tuple[int, bytes]], most: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    held, names, n = [], [], 0
    for name, text in texts:
        held.append(blank_words(text))
        names.append(name)
        n += len(held[-1]) + 1
        if n >= most:
            yield names, held
            held, names, n = [], [], 0
    if held:
        yield names, held


def _count_bigrams(model: Model) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held, n = _files(model), [], 0

        def sums() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held))
            contexts = (keys >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
            of_context = np.repeat(files.counts_of(contexts[starts]), np.diff(np.concatenate((starts, [len(contexts)]))))
            parts = model.part_of_bigrams(keys, of_context)
            return _batches([_pack(part, _WORDS, keys[rows], counts[rows]) for part, rows in _by_part(parts)])

        for _, texts in _in_blocks(((0, t) for t in _texts(batches)), AT_ONCE):
            numbered = Numbered(texts, files)
            context, _, token = numbered.pairs(model.start, model.texts)
            held.append(context.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64))
            n += len(held[-1])
            if n > HELD_TOKENS:
                yield sums()
                held, n = [], 0
        if held:
            yield sums()

    return apply


def _merge_bigrams(model: Model) -> Callable[[pa.Table], pa.Table]:
    last = 1 << model.bits

    def apply(table: pa.Table) -> pa.Table:
        part = table["target"][0].as_py()
        keys, counts = _unpack(table)
        if int(counts.max(initial=0)) >> 32:
            raise ValueError("a pair of words occurs more often than 32 bits can count")
        _write(model.folder, f"bigrams-{part}", keys, counts.astype(np.uint32))
        contexts, words = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        offsets = model.offsets
        rows = [_pack(last, _SIZE, np.array([part]), np.array([len(keys)]))]
        rows.append(_pack(last, _COUNTS, np.arange(1, 5), np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]))
        for kind, of in ((_BEFORE, words), (_ONCE, contexts[counts == 1]), (_TWICE, contexts[counts == 2]), (_OFTEN, contexts[counts > 2])):
            numbers, n = _summed(of)
            at_start = numbers == model.start
            if at_start.any():
                rows.append(_pack(last, kind, numbers[at_start], n[at_start]))
            numbers, n = numbers[~at_start], n[~at_start]
            parts = np.searchsorted(offsets, numbers.astype(np.int64), side="right") - 1
            rows += [_pack(p, kind, numbers[r], n[r]) for p, r in _by_part(parts)]
        return pa.Table.from_batches([_batches(rows)])

    return apply


def _merge_neighbours(model: Model) -> Callable[[pa.Table], pa.Table]:
    last = 1 << model.bits

    def apply(table: pa.Table) -> pa.Table:
        part = table["target"][0].as_py()
        kinds = table["kind"].to_numpy()
        of_kind = {k: _unpack(table.filter(pa.array(kinds == k))) for k in np.unique(kinds).tolist()}
        if part == last:
            return _numbers([(last, k, [int(x) for pair in zip(*v) for x in pair]) for k, v in of_kind.items()])
        n, offset = model.word_sizes[part], int(model.offsets[part])
        arrays = np.zeros((4, n), np.uint32)
        for place, kind in enumerate((_BEFORE, _ONCE, _TWICE, _OFTEN)):
            if kind in of_kind:
                numbers, counts = of_kind[kind]
                arrays[place, numbers.astype(np.int64) - offset] = counts
        _write(model.folder, f"neighbours-{part}", *arrays)
        before = np.bincount(np.minimum(arrays[0], 5), minlength=6)
        return _numbers([(part, _BEFORE, [*before[1:6].tolist(), int(arrays[0].sum(dtype=np.int64))])])

    return apply


def _discounts(counts: list[int]) -> tuple[float, ...]:
    """Of counts 1, 2 and more, from how many items have counts 1 to 4."""
    if min(counts) == 0:
        return PLAIN
    y = counts[0] / (counts[0] + 2 * counts[1])
    return tuple(min(max(k - (k + 1) * y * counts[k] / counts[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def train(docs: DataFrame) -> Model:
    """A model of all texts of ``docs``, its files in the shared folder."""
    raw = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    size = raw.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"), F.count("*").alias("texts")).first()
    bits = min(16, max(2, ceil(log2(max(size["bytes"], 1) / PART_BYTES))))
    model = Model(scratch_dir(docs.sparkSession), bits, texts=size["texts"])
    parts = range(1 << bits)

    words = raw.mapInArrow(_count_words(model), _PACKED).groupBy("target").applyInArrow(_merge_words(model), _NUMBERS).collect()
    sizes = {r["target"]: r["numbers"] for r in words}
    model.word_sizes = [sizes.get(p, [0, 0])[0] for p in parts]
    model.tokens = sum(n for _, n in sizes.values())
    if model.words >= 0xFFFFFFFF:
        raise ValueError(f"{model.words} distinct words don't fit numbers of 32 bits")

    packed = raw.mapInArrow(_count_bigrams(model), _PACKED).groupBy("target").applyInArrow(_merge_bigrams(model), _PACKED)
    numbers = packed.groupBy("target").applyInArrow(_merge_neighbours(model), _NUMBERS).collect()
    last = {r["kind"]: r["numbers"] for r in numbers if r["target"] == 1 << bits}
    sizes = dict(zip(last.get(_SIZE, [])[::2], last.get(_SIZE, [])[1::2]))
    model.bigram_sizes = [sizes.get(p, 0) for p in parts]
    model.discounts = _discounts((last.get(_COUNTS, []) + [0] * 8)[1:8:2])
    low = [r["numbers"] for r in numbers if r["target"] < 1 << bits]
    low = [sum(x) for x in zip(*low)] if low else [0] * 6
    model.low_discounts, model.low_total = _discounts(low[:4]), low[5]
    often = low[2] + low[3] + low[4]
    model.low_left = sum(d * n for d, n in zip(model.low_discounts, (low[0], low[1], often))) / low[5] if low[5] else 1.0
    at_start = [last.get(k, [0, 0])[1] for k in (_ONCE, _TWICE, _OFTEN)]
    model.start_left = sum(d * n for d, n in zip(model.discounts, at_start)) / model.texts if model.texts else 1.0
    return model


def _taken(counts: np.ndarray, discounts: tuple[float, ...]) -> np.ndarray:
    """Counts less their discounts."""
    return counts - np.array((0.0, *discounts))[np.minimum(counts, 3)]


def score_texts(texts: list[list[bytes]], files: Files) -> tuple[np.ndarray, ...]:
    """For each text: tokens, known tokens, base score, and log10 probability."""
    model = files.model
    tokens = Numbered(texts, files)
    n = len(texts)
    known = tokens.counts > 0
    base = np.log10((tokens.counts + 1) / (model.tokens + 1 * (model.words + 1)))
    before, once, twice, often = files.neighbours(tokens.numbers)
    low = (_taken(before, model.low_discounts) / max(model.low_total, 1)) + model.low_left / (model.words + 1)
    left = np.divide(
        model.discounts[0] * once + model.discounts[1] * twice + model.discounts[2] * often, tokens.counts,
        out=np.ones(len(known)), where=known)
    context, context_count, token = tokens.pairs(model.start, model.texts)
    share_left = np.ones(len(token))
    share_left[1:] = left[tokens.place[:-1]]
    share_left[tokens.first] = model.start_left
    pairs = np.flatnonzero((context >= 0) & (token >= 0) & (context_count > 0))
    counts = np.zeros(len(token), np.int64)
    counts[pairs] = files.bigrams(context[pairs].astype(np.uint64) << np.uint64(32) | token[pairs].astype(np.uint64), context_count[pairs])
    p = np.divide(_taken(counts, model.discounts), context_count, out=np.zeros(len(token)), where=context_count > 0)
    p += share_left * low[tokens.place]
    of_text = lambda x: np.bincount(tokens.text, x, n)
    return np.bincount(tokens.text, minlength=n), of_text(known[tokens.place]).astype(np.int64), of_text(base[tokens.place]), of_text(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each whole text.

    The base score adds one to each word's count; the score is the model's log10 probability.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "n_tokens", "n_known", "base_score", "score")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(model)
        for batch in batches:
            rows = zip(batch.column(0), (v.as_py() or b"" for v in batch.column(1)))
            for ids, texts in _in_blocks(rows, AT_ONCE):
                columns = [pa.array([i.as_py() for i in ids], batch.schema.field(0).type), *map(pa.array, score_texts(texts, files))]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(apply, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 7, left_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); a fold of ids isn't learnt from."""
    held_out = F.coalesce(label_fold("doc_id", folds) == left_out, F.lit(False))
    model = train(docs.where(~held_out))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
