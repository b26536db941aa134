"""Spelling variants by generated edits, Bloom filters and an exact join.

Words are counted by tasks first. Each word has a rolling hash, so that the hash of an edited word is a
sum away from its own. For each length there is a Bloom filter of the words of that length, and all
filters go to every task. A word probes its deletions in the filter of the next shorter length, and in
that of its own length its replacements by a letter further on in the alphabet: so every near pair is
met from one of its two sides. Hashes that a filter lets pass, and only they, are shuffled to a join with the
vocabulary, and the words' own letters decide.

Defined cases: a null text has no words, a null id counts as the empty string in the hash of a run; rows
and ids may repeat and count each time; other columns are ignored; an empty table gives no words. Very
long runs are words like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .shared import staged

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile(f"[{LETTERS[:26]}À-ÿ]+")
#: A word has so many letters and occurs so often; a form so many times as often as its word; one run in so many loses a letter.
SHORTEST, RAREST, TIMES, EVERY = 6, 5, 5, 199
#: Characters of a text taken at once, and distinct words that a task holds.
PART, HELD = 1 << 20, 200_000
#: Words of over LONG letters share a filter. Edits probed at once.
LONG, PROBED = 48, 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_CODE = np.zeros(0x100, np.uint8)
for _i, _letter in enumerate(LETTERS, 1):
    _CODE[ord(_letter)] = _i


def runs(text: str, size: int = PART) -> Iterator[list[str]]:
    """The runs of letters of a text whose A-Z are in lower case, part by part."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text) and (found := RUN.match(text, end)):
            end = found.end()  # a run that began before the end of the part is not cut
        yield RUN.findall(text, at, end)
        at = end


def _count_task(every: int, shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            for name, text in zip(batch["id"], batch["text"]):
                prefix = crc32(f"{name.as_py()}:".encode())
                for found in runs(text.as_py().lower().decode("utf-8", "replace")):
                    for run, n in Counter(found).items():
                        if len(run) < shortest:
                            continue
                        h = crc32(run.encode(), prefix)
                        if h % every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                        words[run] += n
                    if len(words) > HELD:
                        yield _word_batch(words, shortest)
                        words.clear()
        yield _word_batch(words, shortest)

    return apply


def _word_batch(words: Counter[str], shortest: int) -> pa.RecordBatch:
    kept = [w for w in words if len(w) >= shortest]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, every: int = EVERY, shortest: int = SHORTEST) -> DataFrame:
    """(word, n): runs of letters of at least ``shortest`` letters, in lower case.

    A run of a document whose crc32, taken over ``<doc_id>:<run>``, is divisible by ``every`` loses the
    letter at the remainder of that crc32 by its length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text.alias("text"))
    return rows.mapInArrow(_count_task(every, shortest), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(length: int) -> np.ndarray:
    """Powers of the factor, highest first."""
    out = np.ones(length, np.uint64)
    np.multiply.accumulate(np.full(length - 1, _FACTOR), out=out[1:])
    return out[::-1]


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """The bits of rolling hashes spread over all 64."""
    h = hashes ^ (hashes >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def codes(word: str) -> np.ndarray:
    """The place of each letter in the alphabet, from 1."""
    return _CODE[np.frombuffer(word.encode("latin-1"), np.uint8)]


def _rolled(letters: np.ndarray) -> np.ndarray:
    """Rolling hashes of the rows of a matrix of letters."""
    return (letters * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


def shard(length: np.ndarray | int):
    return np.minimum(length, LONG)


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch["word"].to_pylist()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        hashes = np.zeros(len(words), np.uint64)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            step = max(1, PROBED // length)
            for lo in range(0, len(own), step):
                at = own[lo:lo + step]
                hashes[at] = _mixed(_rolled(np.stack([codes(words[i]) for i in at]).astype(np.uint64)))
        arrays = [batch["word"], batch["n"], pa.array(shard(lengths)), pa.array(hashes.view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "shard", "hash"])


def edits(letters: np.ndarray, probed: int = PROBED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of edited words, for words of one length: the change of length, the rows, the hashes.

    Deletions of each letter, and replacements of each letter by those after it.
    """
    n, length = letters.shape
    powers, wide = _powers(length), letters.astype(np.uint64)
    terms = wide * powers
    whole = terms.sum(axis=1, dtype=np.uint64)
    after = whole[:, None] - np.cumsum(terms, axis=1, dtype=np.uint64)  # letters right of each place
    before = whole[:, None] - after - terms
    shorter = after + before * _inverse()  # what stood left of the letter moves one place to the right
    if length > 1:
        rows = np.repeat(np.arange(n), length).reshape(n, length)
        first = np.concatenate((np.ones((n, 1), bool), letters[:, 1:] != letters[:, :-1]), axis=1)  # of equal neighbours one is enough
        yield -1, rows[first], _mixed(shorter[first])
    step = max(1, probed // (n * len(LETTERS)))
    for lo in range(0, length, step):
        part = letters[:, lo:lo + step]
        many = (len(LETTERS) - part.astype(np.int64)).ravel()
        at = np.repeat(np.arange(part.size), many)
        more = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(many) - many, many)
        rows, places = at // part.shape[1], at % part.shape[1] + lo
        yield 0, rows, _mixed(whole[rows] + more.astype(np.uint64) * powers[places])


def _inverse() -> np.uint64:
    return np.uint64(pow(int(_FACTOR), -1, 1 << 64))


def _probe_task(filters: Callable[[], dict[int, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shard = filters()
        for batch in batches:
            words, own = batch["word"].to_pylist(), batch["hash"].to_numpy()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                same = np.flatnonzero(lengths == length)
                step = max(1, PROBED // (length * len(LETTERS) // 2))
                for lo in range(0, len(same), step):
                    at = same[lo:lo + step]
                    letters = np.stack([codes(words[i]) for i in at])
                    for change, rows, hashes in edits(letters):
                        words_of = of_shard.get(shard(length + change))
                        if words_of is None:
                            continue
                        hit = bloom.probe(words_of, hashes)
                        if len(hit):
                            arrays = [pa.array(own[at[rows[hit]]]), pa.array(hashes[hit].view(np.int64))]
                            yield pa.RecordBatch.from_arrays(arrays, ["hash", "edit"])

    return apply


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words one edit apart, in both directions.

    ``vocabulary`` has (word, n), words of letters without repeats.
    """
    hashed = staged(vocabulary.mapInArrow(_hash_task, "word string, n bigint, shard bigint, hash bigint"))
    sizes = {r["shard"]: r["count"] for r in hashed.groupBy("shard").count().collect()}
    filters = hashed.sparkSession.sparkContext.broadcast(bloom.build(hashed.select("shard", "hash"), sizes))
    met = hashed.select("word", "hash").mapInArrow(_probe_task(lambda: filters.value), "hash bigint, edit bigint").distinct()
    right = hashed.select(F.col("hash").alias("edit"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = met.join(right, "edit").join(hashed.select("hash", "word", "n"), "hash")
    pairs = staged(pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct())
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of each word lead. A form is far more frequent than its word, so paths end."""
    found = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        found = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return found


def group(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of a vocabulary (word, n).

    The form is the most frequent word one edit away, the first in order of code points among equals,
    if it is at least ``times`` as frequent; the root is the last form on the way from a word.
    """
    pairs = near_pairs(vocabulary)
    best = F.max(F.struct("near_n")).getField("near_n")
    of_word = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("most"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("near"))
    joined = vocabulary.join(of_word, "word", "left")
    is_form = F.col("most") >= times * F.col("n")
    named = staged(joined.select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("most")).alias("form_n")))
    roots = _roots(named.where("form is not null"))
    out = named.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, rarest: int = RAREST) -> DataFrame:
    """The groups of all words that occur at least ``rarest`` times in ``docs``."""
    return group(staged(word_counts(docs).where(F.col("n") >= rarest)))
