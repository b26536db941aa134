"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of the n-grams of its letters (in UTF-8) and itself, hashed into buckets; its vector is the mean
of the buckets' embeddings, a text's vector the mean of its words'. Embeddings and the softmax
are trained together in numpy by AdaGrad with a falling rate, on a bounded sample of labelled
texts. A misspelled word shares most n-grams with the word it stands for.

Before training, buckets in fewer than ``MIN_TEXTS`` texts of the sample are left out, and in each
step a random half of a text's buckets. For scoring, embeddings and softmax fold into one weight
for each bucket, and a word's weight is kept in a bounded cache.

Defined cases: a text without words (null and empty ones too) scores by the bias alone; without
labels of both classes every score is the share of label 1, or 0 without labels; rows may
repeat; ids without labels, and labels without texts, are not learnt from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from math import exp
from typing import NamedTuple

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import label_fold, labelled_sample, letter_words, per_text, staged, unused, with_result

BUCKETS = 1 << 16
SHORTEST, LONGEST = 4, 7
#: Bounds of the sample that is learnt from.
TRAIN_ROWS, TRAIN_MB = 8_000, 32
DIM, EPOCHS, BATCH, RATE, SCALE, DROP, MIN_TEXTS = 8, 9, 32, 0.5, 60.0, 0.5, 3
THRESHOLD = 0.3
#: Weights travel as 16-bit numbers, times this.
FINE = 1024
CACHED = 200_000

BAG_SCHEMA = T.StructType([T.StructField("buckets", T.BinaryType()), T.StructField("weights", T.BinaryType())])
SCORE_SCHEMA = T.StructType([T.StructField("score", T.DoubleType())])

Bag = tuple[np.ndarray, np.ndarray]


def subwords(words: list[bytes]) -> Bag:
    """Buckets of the words' n-grams of bytes, their ends marked, and of whole words; the word of each."""
    sizes = np.array([len(w) + 2 for w in words])
    marked = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(marked))
    buckets = [_spread(np.array([zlib.crc32(w) for w in words], np.uint32))]
    owners = [np.arange(len(words))]
    rolling = marked
    for n in range(2, LONGEST + 1):
        rolling = rolling[:-1] * np.uint32(65_599) + marked[n - 1:]
        if n >= SHORTEST:
            inside = left[:len(rolling)] >= n
            buckets.append(_spread(rolling[inside] + np.uint32(n)))
            owners.append(owner[:len(rolling)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _spread(hashes: np.ndarray) -> np.ndarray:
    """The upper half of a product: 16 bits."""
    return (hashes * np.uint32(2_654_435_761)) >> np.uint32(16)


def bag(raw: bytes) -> Bag:
    """Distinct buckets of a text and their weights, which add up to 1."""
    counts = Counter(letter_words(raw))
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    buckets, owners = subwords(list(counts))
    shares = np.array(list(counts.values())) / sum(counts.values()) / np.bincount(owners)
    total = np.bincount(buckets, shares[owners], BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found].astype(np.float32)


class Sample(NamedTuple):
    """Bags of the labelled texts, one after the other: text i has the entries from offset i to the next."""

    buckets: np.ndarray
    weights: np.ndarray  # 16-bit numbers, times FINE
    offsets: np.ndarray
    labels: np.ndarray


class Model(NamedTuple):
    """The log-odds of a text: the mean over words of the mean weight of their buckets, plus a bias."""

    weights: np.ndarray
    bias: float


def train(sample: Sample, seed: int = 7) -> Model:
    labels, n = sample.labels, len(sample.labels)
    share = float(labels.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), np.inf if share else -np.inf)
    rng = np.random.default_rng(seed)
    texts = np.zeros(BUCKETS, np.int64)
    for i in range(n):
        texts[sample.buckets[sample.offsets[i]:sample.offsets[i + 1]]] += 1
    often = texts >= (MIN_TEXTS if n >= 100 else 1)
    rows = np.flatnonzero(np.diff(sample.offsets))
    embeddings = rng.normal(0, 0.1 / np.sqrt(DIM), (BUCKETS, DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, seen_softmax, seen_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    slot = np.zeros(BUCKETS, np.int64)
    steps, step = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for start in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            batch = order[start:start + BATCH]
            spans = [slice(sample.offsets[i], sample.offsets[i + 1]) for i in batch]
            buckets = np.concatenate([sample.buckets[s] for s in spans])
            kept = often[buckets] & (rng.random(len(buckets), np.float32) >= DROP)
            buckets = buckets[kept]
            if not len(buckets):
                continue
            row = np.repeat(np.arange(len(batch)), [s.stop - s.start for s in spans])[kept]
            w = np.concatenate([sample.weights[s] for s in spans])[kept] * np.float32(SCALE / (1 - DROP) / FINE)
            sizes = np.bincount(row, minlength=len(batch))
            starts = np.minimum(np.cumsum(sizes) - sizes, len(buckets) - 1)
            means = np.add.reduceat(embeddings[buckets] * w[:, None], starts, axis=0)
            means[sizes == 0] = 0
            logits = means @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            to_means, to_softmax, to_bias = p @ softmax.T, means.T @ p, p.sum(axis=0)
            used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
            slot[used] = np.arange(len(used))
            place, each = slot[buckets], to_means[row] * w[:, None]
            grad = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(DIM)], axis=1)
            seen[used] += (grad**2).mean(axis=1)
            embeddings[used] -= (rate * grad / np.sqrt(seen[used])[:, None]).astype(np.float32)
            seen_softmax += to_softmax**2
            softmax -= (0.2 * rate * to_softmax / np.sqrt(seen_softmax)).astype(np.float32)
            seen_bias += to_bias**2
            bias -= (0.2 * rate * to_bias / np.sqrt(seen_bias)).astype(np.float32)
    folded = SCALE * (embeddings @ (softmax[:, 1] - softmax[:, 0]))
    folded[~often] = 0
    return Model(folded.astype(np.float32), float(bias[1] - bias[0]))


def _scorer(model: Broadcast) -> Callable[[bytes], tuple]:
    weights, bias = model.value
    known: dict[bytes, float] = {}

    def one(raw: bytes) -> tuple:
        words = letter_words(raw)
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list(set(words))
        if new:
            buckets, owners = subwords(new)
            known.update(zip(new, (np.bincount(owners, weights[buckets]) / np.bincount(owners)).tolist()))
        return (_odds(float(bias) + _mean(words, known)),)

    return one


def _mean(words: list[bytes], weights: dict[bytes, float]) -> float:
    return sum(map(weights.__getitem__, words)) / len(words) if words else 0.0


def _odds(x: float) -> float:
    return 0.0 if x < -700 else 1 / (1 + exp(-x))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", most_rows: int = TRAIN_ROWS, megabytes: int = TRAIN_MB) -> Broadcast:
    """A model learnt from the labels that ``allowed`` lets through."""
    sample = labelled_sample(docs, labels, label, allowed, most_rows, megabytes)

    def start() -> Callable[[bytes], tuple]:
        def one(raw: bytes) -> tuple:
            buckets, weights = bag(raw)
            return buckets.astype(np.uint16).tobytes(), (weights * FINE).astype(np.float16).tobytes()
        return one

    found = staged(per_text(sample, BAG_SCHEMA, start, ("doc_id", "y")))
    return docs.sparkSession.sparkContext.broadcast(train(_gather(found)))


def _gather(found: DataFrame) -> Sample:
    """Bags in the order of their ids, read part by part into arrays of their final size."""
    entries = (F.octet_length("buckets") / 2).cast("int").alias("n")
    order = found.select("doc_id", "y", entries).orderBy("doc_id", "y", "n").collect()
    offsets = np.concatenate(([0], np.cumsum([r["n"] for r in order], dtype=np.int64)))
    places: dict[tuple, list[int]] = {}
    for i, r in enumerate(order):
        places.setdefault(tuple(r), []).append(i)
    out = Sample(np.zeros(offsets[-1], np.uint16), np.zeros(offsets[-1], np.float16), offsets, np.array([r["y"] for r in order], np.int64))
    for r in found.toLocalIterator():
        i = places[r["doc_id"], r["y"], len(r["buckets"]) // 2].pop()
        out.buckets[offsets[i]:offsets[i + 1]] = np.frombuffer(r["buckets"], np.uint16)
        out.weights[offsets[i]:offsets[i + 1]] = np.frombuffer(r["weights"], np.float16)
    return out


def score(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, score) of each whole text."""
    return per_text(docs, SCORE_SCHEMA, lambda: _scorer(model))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted); a fold of ids, by checksum, is not learnt from."""
    held_out = F.coalesce(label_fold("doc_id", folds) == left_out, F.lit(False))
    model = fit(docs, labels, label_fold("doc_id", folds) != left_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, left_out: int = 2) -> DataFrame:
    """``docs`` without those that score THRESHOLD or more; all of them where there is nothing to learn from."""
    model = fit(docs, labels, label_fold("doc_id", folds) != left_out)
    if np.isinf(model.value.bias):
        return docs
    name = unused("toxicity", docs)
    scored = with_result(docs, "text", name, SCORE_SCHEMA, lambda: _scorer(model))
    return scored.where(F.col(f"{name}.score") < THRESHOLD).select(*docs.columns)
