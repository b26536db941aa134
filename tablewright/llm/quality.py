"""Quality by the votes of nearest labelled texts in a latent-semantic space.

A text's terms are its words, their shapes (runs of lower case, upper case, digits, each mark),
pairs of neighbouring shapes, and marks for words and lines that come again; they are hashed,
counted as rates and weighted by inverse document frequency. The space is the leading singular
vectors of a bounded sample of labelled texts, whose vectors go to every worker. Each text is
compared with all of them by exact cosine products in blocks; the nearest vote by similarity.

Defined cases: a text without words (null and empty ones too) has the zero vector and scores the
share of label 1, as all texts do where there are no labels of both classes, or 0 without labels;
ties go to the earlier sample row; rows may repeat; ids without labels, and labels without texts,
are not learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import label_fold, labelled_sample, per_text, staged, unused

TERMS = 4_096
#: Bounds of the sample that is learnt from.
TRAIN_ROWS, TRAIN_MB = 4_000, 24
RANK, NEIGHBOURS, SHARPNESS = 32, 15, 8
THRESHOLD = 0.3
BLOCK = 256
CACHED = 200_000

_SHAPES = bytes(
    0x61 if 0x61 <= b <= 0x7A or b >= 0xC0 else 0 if b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b
    for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)

TERM_SCHEMA = T.StructType([T.StructField("rates", T.BinaryType())])


def _hashed(kind: bytes, term: bytes) -> int:
    return xxhash.xxh32_intdigest(kind + term) % TERMS


class _Words(dict):
    """Shape and word of each token seen, hashed and packed."""

    def __missing__(self, token: bytes) -> int:
        shape = _RUN.sub(rb"\1", token.translate(_SHAPES).replace(b"\0", b""))[:12]
        value = _hashed(b"s", shape) << 32 | _hashed(b"w", token.lower())
        if len(token) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[token] = value
        return value


def rates(raw: bytes, known: _Words) -> np.ndarray:
    """Square roots of the terms' rates."""
    tokens = raw.split()
    counts = np.zeros(TERMS)
    if not tokens:
        return counts.astype(np.float32)
    codes = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    shapes, words = codes >> 32, codes & 0xFFFFFFFF
    pairs = (shapes[:-1] * 2_654_435_761 + shapes[1:] * 40_503) % TERMS
    for terms in (shapes, words, pairs):
        counts += np.bincount(terms, minlength=TERMS)
    counts[_hashed(b"again", b"word")] += sum(map(bytes.__eq__, tokens[1:], tokens))
    lines, again = set(), 0
    for line in raw.split(b"\n"):
        line = line.strip()
        if line in lines:
            again += max(1, len(line.split()))
        lines.add(line)
    counts[_hashed(b"again", b"line")] += again
    return np.sqrt(counts / counts.sum()).astype(np.float32)


class Model(NamedTuple):
    """``project`` takes rates into the space; the sample's unit vectors and labels; the share of label 1."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def train(rows: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """``rows`` of rates are changed in place."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, share)
    weight = (np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))) + 1).astype(np.float32)
    rows *= weight
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    np.divide(rows, size, out=rows, where=size > 0)
    # the leading singular vectors, by power steps on a random block
    basis = np.random.default_rng(seed).normal(size=(TERMS, RANK + 10)).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(rows.T @ np.linalg.qr(rows @ basis)[0])[0]
    _, _, right = np.linalg.svd(rows @ basis, full_matrices=False)
    directions = basis @ right[:RANK].T
    return Model((weight[:, None] * directions).astype(np.float32), _unit(rows @ directions).astype(np.float32), labels, share)


def vote(rows: np.ndarray, model: Model) -> np.ndarray:
    """The score of each row of rates: labels of the nearest, weighted by a power of the cosine."""
    points = _unit(rows @ model.project)
    if not len(model.vectors):
        return np.full(len(rows), model.share)
    cosines = points @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    # ties by the place in the sample
    nearest = np.argpartition(-cosines.astype(np.float64) + np.arange(cosines.shape[1]) * 1e-12, k - 1, axis=1)[:, :k]
    weights = np.clip(np.take_along_axis(cosines, nearest, axis=1), 0, None).astype(np.float64) ** SHARPNESS
    total = weights.sum(axis=1)
    votes = (weights * model.labels[nearest]).sum(axis=1)
    return np.divide(votes, total, out=np.full(len(rows), model.share), where=total > 0)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", most_rows: int = TRAIN_ROWS, megabytes: int = TRAIN_MB) -> Broadcast:
    """A model learnt from the labels that ``allowed`` lets through."""
    sample = labelled_sample(docs, labels, label, allowed, most_rows, megabytes)

    def start() -> Callable[[bytes], tuple]:
        known = _Words()
        return lambda raw: (rates(raw, known).tobytes(),)

    # read part by part, to hold the sample once
    found = staged(per_text(sample, TERM_SCHEMA, start, ("doc_id", "y")))
    order = found.select("doc_id", "y").orderBy("doc_id", "y").collect()
    places: dict[tuple, list[int]] = {}
    for i, r in enumerate(order):
        places.setdefault(tuple(r), []).append(i)
    table = np.zeros((len(order), TERMS), np.float32)
    for r in found.toLocalIterator():
        table[places[r["doc_id"], r["y"]].pop()] = np.frombuffer(r["rates"], np.float32)
    model = train(table, np.array([r["y"] for r in order], dtype=np.float64))
    return docs.sparkSession.sparkContext.broadcast(model)


def _score_column(model: Broadcast) -> Column:
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Words()
        for batch in batches:
            parts = []
            for at in range(0, len(batch), BLOCK):
                block = np.stack([rates(v.as_py(), known) for v in batch[at:at + BLOCK]])
                parts.append(vote(block, model.value))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), type=pa.float64())

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return F.arrow_udf(apply, T.DoubleType()).asNondeterministic()(raw)


def score(docs: DataFrame, model: Broadcast) -> DataFrame:
    """(doc_id, score) of each whole text."""
    return docs.select("doc_id", _score_column(model).alias("score"))


def score_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted); a fold of ids, by checksum, is not learnt from."""
    held_out = F.coalesce(label_fold("doc_id", folds) == left_out, F.lit(False))
    model = fit(docs, labels, label_fold("doc_id", folds) != left_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, left_out: int = 0) -> DataFrame:
    """``docs`` that score THRESHOLD or more; all of them where there is nothing to learn from."""
    model = fit(docs, labels, label_fold("doc_id", folds) != left_out)
    if not len(model.value.vectors):
        return docs
    name = unused("quality_score", docs)
    return docs.withColumn(name, _score_column(model)).where(F.col(name) >= THRESHOLD).select(*docs.columns)
