"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Vectors of one length, as long as they are no more than an even bucket, are all compared. For more,
a rotation is learnt on a bounded sample so that the signs of the rotated vectors are balanced
bits that lose little (principal directions first, then alternating between the nearest binary
codes and the best rotation for them); vectors with fewer than 64 components get the sides of
random planes as further bits, for the tables to differ. Each table keys the codes by some of their bits; vectors
with equal keys meet, and their cosines are taken from the original vectors in double precision.
A pair counts in the first table in which it meets, so that nothing is counted twice.

The bits of a key rise with the number of vectors, so that an even bucket keeps its size; the
number of tables follows from the share of pairs at the very threshold that should meet, tried on
drawn pairs, as tables share bits. A bucket
that is still large is cut into parts, and each pair of parts is a task. Equal vectors are one class
with a weight. Tasks return link counts and a spanning forest, not pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing,
nor do vectors of different lengths; ids may repeat or be null; a component takes its smallest id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, ceil, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import staged, with_parts
from .simhash import _join_labels

COSINE = 0.9
#: Vectors learnt from, and rounds of learning.
TRAIN_ROWS, ROUNDS = 10_000, 30
#: Share of pairs at the threshold itself that should meet in a table; pairs above it meet more often. Pairs tried.
MEET, TRIED = 0.98, 20_000
#: Bits of a code.
CODE = 64
#: Vectors of an even bucket, least bits of a key, vectors of a part of a large bucket, rows compared at once.
EVEN, LEAST_BITS, PART, BLOCK = 4_096, 8, 4_096, 512

LINK_SCHEMA = "id bigint, other bigint, n bigint"


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """A matrix that takes a unit vector to ``bits`` numbers, whose signs are its code."""
    _, _, directions = np.linalg.svd(sample, full_matrices=False)
    basis = directions[:bits].T
    flat = sample @ basis
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1],) * 2))[0]
    for _ in range(rounds):
        codes = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ flat)
        rotation = (left @ right).T
    return basis @ rotation


def planes(sample: np.ndarray, bits: int = CODE, seed: int = 7) -> np.ndarray:
    """A matrix whose columns give ``bits`` signs: a learnt rotation, and random planes where it has fewer."""
    learnt = learn_rotation(sample, bits, seed=seed)
    more = np.random.default_rng(seed + 1).normal(size=(sample.shape[1], bits - learnt.shape[1]))
    return np.hstack([learnt, more])


def tables(n: int, bits: int, cosine: float = COSINE, seed: int = 7) -> list[int]:
    """Masks of the bits that key each table, for ``n`` vectors.

    A pair at the threshold differs in each bit by its angle's share of a half turn.
    """
    width = min(bits // 3, max(LEAST_BITS, ceil(log2(max(n, 1) / EVEN))))
    rng, masks, left = np.random.default_rng(seed), [], []
    apart = rng.random((TRIED, bits)) < acos(cosine) / pi
    missed = np.ones(TRIED, bool)
    while missed.mean() > 1 - MEET:
        if len(left) < width:  # each bit serves once before any serves again
            left = [*left, *(int(b) for b in rng.permutation(bits))]
        key, left = sorted(set(left[:width])), left[width:]
        masks.append(sum(1 << b for b in key))
        missed &= apart[:, key].any(axis=1)
    return masks


def _unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _code(project: np.ndarray) -> Callable[[Column], Column]:
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places = np.uint64(1) << np.arange(project.shape[1], dtype=np.uint64)
        for batch in batches:
            signs = _unit_rows(batch, project.shape[0]) @ project >= 0
            yield pa.array((signs * places).sum(axis=1, dtype=np.uint64).view(np.int64))

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(apply, T.LongType())


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compare(dim: int, masks: list[int], cosine: float) -> Callable[[pa.Table], pa.Table]:
    """Links among the rows of one bucket, or between two of its parts."""
    bits = np.array(masks, dtype=np.uint64)

    def apply(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        part = table["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        units = _unit_rows(table["embedding"], dim)[order]
        codes = table["code"].to_numpy()[order].view(np.uint64)
        weights, ids = table["weight"].to_numpy()[order], table["id"].to_numpy()[order]
        n = len(ids)
        split = int(np.searchsorted(part[order], part[order][0], side="right"))  # n, if there is one part only
        counts, labels = np.zeros(n), np.arange(n)
        for at in range(0, split, BLOCK):
            past = min(split, at + BLOCK)
            first = at + 1 if split == n else split
            a, b = np.nonzero(units[at:past] @ units[first:].T >= cosine)
            a, b = a + at, b + first
            if split == n:
                a, b = a[b > a], b[b > a]
            differ = codes[a] ^ codes[b]
            fresh = np.ones(len(a), bool)
            for mask in bits[:kind]:
                fresh &= (differ & mask) != 0
            a, b = a[fresh], b[fresh]
            counts += np.bincount(a, weights[b], n) + np.bincount(b, weights[a], n)
            if len(a):
                labels = _join_labels(labels, a, b)
        linked = np.flatnonzero(counts)
        return pa.table({"id": ids[linked], "other": ids[labels[linked]], "n": counts[linked].astype(np.int64)})

    return apply


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(id, other, n): parts of a class's link count, and an edge of a spanning forest."""
    out = None
    for row in classes.groupBy("dim").count().orderBy("dim").collect():
        of_dim = classes.where(F.col("dim") == row["dim"])
        if row["count"] <= EVEN:  # one bucket
            masks, code = [0], F.lit(0).cast("bigint")
        else:
            sample = of_dim.orderBy("id").limit(TRAIN_ROWS).select("embedding").toArrow()
            masks, code = tables(row["count"], CODE, cosine), _code(planes(_unit_rows(sample["embedding"], row["dim"])))("embedding")
        coded = of_dim.select("id", "weight", "embedding", code.alias("code"))
        keys = F.array(*(F.struct(F.lit(i).alias("kind"), F.col("code").bitwiseAND(F.lit(_signed(m))).alias("common")) for i, m in enumerate(masks)))
        codes = staged(coded.select("id", "code"))
        found = _meet(of_dim.join(codes, "id"), codes, keys).groupBy("root").applyInArrow(_compare(row["dim"], masks, cosine), LINK_SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else classes.sparkSession.createDataFrame([], LINK_SCHEMA)


def _meet(vectors: DataFrame, codes: DataFrame, keys: Column) -> DataFrame:
    """A row for each vector and task that it takes part in."""
    sizes = codes.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.common").count()
    keyed = vectors.select("*", F.explode(keys).alias("k")).select("id", "weight", "embedding", "code", "k.kind", "k.common")
    cut = with_parts(keyed, sizes, ["kind", "common"], PART)
    cut = cut.withColumn("part", F.pmod(F.xxhash64(F.col("id")), F.col("parts")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    return cut.withColumn("m", F.explode(met)).select(
        "id", "weight", "embedding", "code", "kind", "part", F.xxhash64("kind", "common", "m.i", "m.j").alias("root"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("id", F.when(valid, F.xxhash64("embedding")))
    found = rows.where("id is not null")
    classes = staged(
        found.groupBy("id", "embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least")).withColumn("dim", F.size("embedding"))
    )
    forest = staged(links(classes, cosine))
    linked = forest.groupBy("id").agg(F.sum("n").alias("n"))
    trees = components(forest.select("id", "other"))
    rooted = classes.select("id", "weight", "least").join(linked, "id", "left").join(trees.withColumnRenamed("node", "id"), "id", "left")
    rooted = staged(rooted.select("id", "weight", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component")))
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(smallest, "component").select("id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "id").join(of_class, "id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
