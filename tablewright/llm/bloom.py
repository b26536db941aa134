"""Split-block Bloom filters over 64-bit hashes, built by Spark tasks and probed in numpy.

A filter is cut into blocks of eight 32-bit words; a hash picks a block and sets one bit in each of its
words. Tasks build ranges of blocks; only the finished words come together, and ``most`` bounds them.
A fuller filter lets more wrong hashes pass, but never loses one that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The odd factors that choose the bit in each word of a block.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
#: Bits for each hash, and the bytes that a filter has at most.
BITS_EACH, MOST = 16, 64 << 20
#: Blocks that one task fills.
RANGE = 1 << 8


def blocks_for(n: int, bits: int = BITS_EACH, most: int = MOST) -> int:
    """How many blocks of 32 bytes a filter of ``n`` hashes has."""
    return max(1, min(-(-n * bits // 256), most // 32))


def _places(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32)


def _bit(hashes: np.ndarray, word: int) -> np.ndarray:
    return np.uint32(1) << ((hashes.astype(np.uint32) * SALTS[word]) >> np.uint32(27))


def add(words: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> None:
    """Set the bits of ``hashes`` in ``words``, of shape (blocks, 8), at the blocks ``places``."""
    for w in range(8):
        np.bitwise_or.at(words[:, w], places, _bit(hashes, w))


def probe(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` the filter may hold, as positions. Most wrong ones go after a word or two."""
    at = np.arange(len(hashes))
    places = _places(hashes, len(words)).astype(np.int64)
    for w in range(8):
        hit = (words[places, w] & _bit(hashes, w)) != 0
        at, hashes, places = at[hit], hashes[hit], places[hit]
    return at


def may_hold(hashes: F.Column, words: Broadcast) -> F.Column:
    """Whether the filter that was sent may hold each row's hash."""
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            hit[probe(words.value, batch.to_numpy().view(np.uint64))] = True
            yield pa.array(hit)

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(apply, "boolean")(hashes)


def build(rows: DataFrame, sizes: dict[int, int], bits: int = BITS_EACH, most: int = MOST) -> dict[int, np.ndarray]:
    """A filter for each shard. ``rows`` has ``shard`` and ``hash``; ``sizes`` says how many rows a shard has."""
    if not sizes:
        return {}
    blocks = {s: blocks_for(n, bits, most) for s, n in sizes.items()}
    pairs = [F.lit(x) for s, n in blocks.items() for x in (s, n)]
    # 32 bits times the number of blocks stays below 63 bits
    place = F.shiftright(F.shiftrightunsigned("hash", 32) * F.create_map(*pairs)[F.col("shard")], 32)
    placed = rows.select("shard", "hash", place.alias("place")).withColumn("part", F.floor(F.col("place") / RANGE))
    folds = placed.repartition("shard", "part").sortWithinPartitions("shard", "part")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None
        for batch in batches:
            keys = batch["shard"].to_numpy() << 32 | batch["part"].to_numpy()
            hashes, places = batch["hash"].to_numpy().view(np.uint64), batch["place"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != now:
                    if now is not None:
                        yield _row(now, words)
                    now, words = keys[lo], np.zeros((RANGE, 8), np.uint32)
                add(words, hashes[lo:hi], places[lo:hi] % RANGE)
        if now is not None:
            yield _row(now, words)

    filters = {s: np.zeros((n, 8), np.uint32) for s, n in blocks.items()}
    filled = folds.mapInArrow(fill, "shard bigint, part bigint, words binary").toArrow()
    for batch in filled.to_batches():
        for shard, part, raw in zip(batch["shard"].to_pylist(), batch["part"].to_pylist(), batch["words"]):
            own = filters[shard][part * RANGE:(part + 1) * RANGE]
            own |= np.frombuffer(raw.as_buffer(), np.uint32).reshape(-1, 8)[:len(own)]
    return filters


def _row(key: int, words: np.ndarray) -> pa.RecordBatch:
    shard, part = int(key) >> 32, int(key) & 0xFFFFFFFF
    return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([part]), pa.array([words.tobytes()], pa.binary())], ["shard", "part", "words"])
