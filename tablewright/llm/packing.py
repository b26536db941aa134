"""Documents packed into sequences by Karmarkar-Karp multiway differencing.

Each task packs its documents in blocks, so nothing is shuffled and a block bounds what is held. In a
block, every document begins as a partial partition: its size in one window, none in the others. The
two partitions with the largest difference between their fullest and emptiest window merge, the full
windows of one onto the empty ones of the other, until one partition is left: windows of nearly equal
size. The window count starts at the least that could do and rises whenever a window exceeds capacity.

What differencing leaves is evened out by cutting: documents longer than a window, and as many of the
longest others as that takes, are cut to fill the windows up; the rest of them gives full windows. The
block's last tokens, fewer than a window, go into sequences of a power of two, which need no padding.

Defined cases: a null or empty text has the end token alone; null and repeated ids are packed row by
row; other columns are ignored; an empty table gives no sequences. Sequence ids are the task's number
and a running number, so a task that runs again gives the same ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteTokens, broadcast_tokens

CAPACITY, END = 2048, 1
#: A block ends with so many documents or tokens.
BLOCK_DOCS, BLOCK_TOKENS = 4_096, 4_000_000


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item, such that the sums of the windows come out nearly equal.

    A partition holds the sums of its windows that are not empty, in falling order, and for each
    the node of a tree of merged items.
    """
    parent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes = len(sizes)
    # the difference, negative; a number that settles ties; sums; nodes
    heap = [(-int(s) if windows > 1 else 0, i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        shared = len(a) + len(b) - windows  # windows that are not empty on both sides
        if shared > 0:
            left, right = of_a[len(a) - shared:], of_b[len(b) - shared:][::-1]
            both = np.arange(nodes, nodes + shared)
            nodes += shared
            parent.append((both, left, right))
            sums = np.concatenate((a[:len(a) - shared], b[:len(b) - shared], a[len(a) - shared:] + b[len(b) - shared:][::-1]))
            names = np.concatenate((of_a[:len(a) - shared], of_b[:len(b) - shared], both))
        else:
            sums, names = np.concatenate((a, b)), np.concatenate((of_a, of_b))
        order = np.argsort(-sums, kind="stable")
        sums, names = sums[order], names[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, turn, sums, names))
        turn += 1
    window = np.zeros(nodes, np.int64)
    if heap:
        window[heap[0][3]] = np.arange(len(heap[0][3]))
    for both, left, right in reversed(parent):
        window[left] = window[both]
        window[right] = window[both]
    return window[:len(sizes)]


def windows_of(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item of at most ``capacity``, and how many windows there are."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, count)
        if not len(sizes) or np.bincount(window, sizes, count).max() <= capacity:
            return window, count
        count += 1 + count // 64


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Pieces of documents of these sizes: ``doc``, ``start``, ``length``, ``sequence`` and ``offset``, by sequence and offset."""
    by_size = np.argsort(-sizes, kind="stable")
    sums = np.cumsum(sizes[by_size])
    total = int(sums[-1])
    cut = max(int((sizes > capacity).sum()), int(np.searchsorted(sums, total // 20)))
    while True:  # documents to cut, longest first, until they fill all windows of the others
        whole = by_size[cut:]
        window, count = windows_of(sizes[whole], capacity) if len(whole) else (np.zeros(0, np.int64), 0)
        spare, room = int(sums[cut - 1]) if cut else 0, count * capacity - int(sizes[whole].sum())
        if spare >= room or not len(whole):
            break
        cut = min(len(sizes), max(cut + 1, int(np.searchsorted(sums, spare + 5 * (room - spare) // 4)) + 1))

    placed = np.argsort(window, kind="stable")
    whole, window = whole[placed], window[placed]
    fill = np.bincount(window, sizes[whole], count).astype(np.int64)
    before = np.cumsum(sizes[whole]) - sizes[whole]
    offset = before - (np.cumsum(fill) - fill)[window]

    # the tokens of the cut documents, one after the other, meet the room that is left
    left = spare - room
    tail = left % capacity
    powers = np.array([1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1], np.int64)
    rooms = np.concatenate((capacity - fill, np.full(left // capacity, capacity), powers))
    of_docs = by_size[:cut]
    doc_ends, room_ends = np.cumsum(sizes[of_docs]), np.cumsum(rooms)
    ends = np.union1d(doc_ends, room_ends[rooms > 0])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    doc, seq = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(room_ends, starts, "right")
    filled = np.concatenate((fill, np.zeros(len(rooms) - count, np.int64)))
    pieces = {
        "doc": np.concatenate((whole, of_docs[doc])),
        "start": np.concatenate((np.zeros(len(whole), np.int64), starts - (doc_ends - sizes[of_docs])[doc])),
        "length": np.concatenate((sizes[whole], ends - starts)),
        "sequence": np.concatenate((window, seq)),
        "offset": np.concatenate((offset, starts - (room_ends - rooms)[seq] + filled[seq])),
    }
    order = np.lexsort((pieces["offset"], pieces["sequence"]))
    return {name: values[order] for name, values in pieces.items()}


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END,
    block_docs: int = BLOCK_DOCS, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The pieces of all documents: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    A document's tokens are its ids by the tokenizer file at ``path`` and the id ``end``. Each lies in
    one piece, at ``offset`` of its sequence. ``ids`` are the piece's, as little-endian unsigned 32-bit
    numbers.
    """
    tokens = broadcast_tokens(docs.sparkSession, ByteTokens(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return rows.mapInArrow(_pack_task(lambda: tokens.value, capacity, end, block_docs, block_tokens), schema)


def _pack_task(
    tokens: Callable[[], ByteTokens], capacity: int, end: int, block_docs: int, block_tokens: int,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = tokens(), np.array([end], np.uint32)
        first = TaskContext.get().partitionId() << 33
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        n_tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, n_tokens
            sizes = np.array(list(map(len, held)), np.int64)
            found = pack_block(sizes, capacity)
            doc, start, length = found["doc"], found["start"], found["length"]
            ids = [held[d][s:s + n].astype("<u4", copy=False).tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(names).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]),
                pa.array(found["sequence"] + first), pa.array(found["offset"]), pa.array(ids, pa.binary()),
            ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            first += int(found["sequence"].max()) + 1
            held.clear()
            names.clear()
            n_tokens = 0

        for batch in batches:
            texts, begun = batch["text"], 0
            for at in range(len(batch)):
                held.append(np.concatenate((encoder.ids(texts[at].as_py().decode("utf-8", "replace")), last)))
                n_tokens += len(held[-1])
                if len(held) >= block_docs or n_tokens >= block_tokens:
                    names.append(batch["doc_id"].slice(begun, at + 1 - begun))
                    begun = at + 1
                    yield from flush()
            if begun < len(batch):
                names.append(batch["doc_id"].slice(begun))
        if held:
            yield from flush()

    return apply


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece."""
    return pack(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
