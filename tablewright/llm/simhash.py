"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has a bit for each of 64 majority votes among the hashes of its shingles.
Equal fingerprints form one class at once. Classes link at few differing bits: node pairs of a
binary trie are followed downwards together, their differing bits added up, and a pair is dropped
when these exceed the budget.

The trie is spread over tasks by its roots. With a budget of k bits, the 64 bits are cut into
k + a blocks, and two fingerprints within the budget agree on a blocks at least. Each choice of a
blocks roots one set of subtries: fingerprints that agree there. ``a`` rises with the number of
fingerprints, so that an even subtrie stays small. A subtrie that is still large is cut into parts,
and each pair of parts is one task's work. A task returns a spanning forest of its links, not all
pairs; pairs of nodes that lie in one tree already are dropped.

Defined cases: a text without words (null and empty ones too) has fingerprint 0 and links like any
other; null ids get a fingerprint, and the component of their class; rows may repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .components import components
from .shared import blank_words, per_text, staged, unused, with_parts, with_result

SHINGLE, BITS, SEED = 4, 4, 42
#: Fingerprints of an even subtrie, of a part of a large one, and of what a task holds at once.
EVEN, PART, AT_ONCE = 20_000, 10_000, 100_000
#: Node pairs with so few pairs of fingerprints are compared directly; so many are held at once.
DIRECT, HELD = 256, 65_536

_HASHES = 1 << 16
FINGERPRINT_SCHEMA = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 bits as a signed number; bit b is set if it is set in over half of the shingles' hashes."""
    words = blank_words(raw)
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - shingle + 1)
    first, past = starts[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        spans = zip(first[at:at + _HASHES], past[at:at + _HASHES])
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, min(_HASHES, n - at))
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each whole text."""
    def start() -> Callable[[bytes], tuple]:
        return lambda raw: (fingerprint(raw, shingle),)

    return per_text(docs, FINGERPRINT_SCHEMA, start)


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest row of its tree, after the trees of ``a`` and ``b`` grow together."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(labels, further := labels[labels]):
            labels = further


class Trie:
    """Rows sorted by (root, fingerprint); a node is a range of rows that share a root and a prefix."""

    def __init__(self, roots: np.ndarray, fps: np.ndarray, budget: int):
        self.fps, self.budget = fps, budget
        self.labels = np.arange(len(fps))
        starts = np.flatnonzero(np.concatenate(([True], roots[1:] != roots[:-1])))
        self.roots = starts, np.concatenate((starts[1:], [len(fps)]))
        near = np.flatnonzero((roots[1:] == roots[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= budget))
        self._link(near, near + 1)
        self.ones: dict[int, np.ndarray] = {}

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.labels = _join_labels(self.labels, a, b)
        self.changes = np.concatenate(([0], np.cumsum(self.labels[1:] != self.labels[:-1])))

    def _of_one_tree(self, a0, a1, b0, b1) -> np.ndarray:
        """Node pairs all of whose rows are in one tree."""
        whole = (self.changes[a0] == self.changes[a1 - 1]) & (self.changes[b0] == self.changes[b1 - 1])
        return whole & (self.labels[a0] == self.labels[b0])

    def _ones_before(self, bit: int) -> np.ndarray:
        if bit not in self.ones:
            set_bits = (self.fps >> np.uint64(bit)) & np.uint64(1)
            self.ones[bit] = np.concatenate(([0], np.cumsum(set_bits.astype(np.int64))))
        return self.ones[bit]

    def _compare(self, a0, a1, b0, b1) -> None:
        """All pairs of rows of small node pairs, a bounded number at once."""
        sizes = (a1 - a0) * (b1 - b0)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(HELD, sizes.sum() + HELD, HELD))
        for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
            n = sizes[lo:hi]
            if not n.sum():
                continue
            pair = np.repeat(np.arange(lo, hi), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = (b1 - b0)[pair]
            a, b = a0[pair] + k // wide, b0[pair] + k % wide
            close = (np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.budget) & (a != b)
            self._link(a[close], b[close])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links: rows and the smallest row of their trees."""
        lo, hi = self.roots
        stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
        while stack:
            bit, a0, a1, b0, b1, cost = stack.pop()
            keep = ((a1 - a0) * (b1 - b0) > (a0 == b0)) & ~self._of_one_tree(a0, a1, b0, b1)
            a0, a1, b0, b1, cost = (x[keep] for x in (a0, a1, b0, b1, cost))
            small = ((a1 - a0) * (b1 - b0) <= DIRECT) | (bit < 0)
            if small.any():
                self._compare(a0[small], a1[small], b0[small], b1[small])
                a0, a1, b0, b1, cost = (x[~small] for x in (a0, a1, b0, b1, cost))
            if not len(a0):
                continue
            if len(a0) > HELD:
                half = len(a0) // 2
                stack += [(bit, *(x[:half] for x in (a0, a1, b0, b1, cost))), (bit, *(x[half:] for x in (a0, a1, b0, b1, cost)))]
                continue
            ones = self._ones_before(bit)
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            children = (
                (a0, am, b0, bm, cost), (am, a1, bm, b1, cost), (a0, am, bm, b1, cost + 1),
                tuple(x[a0 != b0] for x in (am, a1, b0, bm, cost + 1)),
            )
            a0, a1, b0, b1, cost = (np.concatenate(x) for x in zip(*children))
            keep = (cost <= self.budget) & (a1 > a0) & (b1 > b0)
            stack.append((bit - 1, *(x[keep] for x in (a0, a1, b0, b1, cost))))
        rows = np.flatnonzero(self.labels != np.arange(len(self.labels)))
        return rows, self.labels[rows]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by root, some whole roots at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held and sum(map(len, held)) + len(table) > AT_ONCE:
            whole = pa.concat_tables([*held, table])
            roots = whole["root"].to_numpy()
            cut = int(np.searchsorted(roots, roots[-1]))
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _link_task(budget: int, carried: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            roots, fps = table["root"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((fps, roots))
            ends = [order[at] for at in Trie(roots[order], fps[order], budget).links()]
            columns = {f"{side}{name}": table[of].take(at) for of, name in [("fp", ""), *((c, f"_{c}") for c in carried)] for side, at in zip("ab", ends)}
            yield from pa.table(columns).to_batches(max_chunksize=AT_ONCE)
    return apply


def _masks(budget: int, agree: int) -> list[int]:
    """A mask of 64 bits for each choice of ``agree`` out of ``budget + agree`` blocks."""
    cuts = [round(64 * i / (budget + agree)) for i in range(budget + agree + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def trie_links(classes: DataFrame, budget: int = BITS, carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them for all components.

    ``classes`` has a column ``fp`` without repeats. Of each carried column ``c``, links have
    ``a_c`` and ``b_c``.
    """
    n = classes.count()
    agree = next((a for a in (1, 2) if n >> (64 * a // (budget + a)) <= EVEN), 3)
    masks = _masks(budget, agree)
    keys = F.array(*(F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("common")) for i, m in enumerate(masks)))
    rooted = classes.select("fp", *carried, F.explode(keys).alias("k")).select("fp", *carried, "k.kind", "k.common")
    cut = with_parts(rooted, rooted.groupBy("kind", "common").count(), ["kind", "common"], PART)
    # a row goes to one task for each other part, together with all of that part
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: (j != own) | (F.col("parts") == 1))
    met = F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    tasks = cut.select("fp", *carried, "kind", "common", F.explode(met).alias("m"))
    root = F.xxhash64("kind", "common", "m.i", "m.j")
    tasks = tasks.select("fp", *carried, root.alias("root"))
    dealt = tasks.repartition("root").sortWithinPartitions("root")
    types = ["a bigint, b bigint", *(f"a_{c} {t}, b_{c} {t}" for c in carried for t in [classes.schema[c].dataType.simpleString()])]
    return dealt.mapInArrow(_link_task(budget, carried), ", ".join(types))


def _node(least: str, fp: str) -> F.Column:
    """A class as a node: the smallest node of a component has its smallest id; null ids come last."""
    return F.struct(F.col(least).isNull().alias("none"), F.col(least).alias("least"), F.col(fp).alias("fp"))


def _grouped(docs: DataFrame, shingle: int, budget: int) -> DataFrame:
    """(doc_id, fp, component, component_id): a fingerprint that names the group, and its smallest id."""
    found = staged(fingerprints(docs, shingle))
    classes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = trie_links(classes, budget, ("least",)).select(_node("a_least", "a").alias("a"), _node("b_least", "b").alias("b"))
    trees = components(links).select(F.col("node.fp").alias("fp"), "component")
    root = F.coalesce("component", _node("least", "fp"))
    of_class = classes.join(trees, "fp", "left").select("fp", root.getField("fp").alias("component"), root.getField("least").alias("component_id"))
    return found.join(of_class, "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hexadecimal digits, and the smallest id that links reach."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped(docs, shingle, budget).select("doc_id", digits, "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id.

    Texts stay where they are: a Bloom filter of the ids that go, or repeat, keeps all rows that it
    can't hold, and only the others meet those ids in a join. Where an id repeats, the smallest of its
    fingerprints in the component decides, then the order of the texts and other columns. Rows without an
    id can't be named by a group; they stay.
    """
    groups = staged(_grouped(docs.select("doc_id", "text"), shingle, budget))
    own = F.col("doc_id") == F.col("component_id")
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(own).alias("first"))
    ids = staged(ids.where("n > 1 or not first"))
    hashed = F.xxhash64("doc_id")
    filters = bloom.build(ids.select(F.lit(0).cast("bigint").alias("shard"), hashed.alias("hash")), {0: max(1, ids.count())})
    maybe = bloom.may_hold(hashed, docs.sparkSession.sparkContext.broadcast(filters[0]))
    out = docs.where(F.col("doc_id").isNull() | ~maybe)
    passed = staged(docs.select("doc_id").where("doc_id is not null").where(maybe).join(ids, "doc_id", "left_anti"))
    if not passed.isEmpty():
        out = out.union(docs.where(maybe).join(passed, "doc_id", "left_semi").select(*docs.columns))
    ids = ids.where("first")
    repeated = ids.where("n > 1").select("doc_id")
    if not repeated.isEmpty():
        kept = groups.where(own).join(repeated, "doc_id", "left_semi").groupBy("component", "doc_id").agg(F.min("fp").alias("least"))
        name = unused("fingerprint", docs)
        rows = docs.join(repeated, "doc_id", "left_semi")
        rows = with_result(rows, "text", name, FINGERPRINT_SCHEMA, lambda: lambda raw: (fingerprint(raw, shingle),))
        row = F.struct(*docs.columns)
        one = rows.groupBy("doc_id", F.col(f"{name}.fp").alias("least")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
        out = out.union(one.join(kept, ["doc_id", "least"], "left_semi").select("row.*"))
    return out
