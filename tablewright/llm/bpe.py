"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoding.

A merge can change tokens to its left only through a chain of merges of rising rank, each
taking the last token that two runs still share. The longest such chain, in bytes, is the
sufficient lookahead of a merge list: a token that ends that far before the end of what has
been read stays as it is, whatever follows. So a text is read in blocks, tokens leave as
soon as they are stable, and the rest waits.

Defined cases: a null or empty text has no tokens; a special token's string in a text is that
token; rows and ids may repeat; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, groupby

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import per_text

#: The pattern that cuts a text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts in ASCII, without Unicode's classes.
ASCII_PIECES = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+""")
#: Characters read at once; a piece of more bytes than LONG_PIECE goes through the transducer.
BLOCK = 65_536
LONG_PIECE = 256
#: Pieces in each of the two parts of a worker's cache: when the newer part is full, it replaces the older.
CACHED = 250_000

DIGEST_SCHEMA = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])
IDS_SCHEMA = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


@cache
def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it can be seen, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _patterns() -> tuple[regex.Pattern, regex.Pattern | None]:
    """The cutting pattern, and the letters and digits that this ``regex`` knows but Unicode 15 doesn't."""
    newer = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn" and newer.match(chr(c))]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(found), lambda p: p[1] - p[0])]
    spans = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs)
    return regex.compile(PIECES), regex.compile(f"[{spans}]") if spans else None


class Merges:
    """A tokenizer's merge list with its ids, and the lookahead that suffices for it."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int]):
        letters = _byte_letters()
        self.special = special
        self.bytes_of = {i: t.encode() for t, i in special.items()}
        self.bytes_of |= {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in self.bytes_of}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.ranks.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        # a pair's rank and the token it becomes, packed
        self.steps = {a << 32 | b: rank << 32 | token for (a, b), (rank, token) in self.ranks.items()}
        self.none = len(self.ranks) << 32
        self.lookahead = self._lookahead()

    @classmethod
    def load(cls, path: str) -> Merges:
        """From a ``tokenizers`` JSON file of a byte-level model without normaliser, truncation or padding."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"not a byte-level BPE without normaliser: {path}")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(spec["model"]["vocab"], pairs, special)

    def _lookahead(self) -> int:
        """Bytes of the longest chain of merges through which a change can run to the left.

        Going from the last rank to the first, ``reach[p]`` is the longest chain that a merge of
        higher rank can begin whose right part starts with ``p``.
        """
        reach: dict[bytes, int] = {}
        longest = 0
        for (left, right), _ in sorted(self.ranks.items(), key=lambda kv: -kv[1][0]):
            a, b = self.bytes_of[left], self.bytes_of[right]
            span = len(a) + reach.get(a, 0)
            longest = max(longest, span)
            for n in range(1, len(b) + 1):
                if reach.get(b[:n], 0) < span:
                    reach[b[:n]] = span
        return longest

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a whole piece: the lowest rank first, of equal ranks the leftmost."""
        ids = [self.byte_ids[b] for b in piece]
        if len(ids) > 64:
            return self._merge_long(ids)
        find, none = self.steps.get, self.none
        steps = [find(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while steps:
            step = min(steps)
            if step == none:
                break
            i = steps.index(step)
            ids[i] = token = step & 0xFFFFFFFF
            del ids[i + 1], steps[i]
            if i < len(steps):
                steps[i] = find(token << 32 | ids[i + 1], none)
            if i:
                steps[i - 1] = find(ids[i - 1] << 32 | token, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = ranks[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[p][0], h, p))
        return [t for t in ids if t >= 0]

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in blocks; never more than a block and the lookahead is held."""
        held = b""
        for block in blocks:
            held += block
            if len(held) <= self.lookahead:
                continue
            end, stable = 0, len(held) - self.lookahead
            for token in self.merge(held):
                if end + len(self.bytes_of[token]) > stable:
                    break
                end += len(self.bytes_of[token])
                yield token
            held = held[end:]
        yield from self.merge(held)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        if len(raw) <= LONG_PIECE:
            return tuple(self.merge(raw))
        step = 4 * self.lookahead
        return tuple(self.transduce(raw[i:i + step] for i in range(0, len(raw), step)))


def pieces(text: str, block: int = BLOCK) -> Iterator[list[str]]:
    """The pieces of a text, block after block; the last two of a block wait for what follows."""
    pattern, newer = _patterns()
    plain = text
    if text.isascii():
        pattern = ASCII_PIECES
    elif newer is not None and newer.search(text):
        plain = newer.sub("\u0378", text)  # a code point of no class
    at, size = 0, block
    while at < len(text):
        whole = at + size >= len(text)
        spans = [m.span() for m in pattern.finditer(plain, at, min(len(text), at + size))] if plain is not text else None
        found = [text[a:b] for a, b in spans] if spans is not None else pattern.findall(text, at, min(len(text), at + size))
        if whole:
            yield found
            return
        if len(found) < 3:  # a piece longer than the block
            size *= 2
            continue
        yield found[:-2]
        at += size - sum(map(len, found[-2:]))
        size = block


class Cached(dict):
    """Ids of pieces seen before; a piece not seen lately goes through the merges."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.merges.piece_ids(piece)
        if len(piece) <= 32:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts one after the other, block by block."""

    def __init__(self, merges: Merges):
        self.merges, self.cached = merges, Cached(merges)
        names = sorted(merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def encode(self, text: str) -> Iterator[list[int]]:
        """Lists of ids, one after the other."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.merges.special:
                yield [self.merges.special[part]]
            elif part:
                for found in pieces(part):
                    yield list(chain.from_iterable(map(self.cached.__getitem__, found)))


class Decoder:
    """Turns ids into text as they come: bytes of an unfinished character wait for the next ids."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.state = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


def _worker(merges: Broadcast) -> Encoder:
    value = merges.value
    if not hasattr(value, "encoder"):
        value.encoder = Encoder(value)
        value.decimal = {i: str(i).encode() for i in value.bytes_of}
    return value.encoder


def _digests(merges: Broadcast, with_ids: bool) -> Callable[[bytes], tuple]:
    encoder = _worker(merges)
    decimal, bytes_of = merges.value.decimal, merges.value.bytes_of

    def one(raw: bytes) -> tuple:
        n, of_ids, of_text, decoder, kept = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bytes_of), []
        for ids in encoder.encode(raw.decode("utf-8", "replace")):
            of_ids.update((b"," if n and ids else b"") + b",".join(map(decimal.__getitem__, ids)))
            of_text.update(decoder.push(ids).encode())
            n += len(ids)
            if with_ids:
                kept += ids
        of_text.update(decoder.push((), True).encode())
        digests = n, of_ids.hexdigest(), of_text.hexdigest()
        return (*digests, kept) if with_ids else digests

    return one


def broadcast_merges(spark: SparkSession, path: str, most: int = 500_000) -> Broadcast:
    """The merge list for all workers; a list of over ``most`` merges is refused."""
    merges = Merges.load(path)
    if len(merges.ranks) > most:
        raise ValueError(f"{len(merges.ranks)} merges; raise `most` to send them to every worker")
    return spark.sparkContext.broadcast(merges)


def token_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, and the ids if asked for.

    The first digest is over the decimal ids joined by commas, the second over the text that the
    ids decode to.
    """
    merges = broadcast_merges(docs.sparkSession, path)
    schema = T.StructType([*DIGEST_SCHEMA, *IDS_SCHEMA]) if with_ids else DIGEST_SCHEMA
    return per_text(docs, schema, lambda: _digests(merges, with_ids))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each whole text."""
    merges = broadcast_merges(docs.sparkSession, path)

    def start():
        encoder = _worker(merges)
        return lambda raw: (list(chain.from_iterable(encoder.encode(raw.decode("utf-8", "replace")))),)

    return per_text(docs, IDS_SCHEMA, start)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""
    merges = broadcast_merges(ids.sparkSession, path)

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [Decoder(merges.value.bytes_of).push(v.as_py() or (), True) for v in batch]
            yield pa.array(texts, type=pa.string())

    apply.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return ids.select("doc_id", F.arrow_udf(apply, T.StringType())("ids").alias("text"))
