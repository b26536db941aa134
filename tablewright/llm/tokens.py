"""Token ids of whole texts by public libraries, in numpy arrays.

A byte-level file goes through ``tiktoken``, which has the same merges and is several times faster,
wherever it gives what ``tokenizers`` gives: the file's tokens must be what the merges make of their
own bytes, in the order of their ids, and the text may hold no code point that Unicode 15.1 leaves
unassigned, since the libraries know different versions. All else goes through ``tokenizers``.

Very long texts are cut between a letter and a space before a letter, where no token can lie across.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from .bpe import PIECES, Merges

#: Characters of a part of a very long text.
PART = 1 << 18
CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts; each but the first begins with a space. Text without a place to cut stays whole."""
    at = 0
    while len(text) - at > 2 * size and (found := CUT.search(text, at + size)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


_assigned: set[str] = set()


def _all_assigned(text: str) -> bool:
    """Whether Unicode 15.1 knows all code points of a text."""
    for c in set(text) - _assigned:
        if unicodedata.category(c) == "Cn":
            return False
        _assigned.add(c)
    return True


class ByteTokens:
    """A byte-level tokenizer file. Only the file's text travels; the libraries' objects are made where they are used."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        merges = Merges.load(path)
        made = [token for _, (_, token) in sorted((rank, (rank, token)) for rank, token in merges.ranks.values())]
        ordinary = {i: b for i, b in merges.bytes_of.items() if i not in merges.special.values()}
        flags = [t for t in json.loads(self.spec).get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"]]
        self.alike = not flags and made == sorted(made) and max(merges.byte_ids) < min(made, default=256) and all(
            merges.merge(b) == [i] for i, b in ordinary.items())
        self.bytes_of = merges.bytes_of
        self.special = merges.special

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("spec", "alike", "bytes_of", "special")}

    @cached_property
    def _fast(self) -> tiktoken.Encoding:
        special = set(self.special.values())
        ranks = {b: i for i, b in self.bytes_of.items() if i not in special}
        return tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def _library(self) -> Tokenizer:
        library = Tokenizer.from_str(self.spec)
        library.no_truncation()
        library.no_padding()
        return library

    def ids(self, text: str, special: bool = True) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers; ``special`` makes special tokens of their strings."""
        found = [self._part(part, special) for part in parts(text)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def decoded(self, ids: np.ndarray) -> bytes:
        return self._fast.decode_bytes(ids.tolist())

    def _part(self, text: str, special: bool) -> np.ndarray:
        if self.alike and (text.isascii() or _all_assigned(text)):
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
            except ValueError:  # a run of blanks too long for its pattern
                pass
        self._library.encode_special_tokens = not special
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)


class PieceTokens:
    """A ``sentencepiece`` model; ``bytes_of`` gives each id's bytes, with U+2581 as a space."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = f.read()
        # no piece holds a space after another character, and the normaliser changes no code point but U+2581
        points = (c for c in map(chr, range(0x110000)) if c != "▁" and unicodedata.category(c) not in ("Cn", "Cs", "Co"))
        self.cuttable = not any(b" " in b.lstrip(b" ") for b in self.bytes_of) and all(
            self.decoded(self._part(f"a{c}a")) == f" a{c}a".encode() for c in points)

    def __getstate__(self) -> dict:
        return {"model": self.model, "cuttable": self.cuttable}

    @cached_property
    def _library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def bytes_of(self) -> list[bytes]:
        library = self._library
        names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        return [bytes([int(n[1:-1], 16)]) if library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]

    @cached_property
    def _table(self) -> np.ndarray:
        return np.array(self.bytes_of, object)

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(self._table[ids].tolist())

    def _part(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, num_threads=1), np.uint32)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text; the model adds a space in front."""
        found = [self._part(part[i > 0:]) for i, part in enumerate(parts(text) if self.cuttable else [text])]
        return found[0] if len(found) == 1 else np.concatenate(found)


def broadcast_tokens(spark: SparkSession, tokens: ByteTokens | PieceTokens, most: int = 500_000) -> Broadcast:
    """A tokenizer for all workers; one of over ``most`` tokens is refused."""
    if len(tokens.bytes_of) > most:
        raise ValueError(f"{len(tokens.bytes_of)} tokens; raise `most` to send them to every worker")
    return spark.sparkContext.broadcast(tokens)
