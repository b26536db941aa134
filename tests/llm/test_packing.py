"""Packing against the tokenizers library and the contract's rules."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import TEXTS, documents
from tokenizers import Tokenizer

from tablewright.llm import packing
from tablewright.llm.queries import tokenizer_path


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 400), min_size=1, max_size=60), st.integers(2, 9).map(lambda b: 1 << b))
def test_blocks(sizes, capacity):
    """Each token in one piece, sequences without gaps or padding, none over capacity."""
    sizes = np.array(sizes, np.int64)
    found = packing.pack_block(sizes, capacity)
    for doc, size in enumerate(sizes.tolist()):
        own = sorted((s, n) for d, s, n in zip(found["doc"].tolist(), found["start"].tolist(), found["length"].tolist()) if d == doc)
        assert [s for s, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) == size
    filled = []
    for seq in range(found["sequence"].max() + 1):
        own = found["sequence"] == seq
        lengths, offsets = found["length"][own], found["offset"][own]
        assert offsets.tolist() == (np.cumsum(lengths) - lengths).tolist()
        filled.append(int(lengths.sum()))
    assert max(filled) <= capacity and all(n & (n - 1) == 0 for n in filled)
    assert sum(n < capacity for n in filled) < capacity.bit_length()


def plain_difference(sizes, windows):
    """Multiway differencing on whole tuples of lists, as published."""
    states = [(-s if windows > 1 else 0, i, [(s, [i])] + [(0, [])] * (windows - 1)) for i, s in enumerate(sizes)]
    turn = len(states)
    while len(states) > 1:
        states.sort(key=lambda s: s[:2])
        (_, _, a), (_, _, b) = states[:2]
        merged = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))), key=lambda w: -w[0])
        states = [*states[2:], (-(merged[0][0] - merged[-1][0]), turn, merged)]
        turn += 1
    return sorted(s for s, _ in states[0][2])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.integers(1, 12))
def test_differencing(sizes, windows):
    window = packing.difference(np.array(sizes, np.int64), windows)
    assert sorted(np.bincount(window, sizes, windows).astype(int).tolist()) == plain_difference(sizes, windows)


def test_windows_come_out_nearly_equal():
    sizes = np.random.default_rng(5).integers(1, 500, 3_000)
    fill = np.bincount(packing.difference(sizes, 400), sizes, 400)
    assert fill.max() - fill.min() < 0.03 * fill.mean()
    window, count = packing.windows_of(np.full(10, 1_500), 2_048)
    assert count == 10 and sorted(window.tolist()) == list(range(10))


def pieces_by_document(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


@pytest.mark.parametrize("block_docs, block_tokens", [(packing.BLOCK_DOCS, packing.BLOCK_TOKENS), (3, 1_000_000), (1_000, 500)])
def test_pieces_and_ids(spark, block_docs, block_tokens):
    texts = dict(enumerate(t for _, t in TEXTS)) | {None: "no id here"}
    docs = documents(spark, list(texts.items())).repartition(3)
    library = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), block_docs=block_docs, block_tokens=block_tokens).collect()
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"}
    own = pieces_by_document(rows)
    assert own.keys() == texts.keys()
    for doc, pieces in own.items():
        pieces.sort(key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
        assert ids == library.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        assert [r["start"] for r in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
        assert {r["doc_tokens"] for r in pieces} == {len(ids)} and all(len(r["ids"]) == 4 * r["length"] for r in pieces)
    copies = packing.pack(documents(spark, [(5, "the same text"), (5, "the same text")]), tokenizer_path()).collect()
    assert sum(r["length"] for r in copies) == 2 * copies[0]["doc_tokens"]
    check_sequences(rows)


def check_sequences(rows):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= packing.CAPACITY


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    library = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed_digests(docs, tokenizer_path()).collect()
    ids = {r["doc_id"]: np.array(library.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in docs.collect()}
    own = pieces_by_document(rows)
    assert own.keys() == ids.keys()
    for doc, pieces in own.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(ids[doc][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    check_sequences(rows)


def test_empty_table(spark):
    found = packing.packed_digests(documents(spark, []), tokenizer_path())
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() == 0
