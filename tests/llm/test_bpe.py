import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import documents
from tokenizers import Tokenizer

from tablewright.llm import bpe
from tablewright.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges.load(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(encoder, text):
    return [i for ids in encoder.encode(text) for i in ids]


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab etaoin'stm \n\t1—é漢<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_as_the_library(merges, library, text):
    ids = ids_of(bpe.Encoder(merges), text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    decoder = bpe.Decoder(merges.bytes_of)
    assert "".join(decoder.push([i]) for i in ids) + decoder.push((), True) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ethrinsao=-é", min_size=1, max_size=3000), st.integers(1, 200))
def test_tokens_that_left_early_were_stable(merges, text, step):
    raw = text.encode()
    assert list(merges.transduce(raw[i:i + step] for i in range(0, len(raw), step))) == merges.merge(raw)


def test_the_lookahead_is_small_and_held_text_bounded(merges):
    assert 0 < merges.lookahead < 1_000
    given_out = 0

    def blocks():
        for n in range(2_000):
            yield b"the"
            # what has been read and not yet emitted is the lookahead and one token at most
            assert 3 * n - given_out <= merges.lookahead + max(map(len, merges.bytes_of.values()))

    for token in merges.transduce(blocks()):
        given_out += len(merges.bytes_of[token])
    assert given_out == 6_000


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(8, 40))
def test_blocks_make_no_difference(text, block):
    whole = [p for found in bpe.pieces(text, 10_000) for p in found]
    assert [p for found in bpe.pieces(text, block) for p in found] == whole and "".join(whole) == text


def test_odd_rows(spark, library):
    def digests(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    docs = documents(spark)
    found = [(r[0] or -1, *r[1:]) for r in bpe.token_digests(docs, tokenizer_path()).collect()]
    assert sorted(found) == sorted((r["doc_id"] or -1, *digests(r["text"])) for r in docs.collect())
    ids = bpe.encode(docs, tokenizer_path())
    assert sorted((r["doc_id"] or -1, r["text"]) for r in bpe.decode(ids, tokenizer_path()).collect()) == sorted(
        (r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert bpe.token_digests(documents(spark, []), tokenizer_path()).count() == 0
