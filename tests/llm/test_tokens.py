"""The fast path gives what the tokenizers library gives."""

import pickle
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablewright.llm import tokens
from tablewright.llm.queries import piece_path, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return pickle.loads(pickle.dumps(tokens.ByteTokens(tokenizer_path())))


@pytest.fixture(scope="module")
def libraries():
    special, plain = (Tokenizer.from_file(tokenizer_path()) for _ in range(2))
    plain.encode_special_tokens = True
    return special, plain


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab 'stm \n\t1—é漢<|endoftext|>͸"), st.characters(exclude_categories=["Cs"])), max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_as_the_library(encoder, libraries, text):
    for special, library in zip((True, False), libraries):
        assert encoder.ids(text, special).tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_assigned_code_point(encoder, libraries):
    assert encoder.alike
    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    for at in range(0, len(points), 4_000):
        text = "".join(f"a{c}1{c}!{c} {c}\n{c}{c}" for c in points[at:at + 4_000])
        assert encoder._fast.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_long_texts(encoder, libraries, monkeypatch):
    text = "It's 10 o'clock <|endoftext|> and all  is\twell, naïve one. " * 300
    pieces = tokens.PieceTokens(piece_path())
    expected = encoder.ids(text).tolist(), pieces.ids(text).tolist()
    cut = [p for p in tokens.parts(text, 500)]
    assert len(cut) > 20 and "".join(cut) == text
    monkeypatch.setattr(tokens, "parts", lambda t, cut=tokens.parts: cut(t, 500))
    assert (encoder.ids(text).tolist(), pieces.ids(text).tolist()) == expected
    blanks = " " * 1_000_000 + "x"
    assert encoder.ids(blanks).tolist() == libraries[0].encode(blanks, add_special_tokens=False).ids
