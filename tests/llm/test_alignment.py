"""Alignment and its counts against plain loops over tokens."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd import documents
from tokenizers import Tokenizer

from tablewright.llm import alignment
from tablewright.llm.queries import piece_path, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain_tokens():
    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = True
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path())

    def piece_bytes(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) and pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def both(text):
        a = library.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        sides = [[(i, of[i] if isinstance(of, dict) else of(i)) for i in ids] for ids, of in ((a, ranks), (b, piece_bytes))]
        whole = (" " + text).encode()
        return sides if text and all(b"".join(t for _, t in s) == whole for s in sides) else [[], []]

    return both


def plain(rows, both):
    """The contract's row of each document, by comparing all pairs of spans."""
    found, holds = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        spans, groups = [], []
        for side in both(text or ""):
            at, out = 0, []
            for token, raw in side:
                out.append((token, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        shared = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(t) for t, _, e in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *shared], shared)]
        pairs, j = [], 0
        for t, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    pairs.append((t, b[j][0]))
                j += 1
        for p in set(pairs):
            holds[p].add(n)
        found.append((a, b, groups, pairs))
    best = Counter()
    for (t, _), docs in holds.items():
        best[t] = max(best[t], len(docs))
    return [
        (i, len(a), len(b), len(groups), len(pairs), sum(len(holds[p]) == best[p[0]] for p in pairs), sum(len(holds[p]) for p in pairs),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for (i, _), (a, b, groups, pairs) in zip(rows, found)]


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


ODD = [(20, "▁x"), (21, " two  spaces "), (22, "<|endoftext|>a<s></s><unk> <0x41>"), (23, "naïve café ①ﬁ"), (24, "tab\tnew\nline\r\n"), (25, "ͰΑ漢字かな\U0001F600͸")]


@pytest.mark.parametrize("sent, size", [(alignment.SENT, 1 << 20), (0, 1 << 20), (0, 2_000), (alignment.SENT, 300)])
def test_against_plain_loops(spark, monkeypatch, plain_tokens, sent, size):
    """With all counts sent, with counts joined, and with small blocks and products."""
    docs = documents(spark, [(i, t) for i, t in documents_rows() if t is None or len(t) < 40_000] + ODD)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = sorted(plain(rows, plain_tokens), key=key)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    found = alignment.score_links(docs.repartition(3), tokenizer_path(), piece_path(), sent)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=key) == expected


def documents_rows():
    from odd import TEXTS

    return TEXTS


def test_given_documents(spark, plain_tokens):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = alignment.score_links(docs, tokenizer_path(), piece_path())
    assert sorted(map(tuple, found.collect())) == sorted(plain(rows, plain_tokens))


def test_empty_table_and_long_texts(spark):
    assert alignment.score_links(documents(spark, []), tokenizer_path(), piece_path()).count() == 0
    text = "word by word " * 120_000
    rows = alignment.score_links(documents(spark, [(1, text), (2, "x" * 300_000)]), tokenizer_path(), piece_path()).collect()
    found = {r["doc_id"]: r for r in rows}
    assert found[1]["n_groups"] > 300_000 and found[2]["n_links"] > 0


@pytest.mark.parametrize("expanded", [1, 7, 1 << 20])
def test_products(expanded):
    """Row products of random matrices against dense ones, and a transposition."""
    rng = np.random.default_rng(3)
    left, right = (rng.random((17, 11)) < 0.3, rng.random((11, 23)) < 0.3)

    def csr(dense):
        rows, columns = np.nonzero(dense)
        return alignment.Csr(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(dense))))), columns)

    out = np.zeros((17, 23), np.int64)
    for rows, columns, values in alignment.product(csr(left), csr(right), expanded):
        out[rows, columns] += values
    assert (out == left.astype(int) @ right.astype(int)).all()
    turned, again = csr(left).transposed(11), csr(left.T)
    assert (turned.starts == again.starts).all() and (turned.columns == again.columns).all()


def test_links_of_occurrences_and_groups(spark, plain_tokens):
    text = "unbelievable tokenization of strings"
    aligned = alignment.align(documents(spark, [(1, text), (2, None)]), tokenizer_path(), piece_path())
    rows = alignment.links(aligned, tokenizer_path(), piece_path()).collect()
    a, b = plain_tokens(text)
    assert sum(r["n"] for r in rows) == len(text) + 1
    assert all(a[r["a_at"]][0] == r["a_id"] and b[r["b_at"]][0] == r["b_id"] for r in rows)
    shared = alignment.links(aligned, tokenizer_path(), piece_path(), "group").collect()
    assert {(r["a_at"], r["b_at"]) for r in rows} <= {(r["a_at"], r["b_at"]) for r in shared}
    ends = [np.cumsum([len(t) for _, t in s]).tolist() for s in (a, b)]
    borders = sorted(set(ends[0]) & set(ends[1]))
    group = [[next(g for g, e in enumerate(borders) if end <= e) for end in side] for side in ends]
    assert sorted((r["a_at"], r["b_at"]) for r in shared) == [(i, j) for i, g in enumerate(group[0]) for j, h in enumerate(group[1]) if g == h]
    counts = alignment.pair_counts(aligned, tokenizer_path(), piece_path()).collect()
    assert {(r["a_id"], r["b_id"]) for r in counts} == {(r["a_id"], r["b_id"]) for r in rows} and all(r["count"] == 1 and r["best"] for r in counts)
