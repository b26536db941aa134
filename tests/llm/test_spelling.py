"""Spelling variants against plain edit distances over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd import documents
from pyspark.sql import functions as F

from tablewright.llm import bloom, spelling

LETTERS = spelling.LETTERS


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_words(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def found_groups(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = plain_words([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found_groups(spelling.variants(docs)) == plain_groups(words) and len(words) > 500


def test_odd_rows(spark):
    base = [(i, "Colour color COLOUR colours ünïcödé ÷×ÀÿÀÿ naïvely x") for i in range(20)] + [(50, "colouur " * 6), (51, "x" * 60_000 + " " + ("y" * 70 + " ") * 5)]
    docs = documents(spark, base + [(None, "abcdefg " * 600), (None, None), (3, "")])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found_groups(spelling.variants(docs)) == plain_groups(plain_words(rows))
    assert spelling.variants(documents(spark, [])).count() == 0


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcé", k=rng.choice([6, 7, 8]))) for _ in range(n)}
    words |= {w[:3] + rng.choice(LETTERS) + w[3:] for w in rng.sample(sorted(words), 50)} | {"a" * 47, "a" * 48, "a" * 49, "a" * 48 + "b", "ÿ" * 6, "ÿ" * 7}
    return {w: rng.choice([5, 6, 30, 200, 1_000, 6_000]) for w in words}


@pytest.mark.parametrize("probed, most", [(spelling.PROBED, bloom.MOST), (500, bloom.MOST), (spelling.PROBED, 32)])
def test_groups_against_all_pairs(spark, monkeypatch, probed, most):
    """As it is; in small steps; with filters of one block, which let nearly all pass."""
    monkeypatch.setattr(spelling, "PROBED", probed)
    monkeypatch.setattr(spelling.bloom, "build", lambda rows, sizes, build=bloom.build: build(rows, sizes, most=most))
    words = vocabulary(1)
    df = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    assert found_groups(spelling.group(df)) == plain_groups(words)


def test_hashes_of_edits():
    letters = np.stack([spelling.codes(w) for w in ("banana", "étoile")])
    by_hash = {}
    for word in ("banana", "étoile"):
        for i in range(6):
            by_hash[word[:i] + word[i + 1:]] = None
            for c in LETTERS:
                if LETTERS.index(c) > LETTERS.index(word[i]):
                    by_hash[word[:i] + c + word[i + 1:]] = None
    expected = {int(spelling._mixed(spelling._rolled(spelling.codes(w)[None].astype(np.uint64)))[0]) for w in by_hash}
    assert {int(h) for _, _, hashes in spelling.edits(letters) for h in hashes} == expected


def test_runs_are_not_cut():
    text = "abc déf " * 50 + "x" * 40 + " end"
    for size in (1, 7, 39, 10_000):
        assert [r for part in spelling.runs(text, size) for r in part] == spelling.RUN.findall(text)


def test_filters(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    rows = spark.createDataFrame([(int(h % 2), int(np.int64(h.view(np.int64)))) for h in hashes], "shard bigint, hash bigint")
    filters = bloom.build(rows, {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()})
    for s in (0, 1):
        own = hashes[hashes % np.uint64(2) == s]
        assert len(bloom.probe(filters[s], own)) == len(own)
        assert len(bloom.probe(filters[s], rng.integers(0, 1 << 64, 100_000, dtype=np.uint64))) < 1_000
    assert bloom.build(rows.limit(0), {}) == {} and bloom.blocks_for(10 ** 12) == bloom.MOST // 32
