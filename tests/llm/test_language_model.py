import math
import random
from collections import Counter

import numpy as np
import pytest
from odd import documents
from pyarrow import fs

from tablewright.llm import language_model as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


class Plain:
    def __init__(self, texts):
        seen = [tokens(t) for t in texts]
        self.words = Counter(w for t in seen for w in t)
        self.pairs = Counter(p for t in seen for p in zip([None, *t], t))
        self.n, self.v, self.texts = sum(self.words.values()), len(self.words), len(texts)
        of_counts = lambda c: lm._discounts([sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)])
        self.before = Counter(w for _, w in self.pairs)
        self.d, self.low_d = of_counts(self.pairs), of_counts(self.before)

    def cut(self, c, d):
        return d[min(c, 3) - 1] if c else 0

    def low(self, w):
        total = sum(self.before.values())
        left = sum(self.cut(c, self.low_d) for c in self.before.values()) / total if total else 1
        return (self.before[w] - self.cut(self.before[w], self.low_d)) / max(total, 1) + left / (self.v + 1)

    def p(self, context, w):
        n = self.texts if context is None else self.words[context]
        if not n:
            return self.low(w)
        left = sum(self.cut(c, self.d) for (a, _), c in self.pairs.items() if a == context)
        c = self.pairs[context, w]
        return (c - self.cut(c, self.d)) / n + left / n * self.low(w)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    return [(i, " ".join(vocabulary[min(int(rng.expovariate(0.2)), 29)] for _ in range(rng.randint(0, 60)))) for i in range(60)]


@pytest.mark.parametrize("held_words, held_tokens, part_bytes", [(300_000, 3_000_000, 32_000_000), (5, 40, 500)])
def test_against_a_plain_model(spark, monkeypatch, held_words, held_tokens, part_bytes):
    """As it is; and with many parts, where common contexts are dealt by both words."""
    for name, value in (("HELD_WORDS", held_words), ("HELD_TOKENS", held_tokens), ("PART_BYTES", part_bytes)):
        monkeypatch.setattr(lm, name, value)
    texts = corpus()
    model = lm.train(documents(spark, texts[:45]))
    plain = Plain([t for _, t in texts[:45]])
    assert (model.tokens, model.words) == (plain.n, plain.v)
    assert sum(plain.p(b"w1", w) for w in plain.words) + plain.p(b"w1", b"new") == pytest.approx(1)
    texts += [(90, "w1 unseen w2 unseen"), (91, None)]
    for r in lm.score(documents(spark, texts), model).collect():
        t = tokens(dict(texts)[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(plain.words[w] > 0 for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((plain.words[w] + 1) / (plain.n + plain.v + 1)) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(plain.p(a, w)) for a, w in zip([None, *t], t)))


def test_odd_rows(spark):
    docs = documents(spark)
    rows = lm.score_held_out(docs).collect()
    assert len(rows) == docs.count() and all(r["score"] <= 0 and r["base_score"] <= 0 for r in rows)
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
    assert lm.score_held_out(documents(spark, [])).count() == 0
    untrained = lm.train(documents(spark, []))
    assert {(r["score"], r["base_score"]) for r in lm.score(docs, untrained).collect()} == {(0.0, 0.0)}


def test_files_are_copied_from_a_store_that_is_not_mounted(tmp_path, monkeypatch):
    lm._write(f"file://{tmp_path}", "words-0", np.arange(5, dtype=np.uint64))

    class Elsewhere:
        LocalFileSystem = type(None)

        class FileSystem:
            @staticmethod
            def from_uri(uri):
                return fs.FileSystem.from_uri(uri)

    for store in (fs, Elsewhere):
        monkeypatch.setattr(lm, "fs", store)
        assert lm._map(f"file://{tmp_path}", "words-0", 40).view(np.uint64).tolist() == [0, 1, 2, 3, 4]
