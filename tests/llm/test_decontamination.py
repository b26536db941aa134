import hashlib
import random
import re

import pytest
from odd import documents

from tablewright.llm import decontamination as d
from tablewright.llm.shared import letter_words


def plain(text, items):
    words = letter_words((text or "").encode())
    hit, names = set(), set()
    for name, item in items:
        w = letter_words((item or "").encode())
        size = min(13, len(w))
        windows = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def corpus(seed, vocabulary, shortest):
    """Items and texts over few words, so that everything overlaps."""
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, draw(rng.randint(shortest, 30))) for i in range(12)] + [(20, None), (21, ""), (3, draw(20)), (22, "?!")]
    texts = [(i, draw(rng.randint(0, 300))) for i in range(30)]
    texts += [(100 + i, draw(40) + " " + rng.choice(items[:12])[1].upper() + ", " + draw(40)) for i in range(20)]
    return items, texts


@pytest.mark.parametrize("vocabulary, shortest, shard_words", [("ab", 13, 10**6), ("abc", 1, 10**6), ("abcdefgh", 3, 10**6), ("abc", 4, 50)])
def test_against_all_windows(spark, vocabulary, shortest, shard_words, monkeypatch):
    monkeypatch.setattr(d.automata, "__defaults__", (d.WIDTH, shard_words))
    items, texts = corpus(7, vocabulary, shortest)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(spark, texts)
    shards = d.automata(table, d.WIDTH, shard_words)
    assert (len(shards) > 1) == (shard_words < 10**6)
    for _, text in texts:
        spans, names = d._scan_all(shards, letter_words(text.encode()))
        expected = plain(text, items)
        assert (sum(b - a for a, b in spans), len(names)) == expected[1:3]
    if len(shards) == 1:
        found = {r[0]: tuple(r)[1:] for r in d.contamination_digests(docs, table).collect()}
        assert found == {i: plain(t, items) for i, t in texts}


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "one word two words"), (None, "no id"), (2, None)], "item_id bigint, text string")
    found = {(r["doc_id"], r["n_words"]): r for r in d.contamination_digests(documents(spark), items).collect()}
    assert found[1, 0]["contaminated"] is False and found[5, 9]["n_hit"] == 4 and found[5, 9]["contaminated"] is True
    assert found[None, 3]["n_hit"] == 0
    empty = spark.createDataFrame([], items.schema)
    assert d.contamination_digests(documents(spark), empty).where("n_hit > 0").count() == 0
    assert d.contamination_digests(documents(spark, []), items).count() == 0


def test_cut_spans(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    long = " ".join(f"x{i}" for i in range(1_000))
    rows = [(1, f"Before: {passage}. After"), (2, passage), (3, f"{long} {passage} {long}"), (4, "clean text"), (5, None),
            # cutting the inner passage brings the outer one together
            (6, f"a {' '.join(passage.split()[:10])} {passage} {' '.join(passage.split()[10:])} b")]
    docs = documents(spark, rows)
    out = d.decontaminate(docs, items)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert 2 not in texts and texts[3] == rows[2][1] and texts[4] == "clean text" and texts[5] is None
    assert re.sub(r"\s+", " ", texts[1]) == "Before: . After" and re.sub(r"\s+", " ", texts[6]) == "a b"


@pytest.mark.parametrize("vocabulary, shortest", [("ab", 13), ("abc", 1), ("abcdefgh", 3)])
def test_queries_with_many_shards(spark, vocabulary, shortest):
    """A pass for each shard gives the rows of one automaton, and the same texts after all cuts."""
    items, texts = corpus(8, vocabulary, shortest)
    table, docs = spark.createDataFrame(items, "item_id bigint, text string"), documents(spark, [*texts, *texts[:5], (500, None), (501, "")])
    assert len(d.automata(table, d.WIDTH, 60)) > 2
    found = sorted(map(tuple, d.contamination_digests(docs, table, shard_words=60).collect()))
    assert found == sorted((r["doc_id"], *plain(r["text"], items)) for r in docs.collect())
    rows = lambda df: sorted(map(str, df.collect()))
    for coverage in (20, 2):
        assert rows(d.decontaminate(docs, table, coverage=coverage, shard_words=60)) == rows(d.decontaminate(docs, table, coverage=coverage))
    clean = docs.where("doc_id >= 500")
    assert rows(d.decontaminate(clean, table, shard_words=60)) == rows(clean)
