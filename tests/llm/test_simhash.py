import random
import re

import numpy as np
import pytest
import xxhash
from odd import documents

from tablewright.llm import simhash
from tablewright.llm.components import components


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, budget=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_odd_rows(spark):
    docs = documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in rows) == sorted((i or -1, format(plain_fingerprint(t), "016x")) for i, t in texts)
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == by_id[5] == 4
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_stays_of_each_group(spark):
    kept = simhash.keep_one(documents(spark))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == documents(spark, []).columns
    assert ids.count(5) == 0 and ids.count(4) == 1 and ids.count(1) == 1 and 2 not in ids and None in ids
    repeated = simhash.keep_one(documents(spark, [(5, "a b c d e")] * 3 + [(6, "other words are here now")]))
    assert sorted(r["doc_id"] for r in repeated.collect()) == [5, 6]


def clusters(n, seed):
    rng = random.Random(seed)
    fps = set()
    while len(fps) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    return sorted(fps)


@pytest.mark.parametrize("part, even", [(25_000, 20_000), (20, 20_000), (25_000, 0)])
def test_links_against_all_pairs(spark, monkeypatch, part, even):
    """As it is; with subtries in many parts; with more blocks that must agree."""
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "EVEN", even)
    fps = clusters(400, 1)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = {r["node"]: r["component"] for r in components(simhash.trie_links(classes)).collect()}
    expected = plain_components(fps)
    groups = {}
    for f, r in zip(signed, expected):
        groups.setdefault(r, []).append(f)
    for group in groups.values():
        assert {found.get(f, f) for f in group} == {min(group)}


def test_trie_prunes_but_finds_all(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 4)
    monkeypatch.setattr(simhash, "HELD", 50)
    fps = np.array(clusters(300, 2), dtype=np.uint64)
    trie = simhash.Trie(np.zeros(len(fps), np.int64), fps, 4)
    trie.links()
    assert trie.labels.tolist() == plain_components([int(f) for f in fps])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 200), (300, 300), (150, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_row_of_each_group_where_ids_repeat(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white pink grey")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (3, c), (4, a), (5, a), (5, "north south east west up down left right")]
    kept = simhash.keep_one(documents(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (3, c), rows[-1]])
