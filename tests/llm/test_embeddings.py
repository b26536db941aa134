import numpy as np
import pytest

from tablewright.llm import embeddings
from tablewright.llm.simhash import _join_labels

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, weight string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", "b", 1) for i, v in rows], SCHEMA)


def plain(points, cosine=0.9):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    return linked.sum(axis=1), _join_labels(np.arange(len(points)), *np.nonzero(linked))


@pytest.mark.parametrize("part", [4_096, 15])
def test_recall_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    rng = np.random.default_rng(5)
    centers = np.repeat(rng.normal(size=(60, 32)), 5, axis=0)
    points = np.concatenate([rng.normal(size=(150, 32)), centers + rng.normal(size=centers.shape) * 0.3, rng.normal(size=32) + rng.normal(size=(80, 32)) * 0.2, np.ones((20, 32))])
    points = points.astype(np.float32).astype(np.float64)
    found = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, enumerate(points.tolist()))).collect()}
    links, labels = plain(points)
    got = np.array([found[i]["n_links"] for i in range(len(points))])
    assert (got <= links).all() and got.sum() >= 0.97 * links.sum()
    same = np.mean([found[i]["component_id"] == labels[i] for i in range(len(points))])
    assert same > 0.97 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def pairs(n, dim, cosine=0.905, seed=11):
    """``n`` random vectors, and for each one at that cosine."""
    rng = np.random.default_rng(seed + dim)
    a, b = rng.normal(size=(2, n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b *= np.sqrt(1 - cosine**2) / np.linalg.norm(b, axis=1, keepdims=True)
    return np.concatenate([a, cosine * a + b]).astype(np.float32).astype(np.float64)


def recall(spark, groups):
    """Share of the links found, for each group of vectors of one length."""
    rows = [(1_000 * k + i, v) for k, g in enumerate(groups) for i, v in enumerate(g.tolist())]
    found = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    out = []
    for k, g in enumerate(groups):
        links, got = plain(g)[0], np.array([found[1_000 * k + i] for i in range(len(g))])
        assert (got <= links).all()
        out.append(got.sum() / links.sum())
    return out


def test_recall_of_narrow_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "EVEN", 100)
    shares = recall(spark, [pairs(300, dim) for dim in (2, 3, 4, 8, 10, 16)])
    assert min(shares) > 0.95, shares


def test_few_vectors_are_all_compared(spark):
    assert recall(spark, [pairs(n, dim) for n, dim in ((1, 64), (2, 63), (3, 62), (5, 61), (300, 5), (300, 16))]) == [1] * 6


def test_odd_rows(spark):
    rows = [
        (1, None), (2, [0, 0, 0]), (3, [1, None, 0]), (4, [1, float("nan"), 0]), (5, [float("inf"), 0, 0]), (6, []),
        (7, [1, 2, 3]), (8, [2, 4, 6]), (9, [1, 2, 3]), (10, [1, 2]), (11, [-1, -2, -3]), (12, [1e-30, 2e-30, 3e-30]), (13, [1e38, 2e38, 3e38]),
    ]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert all(found[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11))
    assert all(found[i] == (4, 7, i == 7) for i in (7, 8, 9, 12, 13))
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_keys_grow_with_the_vectors():
    assert [max(m.bit_count() for m in embeddings.tables(n, 64)) for n in (10, 10**5, 10**8)] == [8, 8, 15]
    rotation = embeddings.learn_rotation(np.eye(8)[[0, 1, 2, 3] * 4], 4)
    assert np.allclose(rotation.T @ rotation, np.eye(rotation.shape[1]))
