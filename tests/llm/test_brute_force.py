"""Operators that SQL can't express, against plain versions without their shortcuts."""

import random
import zlib

import numpy as np
import pytest
from examples import examples
from odd import documents

from tablewright.llm import licenses, quality, toxicity
from tablewright.llm.license_rules import parse
from tablewright.llm.shared import letter_words


def plain_detections(text, rules):
    """Every rule over every text; a detection goes if one at least as strong covers it."""
    words = letter_words(text.encode())
    line = b" ".join(words)
    found = []
    for place, rule in enumerate(rules):
        for m in rule.pattern.finditer(line):
            found.append((line.count(b" ", 0, m.start()), line.count(b" ", 0, m.end()) + 1, rule.priority, place))
    return [
        d for d in found if rules[d[3]].base or not any(
            e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:3] != d[:3] or e[3] < d[3]) for e in found if e != d)]


def test_licenses_without_prefilter_or_sweep(spark):
    rules, rng = parse(), random.Random(4)
    samples = [e for rule in rules for e in examples(rule.pattern.pattern.decode().removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])"), 3)]
    texts = [(i, " some words here. ".join(rng.sample(samples, rng.randint(1, 5)))) for i in range(150)]
    texts += [(200 + i, f"{a} {b}") for i, (a, b) in enumerate(zip(samples[:60], samples[1:61]))]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    places = {}
    for r in licenses.find_licenses(documents(spark, texts)).collect():
        places.setdefault(r["doc_id"], []).append((r["first_word"], r["past_word"], r["priority"], r["label"]))
    for i, text in texts:
        kept = plain_detections(text, rules)
        assert found[i]["labels"] == ",".join(sorted({rules[d[3]].label for d in kept}))
        assert found[i]["score"] == max((licenses.CONFIDENCE[d[2]] for d in kept), default=0.0)
        assert sorted(places.get(i, [])) == sorted((*d[:3], rules[d[3]].label) for d in kept)


def plain_buckets(word):
    """The word itself, and each n-gram of its bytes between marks."""
    spread = lambda h: ((h * 2_654_435_761) & 0xFFFFFFFF) >> 16
    marked, out = b"<" + word + b">", [spread(zlib.crc32(word))]
    for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
        for at in range(len(marked) - n + 1):
            h = 0
            for b in marked[at:at + n]:
                h = (h * 65_599 + b) & 0xFFFFFFFF
            out.append(spread((h + n) & 0xFFFFFFFF))
    return out


class Held:
    def __init__(self, value):
        self.value = value


def test_toxicity_scores_are_means_over_words():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 40, toxicity.BUCKETS).astype(np.float32), 0.3)
    score = toxicity._scorer(Held(model))
    for text in ("You are a worthless fool, fool!", "one", "", "été 漢字 a a a b", "x" * 300):
        means = [np.mean(model.weights[plain_buckets(w)].astype(np.float64)) for w in letter_words(text.encode())]
        expected = 1 / (1 + np.exp(-(0.3 + (np.mean(means) if means else 0.0))))
        assert score(text.encode())[0] == pytest.approx(expected, rel=1e-6)
        buckets, weights = toxicity.bag(text.encode())
        assert float(weights @ model.weights[buckets]) == pytest.approx(float(np.mean(means)) if means else 0.0, rel=1e-4, abs=1e-6)


def plain_train(sample, seed=7):
    """The same steps with gradients by differences of the loss in double precision."""
    t = toxicity
    rng, n = np.random.default_rng(seed), len(sample.labels)
    bags = [(sample.buckets[a:b].astype(int), sample.weights[a:b].astype(np.float64)) for a, b in zip(sample.offsets, sample.offsets[1:])]
    rows = np.array([i for i in range(n) if len(bags[i][0])])
    emb = rng.normal(0, 0.1 / np.sqrt(t.DIM), (t.BUCKETS, t.DIM)).astype(np.float32).astype(np.float64)
    soft, bias = rng.normal(0, 0.1, (t.DIM, 2)).astype(np.float32).astype(np.float64), np.zeros(2)
    sums = [np.full(t.BUCKETS, 1e-6), np.full((t.DIM, 2), 1e-6), np.full(2, 1e-6)]
    steps, step = t.EPOCHS * -(-len(rows) // t.BATCH), 0
    for _ in range(t.EPOCHS):
        order = rng.permutation(rows)
        for start in range(0, len(order), t.BATCH):
            rate, step = t.RATE * (1 - step / steps), step + 1
            batch = order[start:start + t.BATCH]
            stay = rng.random(sum(len(bags[i][0]) for i in batch), np.float32) >= t.DROP
            kept, at = [], 0
            for i in batch:
                k = stay[at:at + len(bags[i][0])]
                at += len(k)
                kept.append((bags[i][0][k], bags[i][1][k] * t.SCALE / (1 - t.DROP) / t.FINE))
            used = sorted({int(b) for buckets, _ in kept for b in buckets})
            if not used:
                continue

            def loss(e, s, c):
                total = 0.0
                for i, (buckets, w) in zip(batch, kept):
                    logits = (sum((e[used.index(b)] * x for b, x in zip(buckets, w)), np.zeros(t.DIM))) @ s + c
                    total += np.log(np.exp(logits).sum()) - logits[sample.labels[i]]
                return total / len(batch)

            params = [emb[used], soft, bias]
            grads = []
            for p in range(3):
                grad = np.zeros_like(params[p])
                for place in np.ndindex(*grad.shape):
                    ends = []
                    for sign in (1e-5, -1e-5):
                        moved = [x.copy() for x in params]
                        moved[p][place] += sign
                        ends.append(loss(*moved))
                    grad[place] = (ends[0] - ends[1]) / 2e-5
                grads.append(grad)
            sums[0][used] += (grads[0] ** 2).mean(axis=1)
            emb[used] -= rate * grads[0] / np.sqrt(sums[0][used])[:, None]
            for p, target in ((1, soft), (2, bias)):
                sums[p] += grads[p] ** 2
                target -= 0.2 * rate * grads[p] / np.sqrt(sums[p])
    return t.SCALE * (emb @ (soft[:, 1] - soft[:, 0])), bias[1] - bias[0]


def test_toxicity_training_by_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    bags = [toxicity.bag(w) for w in (b"bad", b"good", b"bad ab", b"ok", b"", b"go bad")]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b, _ in bags])))
    sample = toxicity.Sample(
        np.concatenate([b for b, _ in bags]).astype(np.uint16), (np.concatenate([w for _, w in bags]) * toxicity.FINE).astype(np.float16), offsets,
        np.array([1, 0, 1, 0, 0, 1]))
    model = toxicity.train(sample)
    weights, bias = plain_train(sample)
    met = np.unique(sample.buckets)
    assert np.allclose(model.weights[met], weights[met], rtol=5e-3, atol=5e-2) and model.bias == pytest.approx(bias, abs=1e-3)
    assert not model.weights[np.setdiff1d(np.arange(toxicity.BUCKETS), met)].any()


@pytest.mark.parametrize("labelled", [3, 15, 200])
def test_quality_votes_by_a_full_sort(labelled):
    rng = np.random.default_rng(labelled)
    vectors = quality._unit(rng.normal(size=(labelled, 8)).astype(np.float32))
    vectors[labelled // 2] = vectors[0]  # a tie
    model = quality.Model(rng.normal(size=(quality.TERMS, 8)).astype(np.float32), vectors, rng.integers(0, 2, labelled).astype(float), 0.4)
    rows = np.abs(rng.normal(size=(40, quality.TERMS))).astype(np.float32) * (rng.random((40, quality.TERMS)) < 0.01)
    rows[7] = 0
    found = quality.vote(rows, model)
    for row, score in zip(rows, found):
        point = row @ model.project
        size = np.linalg.norm(point)
        cosines = [float(point @ v) / size if size else 0.0 for v in vectors]
        nearest = sorted(range(labelled), key=lambda i: (-round(cosines[i], 6), i))[:quality.NEIGHBOURS]
        weights = [max(0.0, cosines[i]) ** quality.SHARPNESS for i in nearest]
        total = sum(weights)
        expected = sum(w * model.labels[i] for w, i in zip(weights, nearest)) / total if total else model.share
        assert score == pytest.approx(expected, abs=1e-4)
