import random
import zlib

import numpy as np
import pytest
from odd import documents, labels

from tablewright.llm import quality, toxicity


def corpus(n=400, seed=3):
    """Clean words against a few bad stems in many spellings; whole lines against junk."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubcdfgl") for _ in range(rng.randint(2, 8)))
    texts, marks = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.3, rng.random() < 0.6
        words = [word() for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scumm", "morron", "idiott"]) + word()[:3])
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + " |" for w in words]
        texts.append((i, " ".join(words)))
        marks.append((i, int(good), int(toxic), 5, "x"))
    return texts, marks


@pytest.mark.parametrize("module, column, folds, out", [(toxicity, 2, 4, 2), (quality, 1, 5, 0)])
def test_held_out_accuracy(spark, module, column, folds, out):
    texts, marks = corpus(1_000)
    rows = module.score_held_out(documents(spark, texts), labels(spark, marks)).collect()
    truth = {m[0]: m[column] for m in marks}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_left_out_labels_change_nothing(spark):
    texts, marks = corpus(120)
    for module, folds, out in ((toxicity, 4, 2), (quality, 5, 0)):
        held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % folds == out}
        turned = [(i, 1 - q, 1 - t, y, p) if i in held else (i, q, t, y, p) for i, q, t, y, p in marks]
        a, b = (sorted(map(tuple, module.score_held_out(documents(spark, texts), labels(spark, m)).collect())) for m in (marks, turned))
        assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    texts, marks = corpus(60)
    odd = documents(spark)
    docs = odd.union(documents(spark, [(i + 1000, t) for i, t in texts]))
    marks = [(i + 1000, q, t, y, p) for i, q, t, y, p in marks] + [(1, 1, 0, 5, ""), (None, 1, 1, 5, ""), (2, None, None, 5, ""), (1000, 1, 1, 5, ""), (10**9, 0, 1, 5, "")]
    rows = module.score_held_out(docs, labels(spark, marks)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert module.score_held_out(documents(spark, []), labels(spark, marks)).count() == 0


@pytest.mark.parametrize("rows, expected", [([], 0.0), ([(4, 1, 1, 0, ""), (5, 1, 1, 0, "")], 1.0), ([(4, 0, 0, 0, ""), (5, 0, 0, 0, "")], 0.0)])
def test_labels_of_one_class_or_none(spark, rows, expected):
    for module in (toxicity, quality):
        assert {r["score"] for r in module.score_held_out(documents(spark), labels(spark, rows)).collect()} == {expected}


def test_stages_keep_columns_and_clean_rows(spark):
    texts, marks = corpus()
    docs = documents(spark, texts)
    truth = {m[0]: m for m in marks}
    clean = toxicity.reject_toxic(docs, labels(spark, marks))
    good = quality.keep_good(docs, labels(spark, marks))
    for kept, column, wanted in ((clean, 2, 0), (good, 1, 1)):
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.collect()}
        right = [(i in ids) == (truth[i][column] == wanted) for i, _ in texts]
        assert np.mean(right) > 0.9
    assert quality.keep_good(docs, labels(spark, [])).count() == docs.count()


def test_the_sample_is_bounded(spark):
    texts, marks = corpus(200)
    from pyspark.sql import functions as F

    from tablewright.llm.shared import labelled_sample

    docs, table = documents(spark, texts), labels(spark, marks)
    assert labelled_sample(docs, table, "toxic", F.lit(True), 50, 10).count() == 50
    most = max(len(t) for _, t in texts)
    small = labelled_sample(docs, table, "toxic", F.lit(True), 200, 1 / 1000).select(F.sum(F.length("text"))).first()[0]
    assert small <= max(1_000, most)


@pytest.mark.parametrize("megabytes, size", [(32, 33_000_000), (1 / 100, 20_000)])
def test_long_texts_leave_room_for_others(spark, megabytes, size):
    """The first of the sample alone exceeds the bound."""
    from pyspark.sql import functions as F

    from tablewright.llm.shared import labelled_sample

    texts, marks = corpus(30)
    docs, table = documents(spark, texts), labels(spark, marks)
    first = docs.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).first()["doc_id"]
    long = F.expr(f"repeat('word ', {size // 5})")
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, long).otherwise(F.col("text")))
    sample = labelled_sample(docs, table, "toxic", F.lit(True), 30, megabytes).select("doc_id", "y", F.length("text").alias("n")).collect()
    assert len(sample) >= 10 and {r["y"] for r in sample} == {0, 1}
    assert sum(min(r["n"], 1 << 18) for r in sample) <= megabytes * 1_000_000
    assert ({r["doc_id"]: r["n"] for r in sample}.get(first) == size) == (megabytes == 32)  # whole, or not at all


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_rejects_nothing(spark, toxic):
    texts, marks = corpus(60)
    one = [(i, 1, toxic, 5, "") for i, *_ in marks]
    assert toxicity.reject_toxic(documents(spark, texts), labels(spark, one)).count() == 60


def test_misspellings_share_grams():
    a, b = (set(toxicity.subwords([w])[0].tolist()) for w in (b"worthless", b"worthlesss"))
    assert len(a & b) > len(a) / 2


def test_labels_without_texts_take_no_room(spark):
    """100 labelled documents among 20,000 labels, and a bound that holds them."""
    from pyspark.sql import functions as F

    from tablewright.llm.shared import labelled_sample

    texts, marks = corpus(100)
    others = [(i, 1, 0, 0, "") for i in range(10_000, 30_000)]
    sample = labelled_sample(documents(spark, texts), labels(spark, marks + others), "toxic", F.lit(True), 1_000, 10)
    assert {r["doc_id"] for r in sample.collect()} == {i for i, _ in texts}


def test_an_id_gives_one_row(spark):
    """One id repeats with other texts; the bound is a bound on rows, and the smallest text is taken."""
    from pyspark.sql import functions as F

    from tablewright.llm.shared import labelled_sample

    texts, marks = corpus(100)
    first = min(i for i, _ in texts)
    repeated = [(first, f"text {n}") for n in range(3_000)]
    rows = labelled_sample(documents(spark, texts + repeated), labels(spark, marks + marks), "toxic", F.lit(True), 59, 10).collect()
    assert len(rows) == 59 and len({r["doc_id"] for r in rows}) == 59
    whole = labelled_sample(documents(spark, texts + repeated), labels(spark, marks), "toxic", F.lit(True), 1_000, 10)
    smallest = min(t for i, t in texts + repeated if i == first)
    assert whole.count() == 100 and whole.where(F.col("doc_id") == first).first()["text"] == smallest


def test_the_first_rows_by_hash(spark):
    """A bound on the hash gives the rows that a sort of all gives."""
    from pyspark.sql import functions as F

    from tablewright.llm import shared

    ids, place = spark.range(20_000).withColumnRenamed("id", "doc_id"), F.xxhash64(F.col("doc_id").cast("string"))
    for rows in (1, 300, 19_000, 30_000):
        found = [r["doc_id"] for r in shared._first(ids, place, rows).collect()]
        assert found == [r["doc_id"] for r in ids.orderBy(place, "doc_id").limit(rows).collect()]
    skewed = ids.where(place > 1 << 62)  # no hash is small: the bound widens until it holds enough
    assert [r["doc_id"] for r in shared._first(skewed, place, 40).collect()] == [r["doc_id"] for r in skewed.orderBy(place, "doc_id").limit(40).collect()]
