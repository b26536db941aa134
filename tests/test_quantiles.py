"""Exact quantiles against a sort."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import quantiles
from tablewright.operators.quantiles import exact_quantiles


def expected(values, p):
    kept = sorted(v for v in values if v is not None and not math.isnan(v))
    return kept[max(1, math.ceil(p * len(kept))) - 1] if kept else None


def columns():
    rng = random.Random(7)
    n = 60_000
    return {
        "wide": [math.exp(rng.uniform(-300, 300)) * rng.choice((-1, 1)) for _ in range(n)],
        "hot": [5.0 if i % 3 == 0 else rng.gauss(0, 1) for i in range(n)],
        "two": [float(i % 2) for i in range(n)],
        "holes": [None if i % 4 else (float("nan") if i % 8 else float(i)) for i in range(n)],
        "three": [float(i % 3) for i in range(n)],
        "ends": [rng.choice((-math.inf, math.inf, 0.0, float(i))) for i in range(n)],
        "none": [None] * n,
    }


@pytest.mark.parametrize("p", [0.5, 0.1, 0.999])
def test_many_columns(spark, p):
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data))
    assert exact_quantiles(df, list(data), p) == {c: expected(v, p) for c, v in data.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 499, 500, 501, 1001, 1999])
def test_sizes(spark, n):
    values = [(float((i * 7919) % n),) for i in range(n)]
    df = spark.createDataFrame(values, "x double")
    assert exact_quantiles(df, ["x"]) == {"x": expected([v[0] for v in values], 0.5)}


def test_whole_numbers(spark):
    df = spark.range(10_001).selectExpr("cast(id as int) as i", "id")
    assert exact_quantiles(df, ["i", "id"]) == {"i": 5000.0, "id": 5000.0}


def test_every_size_of_double(spark, monkeypatch):
    values = [sign * 2.0 ** e for e in range(-1074, 1024, 7) for sign in (-1, 1)] + [0.0, -0.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rounds = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    for p in (0.0001, 0.25, 0.5, 0.501, 0.9, 1.0):
        rounds.clear()
        assert exact_quantiles(df, ["x"], p) == {"x": expected(values, p)}
        assert len(rounds) <= 7


def test_neighbours_take_few_rounds(spark, monkeypatch):
    values = [1e15 + i / 8 for i in range(9000)] + [1e-300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rounds = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    assert exact_quantiles(df, ["x"]) == {"x": expected(values, 0.5)}
    assert len(rounds) <= 7


def test_no_columns_and_no_rows(spark):
    assert exact_quantiles(spark.range(3), []) == {}
    assert exact_quantiles(spark.range(0), ["id"]) == {"id": None}


@pytest.mark.parametrize("rel_error", [0.2, 0.01])
def test_sketched_ranks_stay_within_the_error(spark, rel_error):
    """Against the exact ranks, over skewed values in many tasks, merged from groups too."""
    values = spark.range(0, 60_000, 1, 16).select("id", (F.pow(F.rand(3), 6) * 1e6).alias("x")).cache()
    found = values.agg(quantiles.sketched_quantile(F.col("x"), T.DoubleType(), rel_error).alias("m")).first()["m"]
    parts = values.groupBy(F.col("id") % 50).agg(quantiles.sketched(F.col("x"), T.DoubleType(), rel_error).alias("s"))
    merged = parts.agg(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("s"), F.lit(0.5)).alias("m")).first()["m"]
    for median in (found, merged):
        below = values.where(F.col("x") <= median).count() / 60_000
        assert abs(below - 0.5) <= rel_error
    assert quantiles.sketch_size(rel_error) < quantiles.sketch_size(rel_error / 2) <= quantiles.LARGEST_SKETCH
    values.unpersist()


def test_sketches_without_values(spark):
    df = spark.createDataFrame([(None, float("nan"), 3), (None, None, 3)], "n double, x double, i int")
    row = df.agg(*[quantiles.sketched_quantile(F.col(f.name), f.dataType, 0.01).alias(f.name) for f in df.schema]).first()
    assert tuple(row) == (None, None, 3.0)
    assert df.limit(0).agg(quantiles.sketched_quantile(F.col("i"), T.IntegerType(), 0.01)).first()[0] is None
