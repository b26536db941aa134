"""Properties that hold for any table, on random ones."""

import datetime as dt
import decimal
import random

import pytest

from tablewright.operators import cleaning, profiling, tables
from tablewright.plans.storing import new_namespace
from tablewright.sources import registry

SCHEMA = "i int, l bigint, f double, s string, n string, b boolean, d date, m decimal(6,2)"


def random_table(spark, seed):
    rng = random.Random(seed)
    holes = [rng.choice((0.0, 0.2, 0.8, 1.0)) for _ in range(8)]

    def value(k):
        if rng.random() < holes[k]:
            return None
        return [
            lambda: rng.randint(-5, 5), lambda: rng.randint(-2**40, 2**40),
            lambda: rng.choice((float("nan"), -0.0, 0.0, rng.gauss(0, 1e6))),
            lambda: rng.choice(("", "  ", " a", "a", "Ünï ", "\tb")),
            lambda: rng.choice(("1", " 2.5", "1e3", "NaN", "-7")) if rng.random() < 0.95 else "x",
            lambda: rng.random() < 0.5, lambda: dt.date(2024, 1, rng.randint(1, 9)), lambda: rng.randint(0, 9),
        ][k]()

    rows = [tuple(value(k) for k in range(8)) for _ in range(rng.choice((1, 40, 300)))]
    rows += rng.choices(rows, k=len(rows) // 3) + [(None,) * 8] * rng.randint(0, 3)
    rng.shuffle(rows)
    return spark.createDataFrame([r[:7] + (None if r[7] is None else decimal.Decimal(r[7]),) for r in rows],
                                 SCHEMA)


def multiset(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed", range(5))
def test_cleaning(spark, seed):
    df = random_table(spark, seed)
    before = df.count()
    step = cleaning.drop_empty(df)
    for operation in (cleaning.dedupe, cleaning.trim_blank, cleaning.infer_numeric,
                      lambda d: cleaning.fill_nulls(d, rel_error=0.0), cleaning.drop_sparse):
        after = operation(step)
        assert after.count() <= before
        step = after
    cleaned, _ = cleaning.clean(df, "t", rel_error=0.0)
    assert multiset(cleaned.select(*step.columns)) == multiset(step)
    filled = [c for c, t in cleaned.dtypes if t in ("int", "bigint", "float", "double", "string")]
    assert cleaned.filter(" or ".join(f"{c} is null" for c in filled)).count() == 0


@pytest.mark.parametrize("seed", range(5, 8))
def test_profile_agrees_with_pandas(spark, seed):
    df = random_table(spark, seed)
    frame = df.select("i", "f", "s", "b").toPandas()
    found = {r["name"]: r for r in profiling.profile_nulls(df).join(profiling.profile_distinct(df), ["position", "name"])
             .collect()}
    for name in frame.columns:
        assert found[name]["nulls"] == frame[name].isnull().sum()
        assert found[name]["distinct_values"] == frame[name].nunique()
    assert profiling.duplicate_rows(df.select("i", "f", "s", "b")).first()["duplicate_rows"] == frame.duplicated().sum()


@pytest.mark.parametrize("seed", range(8, 10))
def test_stored_rows_come_back(spark, seed):
    df, table = random_table(spark, seed), new_namespace(spark) + ".t"
    tables.create_or_replace(df, table, ["d"])
    # partition columns come last in a Parquet table
    assert multiset(tables.read_table(spark, table).select(*df.columns)) == multiset(df)
    done = tables.refresh(spark, table)
    assert done.rows_read == done.rows_stored == df.count()
    assert multiset(tables.read_table(spark, table).select(*df.columns)) == multiset(df)


def test_upsert_is_idempotent(spark):
    rng = random.Random(1)
    records = [(f"k{rng.randint(0, 20)}", i, rng.random()) for i in range(200)]
    stored = spark.createDataFrame(records[:100], "id string, seq int, v double")
    updates = spark.createDataFrame(records[100:], stored.schema)
    once = registry.upsert(stored, updates, "id", "seq")
    assert multiset(registry.upsert(once, updates, "id", "seq")) == multiset(once)
    assert once.count() == len({r[0] for r in records})
