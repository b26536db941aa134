import pytest
from pyspark.sql import functions as F

from tablewright.operators import sketches, tables
from tablewright.plans.storing import new_namespace


def profile(spark, table, store):
    return {r["name"]: r for r in sketches.merged_profile(spark, table, store).collect()}


def test_only_changed_folders_are_scanned(spark, tmp_path):
    namespace = new_namespace(spark)
    table, store = f"{namespace}.t", f"{namespace}.s"
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 4 > 0, (F.col("id") % 1_000).cast("double")).alias("x y"), F.concat(F.lit("n"), F.col("id") % 300).alias("n"),
        F.concat(F.lit("a b/c%+é "), F.col("id") % 5).alias("p"))
    tables.create_or_replace(rows, table, ["p"])
    assert sketches.refresh_sketches(spark, table, store) == sketches.Sketched(5, 5)
    assert sketches.refresh_sketches(spark, table, store) == sketches.Sketched(5, 0)
    found = profile(spark, table, store)
    assert {n: (r["rows"], r["nulls"]) for n, r in found.items()} == {"id": (20_000, 0), "x y": (20_000, 5_000), "n": (20_000, 0), "p": (20_000, 0)}
    for name, distinct in (("id", 20_000), ("x y", 750), ("n", 300), ("p", 5)):
        assert abs(found[name]["distinct_estimate"] - distinct) <= 0.04 * distinct
    assert abs(found["id"]["median_estimate"] - 10_000) <= 200 and found["n"]["median_estimate"] is None

    tables.append(rows.where("p like '%2'").limit(7), table)
    assert sketches.refresh_sketches(spark, table, store) == sketches.Sketched(5, 1)
    tables.delete_where(spark, table, "p like '%3'", confirm=True)
    assert sketches.refresh_sketches(spark, table, store) == sketches.Sketched(4, 0)
    assert profile(spark, table, store)["id"]["rows"] == 16_007
    facts = lambda: {n: tuple(r)[:6] for n, r in profile(spark, table, store).items()}
    kept, before = facts(), tables.read_table(spark, store).count()
    tables.append(tables.read_table(spark, store).limit(8), store)  # a refresh that was repeated
    assert facts() == kept
    sketches.compact(spark, table, store)
    assert facts() == kept and tables.read_table(spark, store).count() < before


@pytest.mark.parametrize("rows", [0, 3])
def test_small_tables_and_all_types(spark, rows):
    namespace = new_namespace(spark)
    df = spark.range(rows).selectExpr(
        "cast(null as double) as nothing", "if(id = 0, double('nan'), -0.0D * id) as f", "array(id, null) as a", "map('k', id) as m", "struct(id) as s",
        "date'2024-01-01' as d", "timestamp'2024-01-01 00:00:00' as t", "cast(id as decimal(20,3)) as c", "id > 1 as b", "cast(cast(id as string) as binary) as y")
    tables.create_or_replace(df, f"{namespace}.t")
    sketches.refresh_sketches(spark, f"{namespace}.t", f"{namespace}.s")
    found = profile(spark, f"{namespace}.t", f"{namespace}.s")
    if rows:
        assert {n: (r["nulls"], r["distinct_estimate"]) for n, r in found.items()} == {
            "nothing": (3, 0), "f": (1, 1), "a": (0, 3), "m": (0, 3), "s": (0, 3), "d": (0, 1), "t": (0, 1), "c": (0, 3), "b": (0, 2), "y": (0, 3)}
        assert found["c"]["median_estimate"] == 1.0 and found["nothing"]["median_estimate"] is None
    else:
        assert all(r["rows"] == 0 for r in found.values())
