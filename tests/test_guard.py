"""The guard by words and the guard by plans give one answer."""

import random

import pytest

from tablewright.operators import querying

READS = [
    "select {q} from {n} where {n} = {q}", "with x as (select {q} as {n}) select * from x", "values ({q}, 2), ({q}, 3)", "table {n}", "describe {n}",
    "(select 1) union all (select {q})", "show tables", "explain select * from {n}", "select case when {n} = {q} then 1 end from {n} order by 1 limit 3",
    "select * from {n} lateral view explode(array(1)) t as e", "from {n} select *", "select * from a join b using ({n}) where exists (select {q})", "desc {n}",
]
WRITES = [
    "insert into {n} values ({q})", "with x as (select 1) insert into {n} select * from x", "delete from {n} where {n} = {q}", "update {n} set a = {q}",
    "drop table {n}", "create table {n} as select {q}", "create or replace temporary view v as select {q}", "truncate table {n}", "from {n} insert overwrite table {n} select *",
    "merge into {n} using s on {n}.k = s.k when matched then delete", "alter table {n} add columns (c int)", "select java_method({q}, {q})", "select 1; drop table {n}",
    "grant select on {n} to x", "set a = 1", "explain delete from {n}", "cache table {n}", "select {q} from", "select 'open", "select /* open", "",
]
QUOTED = ["'x'", "'it''s'", r"'a\'b'", "'-- no'", "'/* no */'", '"; drop table t"', r"'\\'", "r'raw'", r"r'c:\dir'", "'insert into t values (1)'", '""', "'`'"]
NAMES = ["t", "`a b`", "`delete from t`", "`x``y`", "`'`", "`--`"]
NOISE = ["/* c */", "/* a /* nested */ b */", "-- line\n", "/* ' */", "/* ; drop table t */", "--'\n", "/**/", "/* /* /* deep */ */ insert into t values (1) */", "\n\t"]


def statement(rng, template):
    text = template
    while "{q}" in text or "{n}" in text:
        text = text.replace("{q}", rng.choice(QUOTED), 1).replace("{n}", rng.choice(NAMES), 1)
    parts = text.split(" ")  # quoted texts may be cut as well, which both guards must bear
    cut = rng.randrange(len(parts) + 1)
    return " ".join([*parts[:cut], rng.choice(["", *NOISE]), *parts[cut:]]) + rng.choice(["", "", ";", "; ", " -- end"])


@pytest.mark.parametrize("seed", range(3))
def test_both_guards_agree(spark, seed):
    rng = random.Random(seed)
    texts = sorted({statement(rng, t) for t in READS + WRITES for _ in range(4)})
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    by_words = {r["sql"]: r["is_read"] for r in querying.guard_statements(df, "sql").collect()}
    by_plan = {t: querying.guard_sql(spark, t).reads for t in texts}
    assert {t: (by_words[t], by_plan[t]) for t in texts if by_words[t] != by_plan[t]} == {}
    assert 20 < sum(by_plan.values()) < len(texts) - 40


def test_deep_comments_and_long_texts_are_no_reads_or_reads_alike(spark):
    deep = "select 1 " + "/* " * 9 + "*/ " * 9
    long = "select '" + "x" * 200_000 + "' /* " + "y " * 100_000 + "*/ from t"
    rows = spark.createDataFrame([(deep,), (long,), (None,)], "sql string")
    assert [r["is_read"] for r in querying.guard_statements(rows, "sql").collect()] == [False, True, False]
