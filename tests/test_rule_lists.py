import random

import pytest

from tablewright.operators import textjobs


def test_as_the_chain_of_conditions(spark):
    """5,000 random rules against the chain, some patterns inside others, some repeated."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcÉİß \"'", k=rng.randint(1, 6))) for _ in range(900)]
    rules = [("".join(rng.sample(words, rng.randint(1, 3)))[:rng.randint(2, 14)] + str(rng.randint(0, 30)), f"f{i}", None if i % 9 == 0 else f"m{i}") for i in range(5_000)]
    texts = [(i, None if i % 97 == 0 else "".join(rng.choices(words, k=6)) + "".join(rng.choice([p.upper(), p]) for p, _, _ in rng.sample(rules, 2))) for i in range(400)] + [(500, "")]
    df = spark.createDataFrame(texts, "i int, text string")
    found = sorted(map(tuple, textjobs.match_rule_list(df, "text", rules).collect()))
    assert found == sorted(map(tuple, textjobs.match_rules(df, "text", rules).collect())) and sum(r[2] is not None for r in found) > 200


def test_empty_patterns_and_lists(spark):
    df = spark.createDataFrame([("x",), ("ab",), (None,)], "text string")
    rules = [("AB", "one", "1"), ("", "any", "2"), ("x", "late", "3")]
    assert sorted(map(str, textjobs.match_rule_list(df, "text", rules).select("fix").collect())) == sorted(map(str, textjobs.match_rules(df, "text", rules).select("fix").collect()))
    assert [r["fix"] for r in textjobs.match_rule_list(df, "text", []).collect()] == [None] * 3
    assert textjobs.match_rule_list(df, "text", [("", "any", None)]).where("fix = 'any'").count() == 2
    with pytest.raises(ValueError, match="most_bytes"):
        textjobs.match_rule_list(df, "text", rules, 2)
