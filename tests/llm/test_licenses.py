import re

import pytest
from examples import examples
from odd import documents

from tablewright.llm import licenses
from tablewright.llm.license_rules import BASE, parse

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_base(text):
    words = WORDS.findall((text or "").encode().lower())
    places = [
        (i, label) for phrase, label in BASE for i in range(len(words))
        if words[i:i + len(phrase.split())] == phrase.encode().split()]
    return (
        len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
        ",".join(sorted({label for _, label in places})))


def test_hundreds_of_rules_match_their_own_examples():
    rules = parse()
    assert len(rules) > 300
    for rule in rules:
        inner = rule.pattern.pattern.decode().removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])")
        for example in examples(inner, 20):
            words = example.encode().split()
            assert rule.pattern.search(b" ".join(words)), (rule.label, example)
            # the keywords never keep a rule from a text that it matches
            assert rule.keywords <= set(words), (rule.label, example)


def test_base_columns_and_odd_rows(spark):
    found = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(documents(spark)).collect()}
    for r in documents(spark).collect():
        expected = plain_base(r["text"])
        got = found[r["doc_id"], expected[0]]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == expected
        assert set(filter(None, expected[4].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize("text, labels", [
    (b"Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),  # the longer notice holds the plain name
    (b"CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"),
    (b"gpl", "gpl"),
    (b"SPDX-License-Identifier: MIT", "mit"),
    (b"commit licenses", ""),
])
def test_containment(text, labels):
    assert licenses._summary()(text)[5] == labels


def test_detections_are_no_interval_inside_a_stronger_one(spark):
    rows = licenses.find_licenses(documents(spark)).where("doc_id in (10, 11)").collect()
    for a in rows:
        for b in rows:
            inside = a["doc_id"] == b["doc_id"] and b["first_word"] <= a["first_word"] and a["past_word"] <= b["past_word"]
            if a is not b and not a["base"] and inside:
                assert b["priority"] < a["priority"] or b["past_word"] - b["first_word"] == a["past_word"] - a["first_word"]
