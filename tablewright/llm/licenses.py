"""Licence scans with ordered signature rules.

A text is lower-cased (A-Z) and cut into words of letters, digits and all beyond ASCII. A rule
runs where all of its keywords are among the words. Its matches are intervals of words; one
that lies within an interval of a higher priority, or of the same priority if that is longer
or of an earlier rule, is suppressed. Base phrases are never suppressed.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; places
may repeat and all count; rows may repeat; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_rules import Rule, parse
from .shared import letter_words, per_text

#: Confidence of a label by the priority of its rule.
CONFIDENCE = (0.3, 0.6, 0.8, 0.95, 1.0)

FOUND_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("base", T.ArrayType(T.BooleanType())), T.StructField("priorities", T.ArrayType(T.IntegerType())),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
])
SUMMARY_SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

Detection = tuple[int, int, int, int]  # first word, word after the last, priority, place of the rule


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        holders: dict[bytes, int] = defaultdict(int)
        for rule in rules:
            for k in rule.keywords:
                holders[k] += 1
        # a rule waits at the keyword that the fewest rules have
        self.waiting: dict[bytes, list[int]] = defaultdict(list)
        for i, rule in enumerate(rules):
            self.waiting[min(rule.keywords, key=lambda k: (holders[k], k))].append(i)

    def scan(self, words: list[bytes]) -> list[Detection]:
        """All detections that stay, by their first word."""
        there = set(words)
        due = sorted(i for k in self.waiting.keys() & there for i in self.waiting[k] if self.rules[i].keywords <= there)
        if not due:
            return []
        line = b" ".join(words)
        found = []
        for i in due:
            rule = self.rules[i]
            at = first = 0
            for m in rule.pattern.finditer(line):
                first += line.count(b" ", at, m.start())
                at = m.start()
                found.append((first, first + 1 + line.count(b" ", m.start(), m.end()), rule.priority, i))
        return self._resolve(found)

    def _resolve(self, found: list[Detection]) -> list[Detection]:
        """One sweep; ``reach`` is the furthest end so far of each priority."""
        reach = [0] * len(CONFIDENCE)
        kept = []
        for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
            if self.rules[d[3]].base or max(reach[d[2]:]) < d[1]:
                kept.append(d)
            reach[d[2]] = max(reach[d[2]], d[1])
        return kept


@cache
def _scanner() -> Scanner:
    return Scanner(parse())


def _details() -> Callable[[bytes], tuple]:
    scanner = _scanner()

    def one(raw: bytes) -> tuple:
        words = letter_words(raw)
        found = scanner.scan(words)
        rules = [scanner.rules[d[3]] for d in found]
        return (
            len(words), [r.label for r in rules], [r.base for r in rules], [r.priority for r in rules],
            [d[0] for d in found], [d[1] for d in found],
        )

    return one


def _summary() -> Callable[[bytes], tuple]:
    scanner = _scanner()

    def one(raw: bytes) -> tuple:
        words = letter_words(raw)
        found = scanner.scan(words)
        base = [d for d in found if scanner.rules[d[3]].base]
        names = lambda ds: ",".join(sorted({scanner.rules[d[3]].label for d in ds}))
        score = max((CONFIDENCE[d[2]] for d in found), default=0.0)
        return (
            len(words), len(base), base[0][0] if base else None, max(d[0] for d in base) if base else None,
            names(base), names(found), score,
        )

    return one


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, label, base, priority, first_word, past_word): a row for each detection."""
    found = per_text(docs, FOUND_SCHEMA, _details)
    each = F.explode(F.arrays_zip("labels", "base", "priorities", "starts", "ends")).alias("d")
    return found.select("doc_id", each).select(
        "doc_id", F.col("d.labels").alias("label"), F.col("d.base").alias("base"), F.col("d.priorities").alias("priority"),
        F.col("d.starts").alias("first_word"), F.col("d.ends").alias("past_word"),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each text.

    The score is the confidence of the strongest detection.
    """
    return per_text(docs, SUMMARY_SCHEMA, _summary)
