"""Texts that a pattern matches, by walking its parse tree."""

from __future__ import annotations

import itertools
import re._parser as parser


def examples(pattern: str, most: int = 200) -> list[str]:
    return list(itertools.islice(_sequence(list(parser.parse(pattern))), most))


def _sequence(nodes: list):
    if not nodes:
        yield ""
        return
    for head in _node(nodes[0]):
        for rest in _sequence(nodes[1:]):
            yield head + rest


def _node(node):
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        yield chr(value)
    elif kind == "IN":
        yield from (["7"] if "DIGIT" in str(value) else ["q"] if "SPACE" in str(value) else [chr(v) for k, v in value if str(k) == "LITERAL"])
    elif kind == "BRANCH":
        for branch in value[1]:
            yield from _sequence(list(branch))
    elif kind == "SUBPATTERN":
        yield from _sequence(list(value[3]))
    elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, _, inner = value
        for n in {low, max(low, 1)}:
            yield from _sequence(list(inner) * n)
    elif kind in ("ASSERT", "ASSERT_NOT"):
        yield ""
    else:
        raise ValueError(kind)
