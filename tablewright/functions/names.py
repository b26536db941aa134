"""Names of columns, tables, jobs and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Characters that become "_" in a column name, and those that go.
UNDERSCORED = " -./"
REMOVED = "()"

_COLUMN_NAME_MAP = str.maketrans(UNDERSCORED, "_" * len(UNDERSCORED), REMOVED)


def col(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_name(name: str) -> str:
    """One standardized column name: trim, lower-case, then replace."""
    return str(name).strip().lower().translate(_COLUMN_NAME_MAP)


def clean_names(df: DataFrame, on_collision: str = "error") -> DataFrame:
    """Standardize column names.

    Two names may become equal. ``on_collision`` says what happens then:
    ``"error"`` raises, ``"first"`` keeps the first of the equal columns,
    ``"suffix"`` keeps all and numbers the later ones ``_2``, ``_3``, ...
    """
    if on_collision not in ("error", "first", "suffix"):
        raise ValueError(f"unknown on_collision: {on_collision!r}")
    wanted = [clean_name(c) for c in df.columns]
    if len(set(wanted)) == len(wanted):
        return df.toDF(*wanted)
    if on_collision == "error":
        repeated = sorted({n for n in wanted if wanted.count(n) > 1})
        raise ValueError(f"columns share a name after cleaning: {repeated}")
    if on_collision == "first":
        positions = [i for i, n in enumerate(wanted) if n not in wanted[:i]]
        by_position = df.toDF(*[f"c{i}" for i in range(len(wanted))])
        return by_position.select(*[F.col(f"c{i}").alias(wanted[i]) for i in positions])
    taken: set[str] = set()
    numbered = []
    for name in wanted:
        candidate, n = name, 1
        while candidate in taken or (n > 1 and candidate in wanted):
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        numbered.append(candidate)
    return df.toDF(*numbered)


def clean_identifier(c: Column) -> Column:
    """Table or job id: trimmed, lower-cased, space and ``-`` become ``_`` (M4)."""
    return F.translate(F.lower(strip(c)), " -", "__")


def clean_path(c: Column) -> Column:
    """Warehouse path: trimmed, outer slashes off, space becomes ``_`` (M4)."""
    return F.translate(F.regexp_replace(strip(c), "^/+|/+$", ""), " ", "_")
