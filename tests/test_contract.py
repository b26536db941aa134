"""Every registered query against its SQL oracle."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_module
from oracle import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert compare(df, oracle, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    counts = {r["prio"]: r["count"] for r in entry_module.entry(spark).collect()}
    assert "UNKNOWN" in counts and sum(counts.values()) == 1500


def test_the_entry_survives_a_missing_module():
    """Without a module that only the text operators need, the other queries are there."""
    hide = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')])"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", hide], cwd=root, capture_output=True, text=True, timeout=120)
    names = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]
    assert done.stdout.strip() == f"{len(names)} []", done.stderr[-2_000:]
