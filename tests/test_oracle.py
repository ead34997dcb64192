"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402

FOLDER = os.environ.get("CURATA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# On the smallest tables no two documents of a language overlap this much.
MAY_BE_EMPTY = {"similar_pairs"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    if name in MAY_BE_EMPTY and problem == "both sides are empty":
        problem = None
    assert problem is None
