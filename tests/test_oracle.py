"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tallybook.catalog import ORACLE, QUERIES
from tools.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, key):
    problem, rows = compare(spark, con, key, sf_dir)
    assert not problem
    assert rows > 0
