"""Every registered query against its checking SQL on the given tables."""

import pytest

from compare import differences, open_tables
from sensorflow.catalog.registry import CHECKS, QUERIES

@pytest.fixture(scope="module")
def checker(sf_dir):
    return open_tables(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(name, spark, sf_dir, checker):
    assert checker.execute(f"SELECT count(*) FROM ({CHECKS[name]})").fetchall()[0][0] > 0
    assert differences(QUERIES[name](spark, sf_dir), checker, CHECKS[name]) == []


def test_every_query_is_covered():
    assert set(QUERIES) == set(CHECKS)
