"""Registered queries that SQL can express, against their SQL."""

import pytest

from compare import differences, open_tables
from sensorflow.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), open_tables(sf_dir), SQL[name]) == []


def test_each_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == [*range(1, 14)]
