"""Queries that SQL can express, on both engines."""

import pytest
from oracle import connect, difference

from coreloom.llm.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
