"""Every registered query with SQL equals DuckDB on the small tables, by value and type."""

import oracle
import pytest

from coreloom.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


# A fiftieth of the core set of the smallest tables has fewer rows than classes, which is an error; their KS p-values are
# exact, by a recursion that SQL cannot follow.
LARGER = {
    "workflow_anomaly_entropy_stratified_facts", "workflow_application_entropy_stratified_facts", "ks_two_sample", "feature_similarity_log"
}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LARGER))
def test_query_equals_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_equals_sql_on_larger_tables(spark, name):
    larger = SF_DIR.replace("0.001", "0.01")
    assert oracle.difference(QUERIES[name](spark, larger), oracle.connect(larger), ORACLES[name]) is None
