import pytest
from duck import compare

from weftgraph.plans.table_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b
