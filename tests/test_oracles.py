import pytest
from loomtext.plans.registry import ORACLE_SQL, QUERIES

from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
