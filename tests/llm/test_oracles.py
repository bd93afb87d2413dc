import pytest

from loomtext.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)
