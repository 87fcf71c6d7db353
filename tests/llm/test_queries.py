import pytest
from oracle import actual, expected

from graphloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert actual(queries.queries()[name](spark, SF)) == expected(queries.oracle_sql()[name], SF)
