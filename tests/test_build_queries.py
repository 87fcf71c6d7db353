import pytest
from oracle import actual, expected

from graphloom.plans import build_queries, change_queries, extra_queries, graph_queries, retention_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(build_queries.SQL))
def test_query_equals_sql(spark, name):
    assert actual(build_queries.QUERIES[name](spark, SF)) == expected(build_queries.SQL[name], SF)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
