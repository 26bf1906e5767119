import pytest

from posada import queries

from .compare import difference


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
