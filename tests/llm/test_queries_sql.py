import pytest

from oracle import SF, rows_of, rows_of_sql
from webmill.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    assert rows_of(Q.QUERIES[name](spark, SF)) == rows_of_sql(Q.ORACLE_SQL[name])
