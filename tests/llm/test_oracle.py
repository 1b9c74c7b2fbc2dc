import pytest
from lodestone.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], "/root/testdata/sf0.01")
