import pytest

from graphloom.plans.oracle import compare
from graphloom.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_and_its_sql(spark, name):
    build, sql = queries()[name], oracle_sql().get(name)
    if sql is None:
        assert build(spark, SF).columns
    else:
        assert compare(spark, build, sql, SF) is None
