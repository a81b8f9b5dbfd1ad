import pytest

from oracle import compare, connect
from tidemark.plans import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, con, name):
    compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name])
