import pytest

from sqlcheck import connect, same
from tidemark.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    same(df, con, SQL[name]) if name in SQL else df.count()
