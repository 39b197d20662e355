"""Every core query runs; those with SQL give the same as DuckDB."""

import pytest
from sqlcheck import connect, same

from tidemark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        df.count()


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
