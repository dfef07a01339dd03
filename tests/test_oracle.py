"""Every registered query gives the rows of its SQL."""

import oracle
import pytest

from tidemark.plans import all_queries, all_sql

QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    if name in SQL:
        assert oracle.differences(df, duck, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
