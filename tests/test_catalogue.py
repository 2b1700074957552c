"""Every registered query that has SQL gives the rows of that SQL."""

import pytest
from parity import compare, connect

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert compare(df, ORACLE_SQL[name], duck) == ""
    else:
        assert df.count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
