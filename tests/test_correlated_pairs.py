"""Pairs of columns by correlation, held against the query's own SQL."""

import duckdb
import pytest
from parity import compare

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

UP, PI = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
ROWS = {
    # l_quantity and l_extendedprice are the likest, l_discount and l_tax as like to 4 digits and first by name
    "equal once rounded": [UP, [-2 * x for x in UP], PI, [*PI[:7], 6.01]],
    "not equal once rounded": [UP, [-2 * x for x in UP], PI, [*PI[:7], 8.0]],
    "a column that doesn't vary": [UP, [2 * x for x in UP], PI, [0.1] * 8],
    "a column of nulls": [UP, PI, [None] * 8, [*PI[:7], 7.0]],
    "no rows": [[], [], [], []],
}


@pytest.mark.parametrize("name", ROWS)
def test_pairs_that_are_equal_once_rounded_go_by_name(name, spark, tmp_path):
    schema = "l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(list(zip(*ROWS[name], strict=True)), schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert compare(QUERIES["correlated_pairs"](spark, str(tmp_path)), ORACLE_SQL["correlated_pairs"], con) == ""
