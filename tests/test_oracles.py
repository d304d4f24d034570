"""Every query with a SQL twin must equal DuckDB exactly (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, small_dir, name):
    ok, msg, _ = compare(spark, con, small_dir, name, QUERIES[name], SQL[name])
    assert ok, msg


def test_every_sql_has_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert set(df.columns) >= {"tp", "fn", "tn", "fp", "mcc", "area_roc", "n_trees"}
    assert rows[0]["tp"] + rows[0]["fn"] > 0
