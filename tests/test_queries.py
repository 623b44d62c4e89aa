"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from cairn.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(table, columns):
    """Values as they are: a whole number isn't a float, a float no decimal, and NaN no null; halves of the last digits aside."""
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(map(repr, zip(*([plain(v) for v in table[c].to_pylist()] for c in columns))))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toArrow(), duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows(got, columns) == rows(want, columns)


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["original", "new", "n_keys", "keys"]
    assert set(e.oracle_sql()) <= set(e.queries())
