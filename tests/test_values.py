"""Value queries where keys are far above or below those of the smallest tables."""

import duckdb

from cairn.plans import registry


def test_dates_of_every_year(spark, tmp_path):
    """Years of three to six digits, 0 and below, as SQL writes them."""
    years = (-200000, -9999, -10, -1, 0, 1, 999, 1969, 1970, 9999, 10000, 26610, 99999, 100000, 290000)
    keys = [(y - 1970) * 31556952 // 86399 + i for y in years for i in (0, 1, 200)]
    at = f"{tmp_path}/orders.parquet"
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    duck.execute(f"COPY (SELECT unnest({keys})::BIGINT AS o_orderkey, TIMESTAMP '1995-01-01 00:00:00' AS o_orderdate) TO '{at}'")
    duck.execute(f"CREATE VIEW orders AS FROM '{at}'")
    got = {tuple(r) for r in registry.QUERIES["v_dates"](spark, str(tmp_path)).select("o_orderkey", "day_epoch", "shown").collect()}
    assert got == set(duck.sql(registry.ORACLE_SQL["v_dates"]).fetchall()) and len(got) == len(keys)
