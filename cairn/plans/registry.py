"""Queries over the driver's tables, by name, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _module in ("conflict_queries", "texture_queries", "lookup_queries", "value_queries", "geometry_queries", "archive_queries", "bag_queries", "package_queries"):
    import_module(f"cairn.plans.{_module}")
