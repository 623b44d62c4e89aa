"""Lookups between tables: directories, first matches, dimensions, folders, known lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension above this many rows isn't broadcast.
BROADCAST_ROWS = 100_000


def last_wins(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys and the value of each key's last row; maxima combine before the shuffle."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def with_directory(index: DataFrame, directory: DataFrame, keys: Sequence[str], size: str, order: Sequence[str]) -> DataFrame:
    """Index rows with `compression` and `decompressed_size`: RefPack and the directory's last size for the key, else Uncompressed and null."""
    sizes = last_wins(directory, keys, size, order).withColumnRenamed(size, "decompressed_size")
    found = F.col("decompressed_size").isNotNull()
    return index.join(sizes, list(keys), "left").withColumn("compression", F.when(found, "RefPack").otherwise("Uncompressed"))


def first_match(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; minima combine before the shuffle, so a frequent key costs no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)


def with_dimension(rows: DataFrame, dimension: DataFrame, key: str, name: str, fallback: Column) -> DataFrame:
    """rows with the dimension's name of a key, or the fallback where the dimension doesn't know it.

    The dimension is broadcast if a count of at most BROADCAST_ROWS + 1 rows shows it to be small.
    """
    small = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = dimension.select(key, F.col(name).alias("_name"))
    return rows.join(F.broadcast(side) if small else side, key, "left").withColumn(name, F.coalesce("_name", fallback)).drop("_name")


def without_folder(rows: DataFrame, path: str, folders: Sequence[str], out: str) -> DataFrame:
    """The path below the first of the folders that is a component prefix of it, else the whole path."""
    parts = F.split(F.col(path), "/")
    column = F.col(path)
    for folder in reversed(folders):
        own = folder.rstrip("/").split("/")
        inside = F.slice(parts, 1, len(own)) == F.array(*map(F.lit, own))
        below = F.array_join(F.slice(parts, len(own) + 1, F.greatest(F.size(parts) - len(own), F.lit(0))), "/")
        column = F.when(inside, below).otherwise(column)
    return rows.withColumn(out, column)


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, keys.columns, "left_anti")


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, column: str, new: str) -> DataFrame:
    """rows whose column is replaced where the overrides have a new value for the key."""
    side = overrides.select(key, F.col(new).alias("_new"))
    return rows.join(side, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
