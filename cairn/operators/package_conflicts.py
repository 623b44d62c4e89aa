"""Conflicts between packages, from their folders to the pairs of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import conflicts
from cairn.sources import archives, resource_types

KEY = ["type_id", "group_id", "instance_hi", "instance_lo"]


def found_rows(spark: SparkSession, folders: Sequence[str], types: Sequence[str] = conflicts.CONFLICT_TYPES) -> DataFrame:
    """The resources of all packages whose keys can conflict, in the order of files: folders as given, and paths in them.

    Types and the local group are told to the scan, which leaves other resources out of the rows that it makes.
    """
    parsed = archives.scan(archives.files(spark, folders), resource_types.codes(types), conflicts.LOCAL_GROUP)
    order = archives.in_order(archives.packages(parsed))
    return archives.resources(parsed).join(order, ["path", "dir_ord"])


def find_conflicts(spark: SparkSession, folders: Sequence[str], types: Sequence[str] = conflicts.CONFLICT_TYPES) -> DataFrame:
    """original, new, file_ord, n_keys, keys: files that take keys over from files before them, with the keys in index order.

    Files that are no packages own nothing; a folder given twice conflicts with itself.
    """
    return conflicts.conflict_groups(found_rows(spark, folders, types), KEY, "path", ["file_ord"], "index_pos")


def find_visible(spark: SparkSession, folders: Sequence[str], enabled: Sequence[str] = conflicts.DEFAULT_ENABLED, known: DataFrame | None = None, show_known: bool = False) -> DataFrame:
    """find_conflicts with `is_known` and `shown`, for the types that are enabled at first."""
    found = find_conflicts(spark, folders)
    return conflicts.visible(found, found["keys.type_id"], resource_types.codes(enabled), known, show_known)
