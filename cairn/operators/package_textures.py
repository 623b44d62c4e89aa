"""Textures of packages, from their folders to a filtered and sorted list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import lookups, payload_tables, rules
from cairn.operators.conflicts import positions
from cairn.sources import archives, payloads
from cairn.sources.compression import unpacked


def textures(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """The key, width, height, format, mip_levels and memory_size of every texture in the folders' packages; what can't be read is left out."""
    found = archives.files(spark, folders)
    cut = archives.payloads(found, archives.resources(archives.scan(found, [payloads.TEXTURE])))
    return payload_tables.textures(cut.withColumn("data", unpacked(F.col("data"), F.col("compression"), F.col("decompressed_size"))))


def find_textures(spark: SparkSession, folders: Sequence[str], filters: str | Sequence[dict] = (), known: DataFrame | None = None, order: rules.SortSpec | None = None) -> DataFrame:
    """textures() that match all filters and aren't on a known list (of key columns), with `position` in an order; equal ones by their key."""
    shown = textures(spark, folders).where(rules.matches(filters))
    if known is not None:
        shown = lookups.without_keys(shown, known)
    names = {"format": rules.format_rank("format"), "instance": F.struct("instance_hi", "instance_lo")}
    return positions(shown, [*(order or rules.SortSpec()).columns(names), *map(F.col, payload_tables.KEY)], "position")
