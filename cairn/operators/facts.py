"""Facts and sums over archives: holes, sizes, textures, meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hole_totals(files: DataFrame, holes: DataFrame, key: str, size: str) -> DataFrame:
    """For every file, holes or not: n_holes and hole_bytes."""
    sums = holes.groupBy(key).agg(F.count("*").alias("n_holes"), F.sum(size).alias("hole_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return files.join(sums, key, "left").select(*files.columns, zero("n_holes"), zero("hole_bytes"))


def grand_total(totals: DataFrame) -> DataFrame:
    return totals.agg(F.count("*").alias("n_files"), F.sum("n_holes").alias("n_holes"), F.sum("hole_bytes").alias("hole_bytes"))


def before_after(rows: DataFrame, before: Column, after: Column, ok: Column) -> DataFrame:
    """Sums over the rows that succeeded."""
    return rows.where(ok).agg(F.count("*").alias("n"), F.sum(before).alias("bytes_before"), F.sum(after).alias("bytes_after"))


def mip_side(side: Column, level: Column) -> Column:
    """A mip level's side: halved for each level, 1 at least."""
    return F.greatest(F.expr("1"), F.call_function("shiftright", side, level))


def format_bytes(name: Column, width: Column, height: Column) -> Column:
    """Bytes of a width by height image; block formats take 8 or 16 bytes for 4 by 4 pixels."""
    blocks = F.floor((width + 3) / 4) * F.floor((height + 3) / 4)
    area = width.cast("long") * height
    each = F.when(name == "DXT1", blocks * 8).when(name.isin("DXT3", "DXT5"), blocks * 16)
    each = each.when(name.isin("Grayscale", "Alpha"), area).when(name.isin("RawRGB24", "AltRGB24"), area * 3)
    return each.when(name.isin("RawARGB32", "AltARGB32"), area * 4).cast("long")


def mip_memory(name: str, width: str, height: str, levels: str, textures: Column) -> Column:
    """Bytes of all levels of all textures; no levels take none."""
    # sequence(0, -1) counts down, so that no levels need a case of their own
    chain = F.when(F.col(levels) > 0, F.sequence(F.lit(0), F.col(levels).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    size = lambda i: format_bytes(F.col(name), mip_side(F.col(width).cast("int"), i), mip_side(F.col(height).cast("int"), i))
    return F.aggregate(F.transform(chain, size), F.lit(0).cast("long"), lambda a, b: a + b) * textures


def poly_count(primitive: Column, n: Column) -> Column:
    return F.when(primitive == "points", n * 2).when(primitive == "lines", n).when(primitive == "triangles", F.floor(n / 3)).otherwise(0).cast("long")


def max_mip_levels(width: Column, height: Column) -> Column:
    """Levels down to 1 by 1; 1 if a side above 1 is odd on the way, 0 if a side is 0. A side never is if it is a power of two."""
    power = lambda n: n.bitwiseAND(n - 1) == 0
    halvings = lambda n: F.length(F.bin(n)) - 1
    levels = F.when(power(width) & power(height), F.greatest(halvings(width), halvings(height)) + 1).otherwise(1)
    return F.when((width == 0) | (height == 0), 0).otherwise(levels)


def mesh_stats(rows: DataFrame, by: Sequence[str], primitive: Column, n_indices: Column, buffer_bytes: Column, has_bounds: Column) -> DataFrame:
    """Memory, polygons and draw calls: one for each mesh, and one more if there is any bounding face."""
    return rows.groupBy(*by).agg(
        F.sum(buffer_bytes + n_indices * 2).cast("long").alias("memory"),
        F.sum(poly_count(primitive, n_indices)).alias("n_polys"),
        (F.count("*") + F.when(F.bool_or(has_bounds), 1).otherwise(0)).alias("draw_calls"),
    )
