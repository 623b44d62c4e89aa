"""Packages from tables: written, recompressed, unpacked into files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import hex_of
from cairn.sources import layout
from cairn.sources.compression import packed, unpacked

EXTENSION_OF = {layout.RAW: "raw", layout.REFPACK: "refpack", layout.ZLIB: "zlib", layout.DELETED: "deleted", layout.STREAMABLE: "stream"}


def without_deleted(rows: DataFrame, flag: str) -> DataFrame:
    """Rows that aren't marked as deleted; a null mark is none."""
    return rows.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def recompressed(rows: DataFrame, to: int = layout.REFPACK) -> DataFrame:
    """rows (data, compression, decompressed_size) in another compression, with `bytes_before` and `bytes_after`; what fails, or is so already, stays as it is."""
    plain = unpacked(F.col("data"), F.col("compression"), F.col("decompressed_size"))
    fresh = packed(plain, F.lit(to))
    changed = rows.withColumn("_new", F.when(F.col("compression") != to, fresh)).withColumn("bytes_before", F.length("data"))
    done = F.col("_new").isNotNull()
    out = changed.withColumn("data", F.coalesce("_new", "data")).withColumn("compression", F.when(done, F.lit(to)).otherwise(F.col("compression")))
    return out.withColumn("bytes_after", F.length("data")).drop("_new")


def built(rows: DataFrame) -> DataFrame:
    """path, content, n_resources: a package for each path of rows (path, index_pos, key columns, data, compression, decompressed_size).

    A package is written by one task, as its format has one index at its front; the format bounds its size.
    """

    def run(group: pa.Table) -> pa.Table:
        each = group.sort_by("index_pos").to_pylist()
        content = layout.write({"index_minor": 2}, each)
        return pa.table({"path": [each[0]["path"]], "content": pa.array([content], pa.binary()), "n_resources": pa.array([len(each)], pa.int64())})

    columns = ["path", "index_pos", "type_id", "group_id", "instance_hi", "instance_lo", "data", "compression", "decompressed_size"]
    return rows.select(*columns).groupBy("path").applyInArrow(run, "path string, content binary, n_resources long")


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content) below a folder that all executors share; returns path and bytes of each.

    A file appears under its name by one rename when it is whole, so a task that runs twice does no harm.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = fs.FileSystem.from_uri(folder)
        for batch in arrow:
            sizes = []
            for path, content in zip(batch.column("path"), batch.column("content")):
                at = f"{base}/{path.as_py().lstrip('/')}"
                filesystem.create_dir(at.rpartition("/")[0], recursive=True)
                with filesystem.open_output_stream(f"{at}.part", compression=None) as out:
                    out.write(content.as_py())
                filesystem.move(f"{at}.part", at)
                sizes.append(len(content.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def unpacked_names(rows: DataFrame, embedded: Column, extension: Column) -> DataFrame:
    """rows with `name` and `body`, as files of single resources: number, base name, group, compression and extension.

    Types that carry a file name give it as the base name and lose those 64 bytes; others have their instance's.
    """
    base = F.when(embedded, F.substring_index(F.col("data").substr(1, 64).cast("string"), "\0", 1)).otherwise(F.concat(F.lit("0x"), hex_of(F.col("instance_hi"), 8), hex_of(F.col("instance_lo"), 8)))
    kind = F.lit("unknown")
    for code, name in EXTENSION_OF.items():
        kind = F.when(F.col("compression") == code, name).otherwise(kind)
    name = F.concat(F.concat_ws("_", "index_pos", base, F.lpad(F.col("group_id").cast("string"), 8, " ")), F.lit("."), kind, F.lit("."), extension)
    body = F.when(embedded, F.expr("substring(data, 65)")).otherwise(F.col("data"))
    return rows.withColumn("name", name).withColumn("body", body)


def backup_name(path: str, taken: set[str], mode: str = "numbered") -> str | None:
    """The name of a copy kept before a save: none, the one .bak (`keep` only if it isn't taken), or the first free number."""
    first = f"{path}.bak"
    if mode == "none" or (mode == "keep" and first in taken):
        return None
    if mode in ("keep", "overwrite") or first not in taken:
        return first
    n = 1
    while f"{first}.{n}" in taken:
        n += 1
    return f"{first}.{n}"


def unpack_to(rows: DataFrame, embedded: Column, extension: Column, folder: str) -> DataFrame:
    """Write every resource as a file of its own, below a folder for its package; returns path and bytes."""
    named = unpacked_names(rows, embedded, extension)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return saved(named.select(F.concat_ws("/", stem, "name").alias("path"), F.col("body").alias("content")), folder)


def export(rows: DataFrame, key: dict[str, int], name: str, folder: str) -> DataFrame:
    """Write the resources with a key, unpacked, under a name."""
    same = F.lit(True)
    for column, value in key.items():
        same = same & (F.col(column) == value)
    data = unpacked(F.col("data"), F.col("compression"), F.col("decompressed_size"))
    return saved(rows.where(same).limit(1).select(F.lit(name).alias("path"), data.alias("content")), folder)
