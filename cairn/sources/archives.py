"""Packages as tables: a scan of folders, an index-only parse, and payloads cut out on demand."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cairn.operators.conflicts import positions
from cairn.sources import layout

RESOURCE = "struct<index_pos:int,type_id:bigint,group_id:bigint,instance_hi:bigint,instance_lo:bigint,location:bigint,stored_size:bigint,compression:int,decompressed_size:bigint>"
HOLE = "struct<pos:int,location:bigint,size:bigint>"
HEAD = ("version_major", "version_minor", "user_major", "user_minor", "flags", "created", "modified", "index_version", "index_minor")
PARSED = "path string, dir_ord int, error string, " + ", ".join(f"{c} long" for c in HEAD) + f", n_entries long, n_holes long, holes array<{HOLE}>, resources array<{RESOURCE}>"

#: Bytes of payloads, and 64 for each one's key, that go in one batch.
SLICE = 4_000_000


def files(spark: SparkSession, folders: Sequence[str], glob: str = "*.package") -> DataFrame:
    """path, dir_ord, length, content of the files below folders; a folder given twice is scanned twice.

    Spark's binaryFile source lists and reads them, so any store it knows will do; content is only read if a query uses it.
    """
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(f).select("path", F.lit(i).alias("dir_ord"), "length", "content") for i, f in enumerate(folders)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parsed_row(path: str, dir_ord: int, content: bytes | layout.Ranges, types: Sequence[int] | None = None, except_group: int | None = None) -> tuple:
    """A file's row of PARSED: its header, holes and resources, or the error that stopped the parse.

    With types, only resources of these are listed, and with except_group none of that group; places in the index stay.
    """
    try:
        p = layout.read(content)
    except layout.BadPackage as e:
        return path, dir_ord, str(e), *[None] * (len(HEAD) + 2), [], []
    n_entries = len(p.index["type_id"])
    keep = np.ones(n_entries, bool) if types is None else np.isin(p.index["type_id"], list(types))
    if except_group is not None:
        keep &= p.index["group_id"] != except_group
    columns = [np.flatnonzero(keep).tolist(), *(p.index[c][keep].tolist() for c in layout.COLUMNS)]
    rows = [dict(zip(("index_pos", *layout.COLUMNS), r)) for r in zip(*columns)]
    gaps = [{"pos": i, "location": int(a), "size": int(b)} for i, (a, b) in enumerate(p.holes.tolist())]
    return path, dir_ord, None, *(p.header[c] for c in HEAD), n_entries, len(gaps), gaps, rows


def arrow_types() -> dict[str, pa.DataType]:
    resource = pa.struct([pa.field("index_pos", pa.int32()), *(pa.field(c, pa.int32() if c == "compression" else pa.int64()) for c in layout.COLUMNS)])
    hole = pa.struct([("pos", pa.int32()), ("location", pa.int64()), ("size", pa.int64())])
    plain = dict.fromkeys((*HEAD, "n_entries", "n_holes"), pa.int64())
    return {"path": pa.string(), "dir_ord": pa.int32(), "error": pa.string(), **plain, "holes": pa.list_(hole), "resources": pa.list_(resource)}


def as_batch(row: tuple) -> pa.RecordBatch:
    kinds = arrow_types()
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds.values())], list(kinds))


def scan(found: DataFrame, types: Sequence[int] | None = None, except_group: int | None = None) -> DataFrame:
    """A row for each file: its header, holes and resources, of some types and groups only if asked for, or the error that stopped the parse. Payloads stay behind."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for path, dir_ord, content in zip(*(batch.column(c) for c in ("path", "dir_ord", "content"))):
                yield as_batch(parsed_row(path.as_py(), dir_ord.as_py(), content.as_py(), types, except_group))

    return found.select("path", "dir_ord", "content").mapInArrow(run, PARSED)


def in_order(found: DataFrame) -> DataFrame:
    """path, dir_ord, file_ord: files in scan order, folders as given and paths by their components."""
    each = found.select("path", "dir_ord").distinct()
    return positions(each, [F.col("dir_ord"), F.split("path", "/")], "file_ord")


def packages(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error", "holes", "resources").withColumns({c: F.timestamp_seconds(c) for c in ("created", "modified")})


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("path", "dir_ord", "error")


def holes(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "dir_ord", F.inline("holes"))


def resources(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "dir_ord", F.inline("resources"))


def payloads(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted resources with `data`, their bytes as stored.

    A file's bytes stand in one row, beside the list of what is wanted of it, and are cut where they lie: beside each resource, they
    would be copied for each, and kept for each on the way to Python.
    """
    file = ["path", "dir_ord"]
    names = wanted.columns
    rest = [c for c in names if c not in file]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for path, dir_ord, content, listed in zip(*(batch.column(c) for c in (*file, "content", "_wanted"))):
                each, whole = listed.values, memoryview(content.as_buffer())
                starts, sizes = (each.field(c).to_numpy(zero_copy_only=False) for c in ("location", "stored_size"))
                part = np.cumsum(sizes + 64) // SLICE
                for rows in np.split(np.arange(len(each)), np.flatnonzero(np.diff(part)) + 1):
                    own = each.slice(rows[0], len(rows))
                    data = pa.array([whole[a : a + n] for a, n in zip(starts[rows].tolist(), sizes[rows].tolist())], pa.binary())
                    columns = {"path": pa.repeat(path, len(rows)), "dir_ord": pa.repeat(dir_ord, len(rows)), **{c: own.field(c) for c in rest}, "data": data}
                    yield pa.RecordBatch.from_pydict({c: columns[c] for c in (*names, "data")})

    lists = wanted.groupBy(*file).agg(F.collect_list(F.struct(*rest)).alias("_wanted"))
    schema = StructType([*wanted.schema, StructField("data", BinaryType())])
    return found.select(*file, "content").join(lists, file).select(*file, "content", "_wanted").mapInArrow(run, schema)


def key(of: str = "") -> list[Column]:
    return [F.col(of + c) for c in ("type_id", "group_id", "instance_hi", "instance_lo")]
