"""Tables out of payloads: textures, strings, instructions and bags, a row or more for each resource."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import facts
from cairn.sources import dds, payloads
from cairn.sources.bags import from_bytes

KEY = ("path", "type_id", "group_id", "instance_hi", "instance_lo")


def decoded(rows: DataFrame, read: Callable[[bytes], list[dict]], fields: pa.Schema) -> DataFrame:
    """The key columns and what `read` makes of `data`, a row for each dict; payloads that it can't read give none."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            at, out = [], []
            for i, data in enumerate(batch.column("data")):
                try:
                    found = read(data.as_py()) if data.is_valid else []
                except (ValueError, IndexError):
                    found = []
                at += [i] * len(found)
                out += found
            kept = batch.select(list(KEY)).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[f.name] for r in out], f.type) for f in fields)], [*KEY, *fields.names])

    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in KEY] + [f"{f.name} {names[f.type]}" for f in fields])
    return rows.select(*KEY, "data").mapInArrow(run, schema)


def textures(rows: DataFrame) -> DataFrame:
    """width, height, format, mip_levels and memory_size of texture payloads, unpacked before."""

    def read(data: bytes) -> list[dict]:
        width, height, code, levels, n = payloads.texture_facts(data)
        return [{"width": width, "height": height, "format": payloads.TEXTURE_FORMATS[code - 1], "mip_levels": levels, "n_textures": n}]

    fields = pa.schema([("width", pa.int64()), ("height", pa.int64()), ("format", pa.string()), ("mip_levels", pa.int64()), ("n_textures", pa.int64())])
    found = decoded(rows.where(F.col("type_id") == payloads.TEXTURE), read, fields)
    return found.withColumn("memory_size", facts.mip_memory("format", "width", "height", "mip_levels", F.col("n_textures"))).drop("n_textures")


def dds_levels(rows: DataFrame) -> DataFrame:
    """level (0 is the largest), format, width, height and data of the levels of DDS images; formats without a counterpart give none."""

    def read(data: bytes) -> list[dict]:
        name, width, height, levels = dds.read(data)
        return [{"level": i, "format": name, "width": max(1, width >> i), "height": max(1, height >> i), "data": x} for i, x in enumerate(reversed(levels))]

    return decoded(rows, read, pa.schema([("level", pa.int64()), ("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("data", pa.binary())]))


def dds_images(levels: DataFrame) -> DataFrame:
    """The key columns and `data`, a DDS image of the rows that dds_levels() gives for it. One image is put together by one task."""

    def run(group: pa.Table) -> pa.Table:
        each = group.sort_by("level").to_pylist()
        content = dds.write(each[0]["format"], each[0]["width"], each[0]["height"], [r["data"] for r in reversed(each)])
        return pa.table({k: [each[0][k]] for k in KEY} | {"data": pa.array([content], pa.binary())})

    schema = ", ".join(f"{c} {levels.schema[c].dataType.simpleString()}" for c in KEY)
    return levels.select(*KEY, "level", "format", "width", "height", "data").groupBy(*KEY).applyInArrow(run, schema + ", data binary")


def strings(rows: DataFrame) -> DataFrame:
    """pos, language, value and description of the strings of text lists."""

    def read(data: bytes) -> list[dict]:
        return [{"pos": i, "language": lang, "value": v, "description": d} for i, (lang, v, d) in enumerate(payloads.TextList.read(data).strings)]

    return decoded(rows, read, pa.schema([("pos", pa.int64()), ("language", pa.int64()), ("value", pa.string()), ("description", pa.string())]))


def instructions(rows: DataFrame) -> DataFrame:
    """node, opcode, true_target, false_target, and x, y of a drawn flow; targets that end it are null."""

    def read(data: bytes) -> list[dict]:
        f = payloads.Function.read(data)
        spots = {n: (x, y) for n, x, y in payloads.traversal({i: (t.instruction, e.instruction) for i, (_, t, e, _, _) in enumerate(f.instructions)})}
        return [{"node": i, "opcode": op, "true_target": t.instruction, "false_target": e.instruction, "x": spots[i][0], "y": spots[i][1]} for i, (op, t, e, _, _) in enumerate(f.instructions)]

    return decoded(rows, read, pa.schema([(n, pa.int64()) for n in ("node", "opcode", "true_target", "false_target", "x", "y")]))


def bag_entries(rows: DataFrame) -> DataFrame:
    """pos, key, dtype and values of property bags, binary or XML; repeated keys stay."""
    return rows.select(*KEY, F.posexplode(from_bytes(F.col("data"))).alias("pos", "e")).select(*KEY, "pos", "e.*")
