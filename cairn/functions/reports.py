"""Text for people: conflicts, totals, textures, changes."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import unified_diff

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.scalar import hex_of, human_size


def key_text(key: Column) -> Column:
    return F.concat_ws(" ", hex_of(key["type_id"], 8), hex_of(key["group_id"], 8), F.concat(hex_of(key["instance_hi"], 8), hex_of(key["instance_lo"], 8)))


def conflict_text(path: Column, keys: Column) -> Column:
    """A file and the keys that conflict in it, on lines of their own."""
    return F.concat_ws("\n", path, F.transform(keys, key_text))


def total_text(n_files: Column, n_bytes: Column) -> Column:
    return F.concat(human_size(n_bytes, 3), F.lit(" in "), n_files.cast("string"), F.lit(" files"))


def texture_text(group: Column, instance: Column, width: Column, height: Column, memory: Column, kind: Column, levels: Column) -> Column:
    """What a texture is, one fact on a line. instance: its hexadecimal digits, since 64 bits are no long."""
    facts = {"Group": hex_of(group), "Instance": instance, "Width": width, "Height": height, "Memory size (bytes)": memory, "Format": kind, "Mipmap levels": levels}
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in facts.items()))


def line_changes(old: Column, new: Column) -> Column:
    """A unified diff of two texts; empty if they are the same."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series(["\n".join(unified_diff((x or "").split("\n"), (y or "").split("\n"), "old", "new", lineterm="")) for x, y in zip(a, b)])

    return run(old, new)


def shown_columns(all_columns: list[str], hidden: set[str], always: str = "path") -> list[str]:
    """Columns that are switched on; one is always."""
    return [c for c in all_columns if c == always or c not in hidden]
