"""Key conflicts found as files arrive, and views kept up to date with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.conflicts import positions
from cairn.sources import archives


def package_stream(spark: SparkSession, folder: str, glob: str = "*.package", files_per_batch: int = 64) -> DataFrame:
    """Packages as they appear below a folder, parsed; bad ones as rows with an error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return archives.scan(found.selectExpr("path", "0 AS dir_ord", "content"))


def previous_owner_stream(rows: DataFrame, keys: Sequence[str], file: str, order: Sequence[str]) -> DataFrame:
    """keys, `original`, `new` for each row whose key was seen before, in an earlier micro-batch or before it in this one.

    State holds each key's last file and never expires, as any later file may conflict with it. Within a
    micro-batch a key's rows go in the given order; over several, batches do.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    out = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + f", original {kinds[file].simpleString()}, new {kinds[file].simpleString()}"

    def owned(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files = pd.concat(list(parts)).sort_values(list(order))[file].tolist()
        before = [state.get[0] if state.exists else None, *files[:-1]]
        state.update((files[-1],))
        pairs = [(*key, a, b) for a, b in zip(before, files) if a is not None]
        if pairs:
            yield pd.DataFrame(pairs, columns=[*keys, "original", "new"])

    return rows.groupBy(*keys).applyInPandasWithState(owned, out, f"last {kinds[file].simpleString()}", "append", GroupStateTimeout.NoTimeout)


def ordered_view(spark: SparkSession, table: str, order: Sequence[Column | str]) -> DataFrame:
    """All that kept_view has kept so far, with `position` in an order: rows that came late stand where they belong."""
    return positions(spark.read.parquet(table), order, "position")


def kept_view(found: DataFrame, table: str, shown: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Start a query that appends each batch's facts, filtered, to a table; a batch that is run again replaces its own rows.

    A change of rules starts anew from the unfiltered facts with another table and checkpoint.
    """

    def add(batch: DataFrame, number: int) -> None:
        shown(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return found.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
