"""Helpers shared by the operators: batches of texts, folds, samples, connected groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.tables import dropped, shared_dir, written

__all__ = ["connected", "fold", "matched", "released", "sampled", "scored", "shared_dir", "small", "written"]


#: Bytes of text that a task takes from an Arrow batch at once, about: one text may hold more.
SLICE_BYTES = 4_000_000


def small(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices, without a copy, of about most_bytes of text, so that what a task makes of a slice is bounded."""
    batch = None
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most_bytes, side="right")))
            yield batch.slice(low, high - low)
            low = high
    # workers go on to other tasks: what earlier ones' objects still hold among themselves goes now
    batch = None
    released()


def released() -> None:
    """Give back to the system what this process no longer uses: workers go on to other tasks, and two of them share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # what numpy and Python freed stays with the C library otherwise; only glibc has this
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def scored(f: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column of numbers that a function makes of texts, in slices of bounded size; f() is called once in each task and gives that function."""

    @F.arrow_udf("double")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = f()
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], ["text"])
            parts = [score(part.column(0).to_pylist()) for part in small(iter([batch]))]
            yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return run


#: Bytes of a table that is sent to every task, at most, as text and with 32 for each row.
SENT_BYTES = 50_000_000


def matched(rows: DataFrame, keys: DataFrame, on: Column | list[Column], how: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """rows joined with a written table of keys, by left_anti or left_semi: sent to every task if its size allows, so that rows aren't shuffled."""
    size = keys.agg(F.sum(F.lit(32) + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns), F.lit(0)))).first()[0]
    return rows.join(F.broadcast(keys) if (size or 0) <= sent_bytes else keys, on, how)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def sampled(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """About `rows` rows (all, if there are fewer), chosen by the key's hash: the same ones in every run."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the component's smallest node.

    Each round points every node at the smallest root seen among its neighbours and then at that
    root's own root, so that long chains shorten fast. A round shuffles ids only and is written to
    the shared folder; what the rounds before wrote goes. Null edges count for nothing. Joins on a hub's id may be split by AQE; minima are combined before they shuffle.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges_at, roots_at = shared_dir(spark), shared_dir(spark)
    both = written(both.union(both.select("v", "u")).distinct(), edges_at)
    roots = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"), roots_at)
    for _ in range(most_rounds):
        seen = both.join(roots, F.col("v") == F.col("node")).select("u", "root")
        # a node's root also learns of the smaller roots that the node sees
        told = seen.join(roots.select(F.col("node").alias("u"), F.col("root").alias("own")), "u")
        told = told.where("root < own").select(F.explode(F.array("u", "own")).alias("node"), "root")
        low = roots.select("node", "root").union(told).groupBy("node").agg(F.min("root").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new_at = shared_dir(spark)
        new = written(low.join(up, "root", "left").select("node", F.least("root", F.coalesce("upper", "root")).alias("root")), new_at)
        changed = new.join(roots.select("node", F.col("root").alias("was")), "node").where("root <> was").limit(1).count()
        dropped(spark, [roots_at] if changed else [roots_at, edges_at])
        roots, roots_at = new, new_at
        if not changed:
            return roots
    raise RuntimeError(f"components still change after {most_rounds} rounds")
