"""Tables written between steps, in a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders named inside each scratch() that is open.
_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir.

    Where that is unset, a session whose driver and executors are one process gets a folder of its own; on a
    cluster it is an error, since no other executor sees a machine's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", base)
    at = f"{base.rstrip('/')}/cairn-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(at)
    return at


def dropped(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders that shared_dir() named, through the store's own client; what isn't there is no matter."""
    jvm = spark._jvm
    for at in folders:
        if at.rpartition("/")[2].startswith("cairn-"):
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, keep: Iterable[str] = ()) -> Iterator[None]:
    """All folders named inside are deleted at the end, but for those to keep. Only for results that are written, or collected, inside."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        dropped(spark, [at for at in made if at not in set(keep)])


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs one read."""
    at = at or shared_dir(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
