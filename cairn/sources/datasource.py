"""Packages as a data source: spark.read.format("packages").load(folder).

Only headers, indexes, directories and free space are read, by byte ranges; payloads never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.sources import archives, layout


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PackageReader(DataSourceReader):
    """options: path, suffix (.package), filesPerPartition (32), types (codes with commas; all), exceptGroup (none).

    Files go to partitions in the order of their paths. Resources of other types, and of the group, are left out while reading.
    """

    def __init__(self, options: dict):
        self.base = options["path"]
        self.suffix = options.get("suffix", ".package")
        self.n = int(options.get("filesPerPartition", 32))
        types, group = options.get("types"), options.get("exceptGroup")
        self.types = None if types is None else [int(t) for t in types.split(",") if t.strip()]
        self.except_group = None if group is None else int(group)

    def partitions(self) -> list[Files]:
        filesystem, base = fs.FileSystem.from_uri(self.base)
        found = filesystem.get_file_info(fs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix))
        return [Files(paths[i : i + self.n]) for i in range(0, len(paths), self.n)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        filesystem, _ = fs.FileSystem.from_uri(self.base)
        for path in partition.paths:
            with filesystem.open_input_file(path) as file:
                yield archives.as_batch(archives.parsed_row(path, 0, layout.Ranges(file, file.size()), self.types, self.except_group))


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return archives.PARSED

    def reader(self, schema) -> PackageReader:
        return PackageReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackageSource)
