"""Folders of repositories as a Spark data source that lists in tasks.

The driver lists the first level only (one entry per repository); each partition walks its share of these folders and
gives name, size and time of every file as Arrow batches. Contents are read by the tasks that ask for them, file by
file. Locations are URIs of any file system that Arrow opens, local folders among them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "repo_id string, path string, size long, modified timestamp, location string"
ARROW = pa.schema([
    ("repo_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")),
    ("location", pa.string())])
ROWS = 10_000


def opened(uri: str):
    """File system and the path inside it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Prefixes(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.parts = int(options.get("partitions", 64))

    def partitions(self):
        from pyarrow import fs

        system, base = opened(self.root)
        found = system.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.Directory)
        return [Prefixes(names[i::self.parts]) for i in range(min(self.parts, len(names)))] or [Prefixes([])]

    def read(self, partition):
        from pyarrow import fs

        system, base = opened(self.root)
        for name in partition.names:
            top = f"{base.rstrip('/')}/{name}"
            rows = []
            for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
                if info.type == fs.FileType.File:
                    inside = info.path[len(top) + 1:]
                    rows.append((name, inside, info.size, info.mtime, f"{self.root}/{name}/{inside}"))
            for begin in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[begin:begin + ROWS]), ARROW.types)], schema=ARROW)


class FolderTree(DataSource):
    """``spark.read.format("folder_tree").load(root)`` after ``spark.dataSource.register(FolderTree)``."""

    @classmethod
    def name(cls):
        return "folder_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)


def file_bytes(batches):
    """(…, location) batches with the bytes of each file in place of its location; one file at a time."""
    for batch in batches:
        at = batch.schema.get_field_index("location")
        for i in range(batch.num_rows):
            system, path = opened(batch.column(at)[i].as_py())
            with system.open_input_stream(path) as source:
                content = source.read()
            columns = [batch.column(k).slice(i, 1) for k in range(batch.num_columns) if k != at]
            names = [n for n in batch.schema.names if n != "location"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary())], names=[*names, "bytes"])
