"""Folders of documents as a data source: ``spark.read.format("documents").load(folder)`` gives their blocks.

Names and endings are filters that reach the listing, so files that they leave out are neither opened nor given to a task. Files are
dealt to tasks by size. They are opened by Arrow's file systems (local, HDFS, S3, GCS); for other stores there is ``readers.scan``,
which reads through Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from docloom.sources import readers

SCHEMA = f"name string, {readers.BLOCKS}"
#: Bytes of files that a task reads, unless one file has more.
TASK_BYTES = 32 << 20

_TESTS = {
    EqualTo: lambda value, x: x == value,
    In: lambda value, x: x in value,
    StringStartsWith: lambda value, x: x.startswith(value),
    StringEndsWith: lambda value, x: x.endswith(value),
    StringContains: lambda value, x: value in x,
}


@dataclass
class Files(InputPartition):
    paths: list[str]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _ending(path: str) -> str:
    name = _name(path)
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


class DocumentsReader(DataSourceReader):
    def __init__(self, folder: str, recursive: bool):
        self.folder, self.recursive = folder, recursive
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Filters on name and ext are kept for the listing; the others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("name", "ext") and type(f) in _TESTS and f.value is not None:
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        own = {"name": _name(path), "ext": _ending(path)}
        return own["ext"] in readers.DECODERS and all(_TESTS[kind](value, own[column]) for column, kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((x.path, x.size or 0) for x in found if x.type == fs.FileType.File and x.size != 0 and self._wanted(x.path))
        out, size = [], 0
        for path, n in files:
            if not out or size + n > TASK_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.folder)[0] if ":" in self.folder else fs.LocalFileSystem()
        scheme = self.folder.split(":", 1)[0] if ":" in self.folder else "file"
        for path in partition.paths:
            with store.open_input_stream(path) as source:
                data = source.read()
            shown = f"file:{path}" if scheme == "file" else f"{scheme}://{path}"
            rows = readers.decoded(shown, _ending(path), data, readers.DECODERS)
            yield pa.RecordBatch.from_arrays([pa.array([_name(path)] * len(rows)), *readers.columns(rows)], names=["name", *readers.NAMES])


class Documents(DataSource):
    """Blocks of a folder's documents, with the file's name; empty files have none. Options: path, recursive."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocumentsReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach sources written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
