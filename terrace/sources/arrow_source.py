"""Arrow's file format (Feather's second version) as a data source: tasks by record batches, and a writer that commits or leaves nothing.

A file's footer names its record batches; a task reads ``batches`` of them by seeking, so files of any size are read by many
tasks and none is in memory whole. Only the columns of the given schema are read. A task writes a file under a name of its own
in a hidden folder; the driver moves the files of the attempts that count into place when all tasks are done, and removes
them when the job fails. ``overwrite`` replaces what was there at that point, not before.

Columns are matched by name and cast; a column that a file lacks fails. An empty table is written as one file without rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME, BATCHES, ROWS = "terrace-arrow", 8, 65536


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def _files(uri: str) -> list[str]:
    """Paths of a file, or of a folder's files that aren't hidden."""
    fs, path = _at(uri)
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [path]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File and f.base_name[0] not in "._")


@dataclass
class Batches(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class Reader(DataSourceReader):
    def __init__(self, uri: str, schema: T.StructType, batches: int):
        self.uri, self.schema, self.batches = uri, schema, batches

    def partitions(self) -> list[Batches]:
        fs, _ = _at(self.uri)
        found = []
        for path in _files(self.uri):
            with fs.open_input_file(path) as f:
                n = pa.ipc.open_file(f).num_record_batches
            found += [Batches(path, i, min(i + self.batches, n)) for i in range(0, n, self.batches)]
        return found

    def read(self, partition: Batches | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files, or files without rows
            return
        wanted = to_arrow_schema(self.schema)
        fs, _ = _at(self.uri)
        with fs.open_input_file(partition.path) as f:
            names = pa.ipc.open_file(f).schema.names
            if lost := [c for c in wanted.names if c not in names]:
                raise ValueError(f"{partition.path} has no columns {lost}")
            file = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in wanted.names]))
            for i in range(partition.first, partition.last):
                yield from pa.Table.from_batches([file.get_batch(i)]).select(wanted.names).cast(wanted).to_batches(max_chunksize=ROWS)


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: T.StructType, overwrite: bool):
        self.uri, self.schema, self.overwrite, self.hidden = uri, schema, overwrite, f"_part-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _at(self.uri)
        name, wanted = f"{uuid.uuid4().hex}.arrow", to_arrow_schema(self.schema)
        fs.create_dir(f"{path}/{self.hidden}", recursive=True)
        with fs.open_output_stream(f"{path}/{self.hidden}/{name}", compression=None) as out, pa.ipc.new_file(out, wanted, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
            for b in iterator:
                file.write_table(pa.Table.from_batches([b]).select(wanted.names).cast(wanted), max_chunksize=ROWS)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _at(self.uri)
        old = _files(self.uri) if self.overwrite else []
        for m in messages:
            if m is not None:
                fs.move(f"{path}/{self.hidden}/{m.name}", f"{path}/{m.name}")
        for name in old:
            fs.delete_file(name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, path = _at(self.uri)
        if fs.get_file_info(f"{path}/{self.hidden}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.hidden}")


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no Arrow files; give a schema")
        with _at(self.options["path"])[0].open_input_file(files[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("batches", BATCHES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None, batches: int = BATCHES) -> DataFrame:
    """The files of ``path``; only ``columns`` (of ``schema``, or of the first file) are read."""
    spark.dataSource.register(ArrowSource)
    own = schema or ArrowSource({"path": path}).schema()
    own = own if columns is None else T.StructType([own[c] for c in columns])
    return spark.read.format(NAME).schema(own).option("batches", batches).load(path)


def save_arrow(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ArrowSource)
    df.write.format(NAME).mode(mode).save(path)
