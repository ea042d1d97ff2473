"""Shared-folder helpers: every table or file that outlives a task goes to the
folder named by ``spark.checkpoint.dir``, which the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh URI below ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch: what a Python worker and the JVM beside it hold at once of long texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, at the first use of any operator; a smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, lost executors cost nothing.

    ``options`` are the writer's own."""
    spark = df.sparkSession
    small_batches(spark)
    uri = shared_dir(spark, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs ...) and the path on it; works on executors."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class AttemptFile:
    """A new file whose name no other task attempt uses; only names that an attempt reports count."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        self.size = 0
        self._out = fs.open_output_stream(f"{path}/{self.name}", compression=None)

    def write(self, data) -> int:
        """Append, and return the offset at which ``data`` starts."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()


class RangeReader:
    """Reads byte ranges of the files of one folder; keeps the last file open."""

    def __init__(self, folder: str):
        self._fs, self._path = file_system(folder)
        self._name, self._file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self._name:
            self.close()
            self._name, self._file = name, self._fs.open_input_file(f"{self._path}/{name}")
        data = self._file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{name}: {len(data)} of {length} bytes at {offset}")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._name, self._file = None, None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
