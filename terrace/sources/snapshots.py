"""A table of snapshots: whole or no commits, upserts by key, and reads of older states, on any file system that Spark writes to.

A snapshot is a manifest that lists folders of Parquet files; data are written before it and never changed after. A commit
puts the manifest of the next number in place by a rename that fails where that number is taken, so of two writers one
wins and the other raises ``Conflict``; a writer that fails earlier leaves folders that no manifest lists, and readers see
the snapshot before. ``vacuum`` removes what only older snapshots list.

Keys may be null and then equal each other; of several new rows of one key one counts, that of the greatest ``order``
(ties: any). An empty update commits an equal snapshot; the table's schema is that of its first snapshot, by name.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.config import DataError


class Conflict(DataError):
    """Another writer has committed since this one read the table."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the snapshots, oldest first."""
        fs, path = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{version:012}.json").collect()
        return json.loads(rows[0].value)

    def _commit(self, version: int, parts: list[str], schema: T.StructType, note: str) -> int:
        text = json.dumps({"parts": parts, "schema": schema.jsonValue(), "note": note}).encode()
        temporary, final = self._path(f"manifests/{uuid.uuid4().hex}.tmp"), self._path(f"manifests/{version:012}.json")
        out = self._fs().create(temporary, False)
        try:
            out.write(text)
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, final, no_overwrite)
        except Exception as e:
            self._fs().delete(temporary, False)
            raise Conflict(f"snapshot {version} of {self.folder} is another writer's") from e
        return version

    def _write(self, df: DataFrame) -> str:
        part = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        return part

    def read(self, version: int | None = None) -> DataFrame:
        """The latest snapshot, or that of a number."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise DataError(f"{self.folder} has no snapshot" + ("" if version is None else f" {version}"))
        found = self._manifest(known[-1] if version is None else version)
        schema = T.StructType.fromJson(found["schema"])
        if not found["parts"]:
            return self.spark.createDataFrame([], schema)
        return functools.reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(f"{self.folder}/{p}") for p in found["parts"]))

    def _last(self) -> tuple[int, dict | None]:
        known = self.versions()
        return (known[-1], self._manifest(known[-1])) if known else (0, None)

    def _fitting(self, df: DataFrame, last: dict | None) -> DataFrame:
        if last is None:
            return df
        schema = T.StructType.fromJson(last["schema"])
        if lost := set(schema.names) ^ set(df.columns):
            raise DataError(f"columns differ from the table's: {sorted(lost)}")
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))

    def replace(self, df: DataFrame) -> int:
        """A snapshot of ``df`` alone; its number."""
        number, last = self._last()
        own = self._fitting(df, last)
        return self._commit(number + 1, [self._write(own)], own.schema, "replace")

    def append(self, df: DataFrame) -> int:
        """A snapshot with the rows of ``df`` too; nothing that is there is written again."""
        number, last = self._last()
        own = self._fitting(df, last)
        return self._commit(number + 1, [*(last["parts"] if last else []), self._write(own)], own.schema, "append")

    def upsert(self, df: DataFrame, keys: list[str], order: str | None = None) -> int:
        """A snapshot where rows of ``df`` take the place of rows of equal keys, or are added. One join on the keys."""
        number, last = self._last()
        own = self._fitting(df, last)
        latest = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last() if order else F.lit(0))
        new = own.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")
        if last is None:
            return self._commit(1, [self._write(new)], own.schema, "upsert")
        added = self._write(new)
        told = self.spark.read.schema(own.schema).parquet(f"{self.folder}/{added}").select(*(F.col(k).alias(f"__{k}") for k in keys))
        kept = self.read(number).join(told, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
        return self._commit(number + 1, [self._write(kept), added], own.schema, "upsert")

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the last ``keep`` snapshots and the folders that no other lists; the number of folders removed.

        Run it where no writer is at work: a folder that is being written is in no manifest yet."""
        known, fs = self.versions(), self._fs()
        gone, left = known[: len(known) - keep] if keep < len(known) else [], known[-keep:]
        used = {p for v in left for p in self._manifest(v)["parts"]}
        for v in gone:
            fs.delete(self._path(f"manifests/{v:012}.json"), False)
        data = self._path("data")
        unused = [s.getPath() for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in used] if fs.exists(data) else []
        for path in unused:
            fs.delete(path, True)
        return len(unused)
