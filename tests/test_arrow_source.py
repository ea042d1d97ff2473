"""Arrow files: round trips, many tasks for one file, columns, and jobs that fail."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrace.sources.arrow_source import read_arrow, save_arrow

SCHEMA = "k long, d date, t timestamp, s string, a array<double>, b binary, m decimal(10,2)"


def rows(spark, n):
    own = spark.range(n).select(
        F.col("id").alias("k"), F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.timestamp_seconds("id").alias("t"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("s"),
        F.array(F.col("id").cast("double"), F.lit(None).cast("double")).alias("a"), F.col("id").cast("string").cast("binary").alias("b"), (F.col("id") / 4).cast("decimal(10,2)").alias("m"),
    )
    return own.repartition(3)


def test_round_trip_append_and_overwrite(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    save_arrow(rows(spark, 1000), path)
    assert sorted(map(str, read_arrow(spark, path).collect())) == sorted(map(str, rows(spark, 1000).collect()))
    save_arrow(rows(spark, 10), path, "append")
    assert read_arrow(spark, path).count() == 1010
    save_arrow(rows(spark, 5), path)
    assert read_arrow(spark, path).count() == 5 and not [x for x in os.listdir(tmp_path / "t") if x.startswith("_")]
    save_arrow(rows(spark, 0), path)
    assert read_arrow(spark, path, rows(spark, 0).schema).count() == 0


def test_a_large_file_is_many_tasks_and_only_columns_asked_for(spark, tmp_path):
    table = pa.table({"a": range(10_000), "b": ["x" * 50] * 10_000, "c": [1.5] * 10_000})
    with pa.OSFile(f"{tmp_path}/one.feather", "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=100)
    found = read_arrow(spark, f"{tmp_path}/one.feather", columns=["c", "a"], batches=10)
    assert found.columns == ["c", "a"] and found.rdd.getNumPartitions() == 10
    assert found.agg(F.sum("a"), F.sum("c")).first() == (sum(range(10_000)), 15_000.0)
    with pytest.raises(Exception, match="no columns"):
        read_arrow(spark, f"{tmp_path}/one.feather", schema=rows(spark, 0).schema).count()


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    save_arrow(rows(spark, 20), path)
    broken = rows(spark, 20).withColumn("s", F.when(F.col("k") == 17, F.raise_error(F.lit("lost"))).otherwise(F.col("s")).cast("string"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="lost"):
            save_arrow(broken, path, mode)
        assert read_arrow(spark, path).count() == 20 and not [x for x in os.listdir(tmp_path / "t") if x.startswith("_")]
