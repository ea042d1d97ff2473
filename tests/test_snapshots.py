"""Snapshots: upserts against a plain dictionary, failed and racing writers, older states."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.config import DataError
from terrace.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "k string, year int, v double, seen int"


def shown(df):
    return sorted((r.k or "", r.year or 0, r.v, r.seen) for r in df.collect())


def test_upserts_equal_a_dictionary(spark, tmp_path):
    own, table, want, states = random.Random(4), SnapshotTable(spark, f"file://{tmp_path}/t"), {}, []
    for turn in range(4):
        rows = [(own.choice(["a", "b", None, "d"]), own.choice([1, 2, None]), own.random(), turn * 100 + i) for i in range(7)]
        for r in sorted(rows, key=lambda r: r[3]):
            want[r[:2]] = r
        assert table.upsert(spark.createDataFrame(rows, SCHEMA), ["k", "year"], "seen") == turn + 1
        states.append(sorted((k or "", y or 0, v, s) for k, y, v, s in want.values()))
        assert shown(table.read()) == states[-1]
    assert [shown(table.read(v)) for v in table.versions()] == states
    assert table.upsert(spark.createDataFrame([], SCHEMA), ["k", "year"]) == 5 and shown(table.read()) == states[-1]
    assert table.append(spark.createDataFrame([("z", 9, 0.5, 1)], SCHEMA)) == 6 and shown(table.read()) == sorted([*states[-1], ("z", 9, 0.5, 1)])
    assert table.vacuum(keep=2) > 0 and table.versions() == [5, 6] and shown(table.read(5)) == states[-1] and table.vacuum(2) == 0


def test_a_failed_writer_leaves_the_old_snapshot(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(DataError):
        table.read()
    first = spark.createDataFrame([("a", 1, 1.0, 1)], SCHEMA)
    table.replace(first)
    broken = spark.createDataFrame([("b", 1, 1.0, 1)], SCHEMA).withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).cast("double"))
    for change in (lambda: table.replace(broken), lambda: table.append(broken), lambda: table.upsert(broken, ["k"])):
        with pytest.raises(Exception, match="lost"):
            change()
        assert table.versions() == [1] and shown(table.read()) == [("a", 1, 1.0, 1)]
    with pytest.raises(DataError, match="columns"):
        table.append(first.drop("v"))
    with pytest.raises(DataError, match="snapshot 7"):
        table.read(7)
    assert table.vacuum() >= 1 and shown(table.read()) == [("a", 1, 1.0, 1)]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    one, two = (SnapshotTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.replace(spark.createDataFrame([("a", 1, 1.0, 1)], SCHEMA))
    write = one._write

    def slow(df):  # the other commits while this one writes
        part = write(df)
        two.append(spark.createDataFrame([("b", 2, 2.0, 2)], SCHEMA))
        return part

    monkeypatch.setattr(one, "_write", slow)
    with pytest.raises(Conflict):
        one.append(spark.createDataFrame([("c", 3, 3.0, 3)], SCHEMA))
    assert shown(two.read()) == [("a", 1, 1.0, 1), ("b", 2, 2.0, 2)] and two.versions() == [1, 2]
