"""Cells of a stream in several batches equal those of one pass, whatever the order of sales."""

import random

import pytest
from pyspark.sql import functions as F

from terrace.config import DRIVER
from terrace.operators import bmn, pairs
from terrace.sources import tables
from terrace.streaming.pairing import CellStream, _adjacent


def some_sales(spark, n=120, seed=3):
    own = random.Random(seed)
    rows = [(f"p{own.randrange(9)}", f"{own.randrange(1995, 2002)}-{own.randrange(1, 13):02}-01", float(own.randrange(90, 130)), f"t{own.randrange(3)}", f"c{own.randrange(2)}", 1.0, i, 0) for i in range(n)]
    rows += [("p1", "1997-03-01", 100.0, "t1", "c1", 1.0, 7, 0)] * 3  # repeated rows of one day
    rows += [(None, "1997-03-01", 100.0, "t1", "c1", 1.0, 900, 0), ("p2", None, 100.0, "t1", "c1", 1.0, 901, 0), ("p2", "1998-01-01", None, "t1", "c1", None, 902, 0), ("p3", "1999-01-01", 0.0, "t1", "c1", 1.0, 903, 0)]
    own.shuffle(rows)
    dates = spark.createDataFrame([(i, d) for i, (_, d, *_) in enumerate(rows)], "i int, d string")
    numbered = spark.createDataFrame([(i, a, *r) for i, (a, _, *r) in enumerate(rows)], "i int, property_id string, transaction_price double, census_tract string, cbsa_code string, distance_to_cbd double, tiebreak long, sign int")
    return numbered.join(dates, "i").withColumn("transaction_date", F.col("d").cast("date")).drop("d")


def shown(cells):
    return sorted((r.cbsa_code, r.year_1, r.year_2, r.n, round(r.s, 9), round(r.ss, 9)) for r in cells.collect())


def test_batches_in_any_order_equal_one_pass(spark, tmp_path):
    sales = some_sales(spark).cache()
    loose = DRIVER.with_(max_cagr=5.0)
    want = bmn.cells(pairs.apply_filters(pairs.repeat_sales(sales.where("property_id is not null and transaction_date is not null")), loose), ["cbsa_code"])
    stream = CellStream(spark, f"file://{tmp_path}/cells", loose)
    schema = sales.schema
    # Three files in one call, and two more later, after the stream has stopped.
    for part, call in ((0, 0), (1, 0), (2, 0), (3, 1), (4, 1)):
        sales.where(f"i % 5 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{call}")
    for call in (0, 1):
        sales.sparkSession.read.parquet(f"{tmp_path}/in{call}").write.mode("append").parquet(f"{tmp_path}/sales")
        stream.advance(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/sales"))
    assert shown(stream.cells()) == shown(want)
    # Nothing new: nothing changes.
    stream.advance(spark.readStream.schema(schema).parquet(f"{tmp_path}/sales"))
    assert shown(stream.cells()) == shown(want)


def test_a_late_sale_ends_a_pair():
    sales = [(10, 0), (30, 0)]
    assert _adjacent(sales, 0) == ([(0, 1)], [])
    assert _adjacent([*sales, (20, 0)], 2) == ([(0, 2), (2, 1)], [(0, 1)])
    # One day: by tiebreak, then as they came.
    assert _adjacent([*sales, (30, -1), (30, 0)], 2) == ([(0, 2), (1, 3), (2, 1)], [(0, 1)])


def test_shared_folders(spark):
    assert tables.shared_folder(spark, "x") != tables.shared_folder(spark, "x")
    assert tables.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") or "file:")


@pytest.mark.parametrize("n", [0, 1])
def test_no_pairs_from_few_sales(spark, tmp_path, n):
    sales = some_sales(spark).where("property_id = 'p1'").limit(n)
    sales.write.parquet(f"{tmp_path}/sales")
    stream = CellStream(spark, f"file://{tmp_path}/cells", DRIVER)
    stream.advance(spark.readStream.schema(sales.schema).parquet(f"{tmp_path}/sales"))
    assert not (tmp_path / "cells/changes").exists() or stream.cells().count() == 0


def test_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("terrace.streaming.pairing.BUCKETS", 4, raising=False)
    sales = some_sales(spark).where("property_id is not null and transaction_date is not null").cache()
    sales.write.parquet(f"{tmp_path}/sales")
    loose = DRIVER.with_(max_cagr=5.0)
    stream = CellStream(spark, f"file://{tmp_path}/cells", loose)
    stream.advance(spark.readStream.schema(sales.schema).parquet(f"{tmp_path}/sales"))
    assert shown(stream.cells()) == shown(bmn.cells(pairs.apply_filters(pairs.repeat_sales(sales), loose), ["cbsa_code"]))
    assert sales.select("property_id").distinct().count() == 9 and spark.read.format("statestore").load(f"{tmp_path}/cells/checkpoint").count() <= 4
