"""The incremental index computes changed CBSAs alone and equals a full run."""

import os

import pytest
from pyspark.sql import functions as F

from terrace.config import DRIVER
from terrace.plans.incremental import IncrementalIndex, marks
from terrace.plans.pipeline import IndexPipeline
from terrace.sources import tables

SMALL = "/root/testdata/sf0.001"


def shown(df):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.collect())


def test_only_changed_partitions_are_written(spark, tmp_path):
    t, g, m = (f(spark, SMALL) for f in (tables.transactions, tables.geography, tables.measures))
    index = IncrementalIndex(spark, f"file://{tmp_path}", DRIVER)
    cities = sorted(r.cbsa_code for r in g.select("cbsa_code").distinct().collect())
    assert index.update(t, g) == cities and index.update(t.orderBy("tiebreak"), g) == []
    less = t.where("cbsa_code != '10007' or transaction_date < '1999-01-01'")
    assert index.update(less, g) == ["10007"]
    folders = sorted(os.listdir(f"{index.folder}/cells".removeprefix("file://")))
    written = [sorted(x for x in os.listdir(f"{index.folder}/cells/{f}".removeprefix("file://")) if x.startswith("cbsa")) for f in folders]
    assert sorted(map(len, written))[0] <= 1 and len(folders) == 2
    full = IndexPipeline(spark, DRIVER).run(less, g, m)
    got = index.run(less, g, m)
    for name in ("half_pairs", "mapping", "appreciation", "city_index", "tract_index"):
        assert shown(got[name].select(full[name].columns)) == shown(full[name]), name
    # A city that is gone is gone from the stages.
    index.update(less.where("cbsa_code != '10003'"), g.where("cbsa_code != '10003'"))
    assert index.stage("supertracts").where("cbsa_code = '10003'").count() == 0 and index.state.read().count() == len(cities) - 1


def test_a_failed_run_leaves_the_state(spark, tmp_path):
    t, g = tables.transactions(spark, SMALL), tables.geography(spark, SMALL)
    index = IncrementalIndex(spark, f"file://{tmp_path}", DRIVER)
    index.update(t, g)
    before = shown(index.stage("appreciation"))
    lost = t.withColumn("census_tract", F.when(F.col("cbsa_code") == "10001", F.raise_error(F.lit("lost"))).otherwise(F.col("census_tract")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        index.update(lost, g)
    assert shown(index.stage("appreciation")) == before and len(index.state.versions()) == 1


def test_marks_do_not_depend_on_order(spark):
    t, g = tables.transactions(spark, SMALL), tables.geography(spark, SMALL)
    assert shown(marks(t, g)) == shown(marks(t.repartition(5, "tiebreak"), g.orderBy("census_tract")))
    assert shown(marks(t.unionByName(t.limit(1)), g)) != shown(marks(t, g))
