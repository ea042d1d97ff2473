"""The index kept up to date by CBSA: what a change in some CBSAs doesn't touch is taken over.

Each CBSA has a mark, the number and the summed hashes of its sales and tracts, from one aggregation. CBSAs whose marks differ
from the last run's are computed again, into folders of that run; cells, supertracts and appreciation of the others stay where they
are. A snapshot of (CBSA, mark, run), committed last, says which run's partition counts, so a run that fails
leaves the state before it, and a reader meets one state or the other. Weights and levels come from the stages each time.

A property's sales lie in one CBSA. Rows without CBSA are left out. CBSAs that are gone from the input are gone from the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.config import Settings
from terrace.operators import areas, bmn, pairs
from terrace.plans.pipeline import IndexPipeline
from terrace.sources.snapshots import SnapshotTable

STAGES = ("cells", "supertracts", "appreciation")


def marks(transactions: DataFrame, geography: DataFrame) -> DataFrame:
    """(cbsa_code, mark): equal for equal rows in any order."""
    one = lambda df, name: df.where("cbsa_code is not null").groupBy("cbsa_code").agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).alias(name)
    )
    both = one(transactions, "sales").join(one(geography, "tracts"), "cbsa_code", "full")
    return both.select("cbsa_code", F.concat(F.coalesce("sales", F.lit("-")), F.lit("/"), F.coalesce("tracts", F.lit("-"))).alias("mark"))


class IncrementalIndex:
    """State below ``folder``, which the driver and all executors share; other settings have a state of their own."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.s, self.folder = spark, settings, f"{folder.rstrip('/')}/{settings.key()}"
        self.state = SnapshotTable(spark, f"{self.folder}/state")

    def update(self, transactions: DataFrame, geography: DataFrame) -> list[str]:
        """Compute changed CBSAs again; their codes (CBSAs are a few hundred)."""
        now = {r.cbsa_code: r.mark for r in marks(transactions, geography).collect()}
        before = {r.cbsa_code: r for r in self.state.read().collect()} if self.state.versions() else {}
        changed = sorted(c for c in now if c not in before or before[c].mark != now[c])
        if not changed and set(before) == set(now):
            return []
        run = uuid.uuid4().hex
        if changed:
            self._compute(transactions.where(F.col("cbsa_code").isin(changed)), geography.where(F.col("cbsa_code").isin(changed)), run)
        rows = [(c, m, run if c in set(changed) else before[c].run) for c, m in sorted(now.items())]
        self.state.replace(self.spark.createDataFrame(rows, "cbsa_code string, mark string, run string").coalesce(1))
        return changed

    def _compute(self, transactions: DataFrame, geography: DataFrame, run: str) -> None:
        s = self.s
        put = lambda name, df: df.write.partitionBy("cbsa_code").parquet(f"{self.folder}/{name}/run={run}")
        own = lambda name: self._read(name, f"{self.folder}/{name}/run={run}")
        put("cells", bmn.cells(pairs.apply_filters(pairs.repeat_sales(transactions), s), ["cbsa_code", "census_tract"]))
        grid = pairs.half_pair_grid(pairs.half_pairs_of_cells(own("cells")), geography, s.first_year, s.end_year)
        put("supertracts", areas.supertracts(grid, geography, s.min_half_pairs, s.unit).where(F.col("year") >= s.start_year))
        put("appreciation", IndexPipeline(self.spark, s).appreciation(own("cells"), own("supertracts")))

    def _read(self, name: str, path: str) -> DataFrame:
        schemas = {
            "cells": "census_tract string, year_1 int, year_2 int, n long, s double, ss double", "supertracts": areas.SUPERTRACT.replace("cbsa_code string, ", ""),
            "appreciation": "year int, supertract_id string, appreciation double",
        }
        return self.spark.read.schema(schemas[name] + ", cbsa_code string" + (", run string" if path.endswith(name) else "")).parquet(path)

    def stage(self, name: str) -> DataFrame:
        """A stage's rows of all CBSAs, each from the run that computed it last; other runs' partitions aren't read."""
        counts = self.state.read().select("cbsa_code", "run")
        return self._read(name, f"{self.folder}/{name}").join(F.broadcast(counts), ["cbsa_code", "run"]).drop("run")  # a row a CBSA

    def run(self, transactions: DataFrame, geography: DataFrame, measures: DataFrame) -> dict[str, DataFrame]:
        """Update, and give what ``IndexPipeline.run`` gives, without pairs."""
        self.update(transactions, geography)
        cells, mapping, grown = map(self.stage, STAGES)
        return IndexPipeline(self.spark, self.s).finish(cells, mapping, grown, geography, measures)
