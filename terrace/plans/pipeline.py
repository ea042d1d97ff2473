"""The whole index as one plan: pairs, cells, supertracts, fits, weights, levels and panels."""

from __future__ import annotations

import argparse
import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from terrace.config import Settings
from terrace.operators import areas, bmn, indices, pairs
from terrace.sources import tables

log = logging.getLogger("terrace")


def session(name: str = "terrace", **conf: str) -> SparkSession:
    """A session with adaptive execution; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return builder.config(map=conf).getOrCreate()


@contextmanager
def timed(stage: str):
    began = time.monotonic()
    try:
        yield
    finally:
        log.info("%s took %.1f s", stage, time.monotonic() - began)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Row and null counts that an action on the result fills in, without an action of their own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns)), seen


class IndexPipeline:
    """Cells, supertracts and appreciation are computed and written when ``run`` is called; what comes after them is lazy.

    With a folder they are kept there, and pairs too, by settings and inputs, for later runs."""

    def __init__(self, spark: SparkSession, settings: Settings, folder: str | None = None):
        self.spark, self.s, self.folder = spark, settings, folder

    def run(self, transactions: DataFrame, geography: DataFrame, measures: DataFrame) -> dict[str, DataFrame]:
        s = self.s
        good = pairs.apply_filters(pairs.repeat_sales(transactions), s)
        if self.folder:
            stage = tables.Stages(self.spark, self.folder, s, (transactions, geography)).get
            filtered = stage("pairs", lambda: good)
        else:
            # Several branches start from the stages; written, each is planned and computed once.
            filtered, stage = good, tables.Scratch(self.spark, tables.shared_folder(self.spark, "index")).get
        # Everything but the pairs themselves comes from cells.
        cells = stage("cells", lambda: bmn.cells(filtered, ["cbsa_code", "census_tract"]))
        halves = pairs.half_pairs_of_cells(cells)
        grid = pairs.half_pair_grid(halves, geography, s.first_year, s.end_year)
        mapping = stage("supertracts", lambda: areas.supertracts(grid, geography, s.min_half_pairs, s.unit).where(F.col("year") >= s.start_year))
        grown = stage("appreciation", lambda: self.appreciation(cells, mapping))
        return {"pairs": filtered} | self.finish(cells, mapping, grown, geography, measures)

    def finish(self, cells: DataFrame, mapping: DataFrame, grown: DataFrame, geography: DataFrame, measures: DataFrame) -> dict[str, DataFrame]:
        """Weights, levels and panels from the stages."""
        s = self.s
        halves = pairs.half_pairs_of_cells(cells)
        grid = pairs.half_pair_grid(halves, geography, s.first_year, s.end_year)
        # Stages hold what depends on transactions and geography; measures come in after them.
        weights = indices.weights(grid.where(F.col("year") >= s.start_year), measures, "supertract_id", s.schemes, mapping)
        city = indices.city_appreciation(grown, weights, "supertract_id")
        levels = indices.city_index(city, s.start_year, s.end_year, s.base_year, s.base_value, geography, s.schemes)
        # A tract's appreciation is its supertract's of the year.
        by_tract = mapping.join(grown, ["cbsa_code", "year", "supertract_id"]).select("census_tract", "year", "appreciation")
        w = Window.partitionBy("census_tract").orderBy("year")
        chained = by_tract.withColumn("index_value", s.base_value * F.exp(F.sum("appreciation").over(w.rowsBetween(Window.unboundedPreceding, 0))))
        panel = indices.tract_panel(chained, geography, s.start_year, s.end_year, s.base_year, s.base_value)
        return {"half_pairs": halves, "mapping": mapping, "appreciation": grown, "weights": weights, "city_appreciation": city, "city_index": levels, "tract_index": panel}

    def appreciation(self, cells: DataFrame, mapping: DataFrame) -> DataFrame:
        """(cbsa_code, year, supertract_id, appreciation): year's own supertracts for both of its coefficients.

        Cells, not pairs, are joined to the mapping of each year. Supertracts of equal membership in several years
        are fitted once: a fit is keyed by its tract list."""
        lists = mapping.groupBy("cbsa_code", "year", "supertract_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("census_tract")), ","), 256).alias("area"))
        tracts = mapping.join(lists, ["cbsa_code", "year", "supertract_id"]).select("cbsa_code", "census_tract", "area").distinct()
        if self.s.window == "pair":
            years = bmn.regroup(cells.where("year_2 = year_1 + 1"), tracts, ["cbsa_code", "census_tract"], ["area"])
            grown = years.select("area", F.col("year_2").alias("year"), (F.col("s") / F.col("n")).alias("appreciation"))
        else:
            grown = bmn.appreciation(bmn.coefficients(bmn.regroup(cells, tracts, ["cbsa_code", "census_tract"], ["area"]), ["area"], self.s.ridge, self.s.min_obs), ["area"])
        return lists.join(grown, ["area", "year"]).select("cbsa_code", "year", "supertract_id", "appreciation")


def main(args: list[str] | None = None) -> None:
    """Command line: read three Parquet inputs and write the city index by scheme and the tract index. Sales of a property on one day are taken by price."""
    p = argparse.ArgumentParser(description=main.__doc__)
    for name in ("transactions", "geography", "measures", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--settings", help="a JSON file")
    p.add_argument("--stages", help="a folder for stage outputs")
    a = p.parse_args(args)
    spark, s = session(), Settings.load(a.settings) if a.settings else Settings()
    tx = tables.read(spark, a.transactions, tables.TRANSACTIONS).withColumn("tiebreak", F.col("transaction_price"))
    with timed("index"):
        out = IndexPipeline(spark, s, a.stages).run(tx, tables.read(spark, a.geography, tables.GEOGRAPHY), tables.read(spark, a.measures, tables.MEASURES))
        tables.save_results(out["city_index"], {"settings": s.key()}, a.output)
        tables.save(out["tract_index"], f"{a.output}/tracts")


if __name__ == "__main__":
    main()
