"""Sketch tables against exact figures."""

import random
import statistics

import pytest

from terrace.operators import pairs, sketches

SCHEMA = "tract string, year int, property_id string, price_relative double, n long, s string"


def rows(n=6000, seed=2):
    own = random.Random(seed)
    return [(f"t{own.randrange(5)}", 2000 + own.randrange(4), f"p{own.randrange(n // 3)}", own.gauss(0, 1) ** 3, 0, "") for _ in range(n)]


@pytest.mark.parametrize("by", [["tract"], ["year"], []])
def test_figures_of_any_grouping(spark, by):
    data = rows()
    table = sketches.sketched(spark.createDataFrame(data, SCHEMA), ["tract", "year"])
    for r in sketches.figures(sketches.merged(table, by), by).collect():
        own = [x for x in data if all(x[("tract", "year").index(c)] == r[c] for c in by)]
        values = sorted(x[3] for x in own)
        assert (r["n_pairs"], r["min"], r["max"]) == (len(own), values[0], values[-1])
        assert r["mean"] == pytest.approx(statistics.fmean(values)) and r["std"] == pytest.approx(statistics.stdev(values))
        for q, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
            assert abs(sum(v <= r[q] for v in values) / len(values) - p) <= sketches.rank_error()
        distinct = len({x[2] for x in own})
        assert abs(r["n_properties"] - distinct) <= 2 * sketches.distinct_error() * distinct


def test_few_rows_are_exact_and_nulls_do_not_count(spark):
    data = [("a", 1, "p", 1.0, 0, ""), ("a", 1, "p", 3.0, 0, ""), ("a", 2, "q", 2.0, 0, ""), ("a", 2, None, None, 0, ""), ("b", 1, None, None, 0, "")]
    table = sketches.sketched(spark.createDataFrame(data, SCHEMA), ["tract", "year"])
    found = {r["tract"]: r.asDict() for r in sketches.figures(sketches.merged(table, ["tract"]), ["tract"]).collect()}
    assert found["a"] == {"tract": "a", "n_pairs": 4, "n_properties": 2, "mean": 2.0, "std": 1.0, "min": 1.0, "p25": 1.0, "median": 2.0, "p75": 3.0, "max": 3.0}
    assert found["b"] == {"tract": "b", "n_pairs": 1, "n_properties": 0, "mean": None, "std": None, "min": None, "p25": None, "median": None, "p75": None, "max": None}
    none = sketches.figures(sketches.merged(table.where("false"), []), []).first()
    assert (none["n_pairs"], none["n_properties"], none["median"]) == (0, 0, None)


def test_global_statistics_are_bounded_by_default(spark):
    frame = spark.createDataFrame([(f"p{i}", "t", "c", i / 1000, 1.0, 0.1, "1999-01-01", "2000-01-01") for i in range(5000)], "property_id string, census_tract string, cbsa_code string, price_relative double, time_diff_years double, cagr double, sale_date_1 string, sale_date_2 string")
    plan = pairs.pair_statistics(frame)._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan
    assert abs(pairs.pair_statistics(frame).first()["median_relative"] - pairs.pair_statistics(frame, None).first()["median_relative"]) <= 2 * 5000 / 10_000 / 1000 + 1e-3


def test_distinct_counts_of_many_groups_keep_their_bound(spark):
    # Merged sketches have no order of arrival to estimate from, so each of forty groups needs room within the bound.
    frame = spark.range(200_000).selectExpr("concat('t', id % 40) as tract", "cast(id div 40 % 4 as int) as year", "cast(id as string) as property_id", "1.0d as price_relative")
    table = sketches.sketched(frame, ["tract", "year"])
    found = [r["n_properties"] for r in sketches.figures(sketches.merged(table, ["tract"]), ["tract"]).collect()]
    assert len(found) == 40 and max(abs(n - 5000) for n in found) <= sketches.distinct_error() * 5000
