"""Worked values, exact recovery and invariants of the index."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrace.config import ConfigError, DataError, Settings
from terrace.operators import areas, bmn, indices, pairs, validation
from terrace.plans.pipeline import IndexPipeline, observed
from terrace.sources import tables

TX = "property_id string, transaction_date date, transaction_price double, census_tract string, cbsa_code string, distance_to_cbd double, tiebreak long"


def sales(spark, *rows):
    return spark.createDataFrame([(p, dt.date.fromisoformat(d), float(x), t, "10000", 1.0, i) for i, (p, d, x, t) in enumerate(rows)], TX)


def test_three_sales_are_one_two_one(spark):
    t = sales(spark, ("a", "2010-01-01", 100, "t"), ("a", "2012-01-01", 110, "t"), ("a", "2014-01-01", 120, "t"), ("b", "2010-01-01", 5, "t"))
    got = {(r.property_id, r.position): r.half_pairs for r in pairs.half_pairs_by_position(t).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("a", 3): 1, ("b", 1): 0}
    halves = {r.year: r.total_half_pairs for r in pairs.half_pairs(pairs.repeat_sales(t)).collect()}
    assert halves == {2010: 1, 2012: 2, 2014: 1}


def test_pairs_and_filters(spark):
    t = sales(
        spark, ("a", "2010-01-01", 100, "t"), ("a", "2010-06-01", 101, "t"), ("a", "2013-06-01", 110, "u"), ("b", "2010-01-01", 100, "t"), ("b", "2011-01-01", 400, "t"),
        ("c", "2010-01-01", 100, "t"), ("c", "2010-01-01", 100, "t"), ("d", "2010-01-01", 0, "t"), ("d", "2012-01-01", 10, "t"),
    )
    made = pairs.repeat_sales(t)
    assert made.count() == 5
    kept = pairs.apply_filters(made, Settings()).collect()
    assert [(r.property_id, r.census_tract) for r in kept] == [("a", "t")]
    assert kept[0].price_relative == pytest.approx(math.log(110 / 101))
    audit = {r.name: (r.rows_in, r.rows_out) for r in pairs.filter_audit(made, Settings()).collect()}
    assert audit["same_period"] == (5, 3) and audit["cumulative"][1] == 1


def test_empty_tables(spark):
    t = sales(spark, ("a", "2010-01-01", 100, "t")).where("false")
    made = pairs.repeat_sales(t)
    assert pairs.apply_filters(made, Settings()).count() == 0
    assert {r.rows_in for r in pairs.filter_audit(made, Settings()).collect()} == {0}
    assert bmn.coefficients(bmn.cells(made, ["cbsa_code"]), ["cbsa_code"]).count() == 0
    assert all(r.ok for r in validation.pair_checks(made).collect())


def test_fit_equals_least_squares():
    rng = np.random.default_rng(1)
    y1 = rng.integers(2000, 2008, 200)
    y2 = y1 + rng.integers(1, 4, 200)
    p = (y2 - y1) * 0.05 + rng.normal(0, 0.1, 200)
    cells = pd.DataFrame({"a": y1, "b": y2, "p": p}).groupby(["a", "b"]).p.agg(["count", "sum", lambda x: (x * x).sum()]).reset_index()
    fit = bmn.fit_cells(*(cells[c].to_numpy() for c in cells.columns), 0.0, 1)
    years = fit["years"]
    x = (y2[:, None] == years[None, 1:]).astype(float) - (y1[:, None] == years[None, 1:])
    beta, *_ = np.linalg.lstsq(x, p, rcond=None)
    e = p - x @ beta
    s2 = e @ e / (len(p) - len(beta))
    assert np.allclose(fit["delta"][1:], beta) and np.isclose(fit["sse"], e @ e)
    assert np.allclose(fit["error"][1:], np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))))
    assert np.isclose(fit["r_squared"], 1 - e @ e / ((p - p.mean()) ** 2).sum())


def test_unconnected_years_have_no_appreciation(spark):
    cells = spark.createDataFrame([("a", 2000, 2001, 5, 0.5, 0.05), ("a", 2002, 2003, 5, 0.25, 0.0125)], "id string, year_1 int, year_2 int, n long, s double, ss double")
    got = {r.year: r.appreciation for r in bmn.appreciation(bmn.coefficients(cells, ["id"], least=1), ["id"]).collect()}
    assert got.keys() == {2001, 2003} and got[2001] == pytest.approx(0.1) and got[2003] == pytest.approx(0.05, abs=1e-6)


def plain_merge(rows, least):
    """The rule again, on tuples and lists."""
    found = [([t], now, before, lat, lon) for t, now, before, lat, lon in rows]
    while len(found) > 1:
        low = sorted((min(a[1], a[2]), min(a[0])) for a in found if min(a[1], a[2]) < least)
        if not low:
            break
        own = next(a for a in found if min(a[0]) == low[0][1])
        found.remove(own)
        d = lambda a: (round(float(areas._haversine(own[3], own[4], a[3], a[4], "km")), 9), min(a[0]))  # noqa: B023, E731
        other = min(found, key=d)
        found.remove(other)
        n, m = len(own[0]), len(other[0])
        found.append((own[0] + other[0], own[1] + other[1], own[2] + other[2], (own[3] * n + other[3] * m) / (n + m), (own[4] * n + other[4] * m) / (n + m)))
    return {frozenset(a[0]) for a in found}


@pytest.mark.parametrize("seed", range(5))
def test_merging_equals_plain_version(seed):
    rng = np.random.default_rng(seed)
    rows = [(f"{i:03d}", int(rng.integers(0, 12)), int(rng.integers(0, 12)), float(rng.uniform(30, 31)), float(rng.uniform(-100, -99))) for i in range(20)]
    pdf = pd.DataFrame(rows, columns=["census_tract", "now", "before", "centroid_lat", "centroid_lon"]).assign(cbsa_code="1", year=2000)
    got = areas.merge_tracts(pdf, 10)
    assert {frozenset(g.census_tract) for _, g in got.groupby("supertract_id")} == plain_merge(rows, 10)
    assert sorted(got.census_tract) == sorted(r[0] for r in rows)
    assert all(g.census_tract.min() == k for k, g in got.groupby("supertract_id"))


def test_weights_and_chain(spark):
    w = spark.createDataFrame([("c", x) for x in (10.0, 20.0, 30.0)] + [("z", 0.0)] * 2, "k string, raw double")
    got = indices.normalised(w, ["k"]).collect()
    assert sorted(round(r.weight, 6) for r in got) == sorted([round(1 / 6, 6), round(1 / 3, 6), 0.5, 0.5, 0.5])
    a = spark.createDataFrame([("c", "sample", y, x) for y, x in ((2001, 0.05), (2002, 0.03), (2003, 0.04))], "cbsa_code string, weight_type string, year int, appreciation double")
    level = {r.year: r.index_value for r in indices.city_index(a, 2000, 2003, 2000).collect()}
    assert [level[y] for y in range(2000, 2004)] == pytest.approx([100 * math.exp(x) for x in (0, 0.05, 0.08, 0.12)])


def test_noise_free_prices_are_recovered(spark, tmp_path):
    s = Settings(first_year=2000, start_year=2001, base_year=2001, end_year=2020, min_half_pairs=20, min_obs=5)
    tx = tables.sample_transactions(spark, 4000, tracts=20, cbsas=4)
    geo = tx.select("census_tract", "cbsa_code").distinct().select("*", (30 + F.substring("census_tract", 6, 6).cast("int") * 0.05).alias("centroid_lat"), F.lit(-100.0).alias("centroid_lon"))
    years = tx.select("census_tract", "cbsa_code").distinct().withColumn("year", F.explode(F.sequence(F.lit(2001), F.lit(2020))))
    m = years.select("*", *(F.lit(1.0).alias(c) for c in ("value_measure", "unit_measure", "upb_measure", "college_share", "nonwhite_share")))
    out = IndexPipeline(spark, s, f"file://{tmp_path}").run(tx, geo, m)
    city = out["city_index"].collect()
    assert len(city) == 4 * 6 * 20
    for r in city:
        assert r.index_value == pytest.approx(100 * math.exp(0.04 * (r.year - 2001)), rel=1e-6)
    mapping = out["mapping"]
    assert mapping.groupBy("year", "census_tract").count().where("count != 1").count() == 0
    assert mapping.groupBy("year", "supertract_id").agg(F.countDistinct("cbsa_code").alias("n")).where("n > 1").count() == 0
    lonely = mapping.where("below_threshold").join(mapping.groupBy("year", "cbsa_code").agg(F.countDistinct("supertract_id").alias("areas")), ["year", "cbsa_code"])
    assert lonely.where("areas > 1").count() == 0
    assert all(r.ok for r in indices.weight_checks(out["weights"], ).collect())
    halves = out["half_pairs"].agg(F.sum("total_half_pairs")).first()[0]
    assert halves == 2 * out["pairs"].count()


def test_settings_and_sources(spark, tmp_path):
    with pytest.raises(ConfigError):
        Settings(base_year=1950)
    with pytest.raises(ConfigError):
        Settings(schemes=("sample", "other"))
    Settings(min_days=365).save(f"{tmp_path}/s.json")
    assert Settings.load(f"{tmp_path}/s.json") == Settings(min_days=365) != Settings()
    assert Settings().key() != Settings(min_days=365).key()
    t = tables.sample_transactions(spark, 20)
    for fmt in tables.FORMATS:
        tables.save(t.drop("tiebreak"), f"{tmp_path}/{fmt}", fmt)
        assert tables.read(spark, f"{tmp_path}/{fmt}", tables.TRANSACTIONS, fmt, ["property_id", "transaction_date"]).count() == t.count()
    assert tables.schema_errors(t, tables.TRANSACTIONS) == [] and tables.schema_errors(t.drop("cbsa_code"), tables.TRANSACTIONS) == ["missing column cbsa_code"]
    own, seen = observed(t, "t")
    own.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == t.count() and seen.get["null_cbsa_code"] == 0


def test_pairs_take_one_shuffle(spark):
    plan = pairs.repeat_sales(tables.sample_transactions(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Python" not in plan


def test_measures_of_merged_areas(spark):
    schema = "census_tract string, cbsa_code string, year int, value_measure double, unit_measure double, upb_measure double, college_share double, nonwhite_share double"
    measures = spark.createDataFrame([("a", "1", 2000, 5.0, 1.0, 4.0, 0.2, None), ("b", "1", 2000, 7.0, 3.0, None, 0.6, None), ("c", "1", 2000, 1.0, 0.0, 1.0, 0.5, 0.1)], schema)
    mapping = spark.createDataFrame([("1", 2000, "x", "a"), ("1", 2000, "x", "b"), ("1", 2000, "y", "c")], "cbsa_code string, year int, supertract_id string, census_tract string")
    got = {r.supertract_id: tuple(r)[3:] for r in areas.aggregate_measures(measures, mapping, ("cbsa_code", "year", "supertract_id")).collect()}
    assert got["x"] == pytest.approx((12.0, 4.0, 4.0, 0.5, None)) and got["y"] == pytest.approx((1.0, 0.0, 1.0, 0.5, 0.1))


def test_health_of_an_index(spark):
    own = spark.createDataFrame([(2000, f"w{k}", 100.0 + k) for k in range(6)], "year int, weight_type string, index_value double")
    assert validation.index_health(own).first().ok and not validation.index_health(own.where("weight_type <> 'w3'")).first().ok
    assert not validation.index_health(own.where("false")).first().ok


def test_checks_of_all_tables_as_one_report(spark):
    good = spark.createDataFrame([("a", 0, True)], "check_name string, violations long, ok boolean")
    bad = spark.createDataFrame([("b", 3, False)], good.schema)
    both = validation.every_check({"x": good, "y": bad})
    assert {tuple(r) for r in both.collect()} == {("x", "a", 0, True), ("y", "b", 3, False)}
    assert validation.report(both).splitlines() == ["ok   a: 0", "FAIL b: 3"]
    validation.strict(good)
    with pytest.raises(DataError, match="b"):
        validation.strict(both)


def test_stages_follow_settings_and_inputs(spark, tmp_path):
    tables.save(tables.sample_transactions(spark, 20), f"file://{tmp_path}/in")
    own = lambda: spark.read.parquet(f"file://{tmp_path}/in")
    folder = lambda s, *inputs: tables.Stages(spark, f"file://{tmp_path}/out", s, inputs).folder
    first = folder(Settings(), own())
    assert first == folder(Settings(), own()) != folder(Settings(min_days=1), own())
    assert first != folder(Settings(), own().where("transaction_price > 1"))
    tables.save(tables.sample_transactions(spark, 30), f"file://{tmp_path}/in")
    assert first != folder(Settings(), own())
    assert folder(Settings(), spark.range(3)) != folder(Settings(), spark.range(4))
    made = []
    for _ in range(2):
        stage = tables.Stages(spark, f"file://{tmp_path}/out", Settings(), (own(),))
        assert stage.get("n", lambda: made.append(1) or spark.range(5)).count() == 5
    assert made == [1]


def test_arrow_files(spark, tmp_path):
    table = pa.table({"more": [1, 2, 3], "census_tract": pa.array(["a", "b", None]).dictionary_encode(), "year": pa.array([1, 2, 3], pa.int64())})
    with pa.ipc.new_file(f"{tmp_path}/t.arrow", table.schema) as out:
        out.write_table(table, max_chunksize=2)
    got = tables.read(spark, f"{tmp_path}/t.arrow", tables.MEASURES, "arrow", ["census_tract", "year"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1), ("b", 2), (None, 3)], key=str)
    assert got.schema["year"].dataType == tables.MEASURES["year"].dataType
    with pytest.raises(DataError):
        tables.read(spark, f"{tmp_path}/t.arrow", tables.MEASURES, "other")


def test_narrowed_columns(spark):
    df = spark.createDataFrame([(1, 40000, 1 << 40, None, 0.5), (-5, None, 2, None, 1.5)], "a long, `b.c` long, d long, e long, f double")
    got = tables.narrowed(df)
    assert [t for _, t in got.dtypes] == ["smallint", "int", "bigint", "bigint", "double"]
    assert got.columns == df.columns and got.collect() == df.collect()
    assert tables.narrowed(df.where("false")).dtypes == df.dtypes


def test_quantiles_of_large_tables(spark):
    made = pairs.repeat_sales(tables.sample_transactions(spark, 3000))
    for f in (pairs.pair_statistics, pairs.repeat_sales_statistics):
        exact, near = f(made, None).first().asDict(), f(made).first().asDict()
        assert exact["n_pairs"] == made.count() and near["median_relative"] == pytest.approx(exact["median_relative"], abs=0.05)
        assert {k: v for k, v in exact.items() if "median" not in k} == pytest.approx({k: v for k, v in near.items() if "median" not in k})
    assert pairs.price_relative_summary(made, accuracy=10000).first()["median"] == pytest.approx(exact["median_relative"], abs=0.05)


def test_half_pairs_of_cells_are_those_of_pairs(spark):
    made = pairs.apply_filters(pairs.repeat_sales(tables.sample_transactions(spark, 500)), Settings())
    got = pairs.half_pairs_of_cells(bmn.cells(made, ["cbsa_code", "census_tract"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.half_pairs(made).collect()))
