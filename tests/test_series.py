"""Unit-root and cointegration tests against plain formulas and series whose nature is known."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry
from terrace.operators import series


def test_dickey_fuller_without_lags_equals_the_plain_regression():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.standard_normal(60))
    d, lag = np.diff(x), x[:-1]
    sxx = ((lag - lag.mean()) ** 2).sum()
    b = ((lag - lag.mean()) * (d - d.mean())).sum() / sxx
    sse = ((d - d.mean() - b * (lag - lag.mean())) ** 2).sum()
    got = series._least_squares(*series._lagged(x, 0, 0, True))
    assert got == pytest.approx((b / math.sqrt(sse / (len(d) - 2) / sxx), sse))


def test_lagged_rows():
    x, y = series._lagged(np.array([1.0, 2.0, 4.0, 7.0, 11.0]), 2, 2, True)
    assert x.tolist() == [[4.0, 2.0, 1.0, 1.0], [7.0, 3.0, 2.0, 1.0]] and y.tolist() == [3.0, 4.0]


def test_level_stationarity_equals_the_plain_formula():
    x = np.random.default_rng(2).standard_normal(80)
    stat, lags = series.level_stationarity(x)
    e, n = x - x.mean(), 80
    long_run = sum(a * b * max(0, 1 - abs(i - j) / (lags + 1)) for i, a in enumerate(e) for j, b in enumerate(e)) / n
    assert stat == pytest.approx(sum(e[: i + 1].sum() ** 2 for i in range(n)) / n**2 / long_run)


def test_sizes_and_power():
    rng = np.random.default_rng(3)
    noise = [rng.standard_normal(100) for _ in range(200)]
    unit = lambda x: (f := series.dickey_fuller(x)) and f[0] < series.critical(series.ONE_SERIES, f[2])
    assert np.mean([unit(x) for x in noise]) > 0.9 and np.mean([unit(np.cumsum(x)) for x in noise]) < 0.15
    level = lambda x: series.level_stationarity(x)[0] < series.LEVEL_POINT
    assert np.mean([level(x) for x in noise]) > 0.85 and np.mean([level(np.cumsum(x)) for x in noise]) < 0.4
    assert series.critical(series.ONE_SERIES, 100) == pytest.approx(-2.8909, abs=1e-3)
    assert series.dickey_fuller(np.ones(50)) is None and series.level_stationarity(np.ones(50)) is None and series.dickey_fuller(np.zeros(2)) is None


def test_groups(spark):
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.standard_normal(60))
    one = [(k, 1960 + i, float(v)) for k, x in (("near", walk + 0.1 * rng.standard_normal(60)), ("far", np.cumsum(rng.standard_normal(60))), ("same", 2 * walk + 1), ("short", walk[:9])) for i, v in enumerate(x)]
    two = [(k, 1960 + i, float(v)) for k in ("near", "far", "same", "short") for i, v in enumerate(walk)]
    schema = "name string, year int, index_value double"
    own, other = spark.createDataFrame([*one, ("near", 2030, None)], schema), spark.createDataFrame(two, schema)
    got = {r.name: r for r in series.cointegration(own, other, ["name", "year"], ["name"]).collect()}
    assert {k: (r.n, r.cointegrated) for k, r in got.items()} == {"near": (60, True), "far": (60, False), "same": (60, True), "short": (9, False)}
    assert got["same"].statistic == -math.inf and got["short"].statistic is None
    rates = np.exp(np.cumsum(0.02 + 0.01 * rng.standard_normal(80)))
    levels = spark.createDataFrame([*(("steady", 1900 + i, float(v)) for i, v in enumerate(rates)), ("flat", 1900, 1.0), ("flat", 1901, 1.0), ("flat", 1902, None)], schema)
    got = {r.name: r for r in series.stationarity(levels, ["name"]).collect()}
    assert got["steady"].is_stationary and got["steady"].n == 79
    assert got["flat"].is_stationary is None and got["flat"].adf is None and got["flat"].kpss is None
    assert series.stationarity(levels.where("false"), ["name"]).count() == 0 and series.cointegration(own.where("false"), other, ["name", "year"], ["name"]).count() == 0


@pytest.mark.parametrize("name", ["index_stationarity", "index_cointegration"])
def test_queries(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n > 0 for r in rows)


def test_p_values_against_published_points():
    # Asymptotic points with a constant at 1, 5 and 10 % (MacKinnon 2010), for one series and for two.
    for surface, points in ((series.ONE_P, (-3.43035, -2.86154, -2.56677)), (series.TWO_P, (-3.89644, -3.33613, -3.04445))):
        for point, share in zip(points, (0.01, 0.05, 0.10), strict=True):
            assert series.unit_root_p(point, surface) == pytest.approx(share, rel=0.04)
        at = [series.unit_root_p(x / 50, surface) for x in range(-1000, 300)]
        assert all(a <= b + 1e-3 for a, b in zip(at, at[1:], strict=False)) and at[0] == 0 and at[-1] == 1
        # Both polynomials agree where they meet.
        assert series.unit_root_p(surface["turn"] + 1e-9, surface) == pytest.approx(series.unit_root_p(surface["turn"], surface), abs=0.01)
    assert [series.level_p(x) for x in (0.1, 0.347, 0.405, 0.463, 0.739, 2.0)] == pytest.approx([0.1, 0.1, 0.075, 0.05, 0.01, 0.01])
