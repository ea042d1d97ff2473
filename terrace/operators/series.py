"""Unit-root and cointegration tests of index series. A group is one index: a few dozen years, whatever the number of sales."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.operators.validation import returns

# 5 % points in the number of observations T, b0 + b1 / T + b2 / T^2 + b3 / T^3 (MacKinnon 2010, with a constant).
ONE_SERIES = (-2.86154, -2.8903, -4.234, -40.040)
TWO_SERIES = (-3.33613, -6.1101, -6.823, 0.0)
# P-values of the unit-root statistic t with a constant, the normal distribution function of a polynomial in t (MacKinnon 1994),
# one up to the turning point and one beyond it, certain outside the range; for one series and for the residual of two.
ONE_P = {"range": (-18.83, 2.74), "turn": -1.61, "below": (2.1659, 1.4412, 0.038269), "above": (1.7339, 0.93202, -0.12745, -0.010368)}
TWO_P = {"range": (-18.86, 0.92), "turn": -2.62, "below": (2.92, 1.5012, 0.039796), "above": (2.1945, 0.64695, -0.29198, -0.042377)}
# Points of the level-stationarity statistic at 10, 5, 2.5 and 1 % (Kwiatkowski, Phillips, Schmidt and Shin 1992).
LEVEL_POINTS, LEVEL_SHARES = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)
# Fixed value: the 5 % point of the level-stationarity statistic (Kwiatkowski, Phillips, Schmidt and Shin 1992).
LEVEL_POINT = 0.463


def critical(points: tuple[float, ...], n: int) -> float:
    return sum(b / n**k for k, b in enumerate(points))


def unit_root_p(t: float, surface: dict) -> float:
    """Probability of a statistic of ``t`` or less where there is a unit root (or no cointegration)."""
    low, high = surface["range"]
    if not low <= t <= high:
        return float(t > high)
    x = sum(c * t**k for k, c in enumerate(surface["below" if t <= surface["turn"] else "above"]))
    return 0.5 * math.erfc(-x / math.sqrt(2))


def level_p(statistic: float) -> float:
    """Probability of a statistic that large where the series is stationary, between the published points; 0.1 and 0.01 stand for all beyond them."""
    return float(np.interp(statistic, LEVEL_POINTS, LEVEL_SHARES))


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """(t value of the first column, sum of squared residuals); none where it is not determined."""
    free = len(y) - x.shape[1]
    if free < 1 or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    sse = float(((y - x @ beta) ** 2).sum())
    error = math.sqrt(sse / free * np.linalg.inv(x.T @ x)[0, 0])
    return (float(beta[0]) / error, sse) if error > 1e-14 else None


def _lagged(values: np.ndarray, lags: int, skip: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (level, lagged changes, constant) and changes from position ``skip`` on."""
    d = np.diff(values)
    rows = np.arange(skip, len(d))
    columns = [values[rows], *(d[rows - k] for k in range(1, lags + 1))]
    return np.column_stack([*columns, np.ones(len(rows))] if constant else columns), d[rows]


def dickey_fuller(values: np.ndarray, constant: bool = True) -> tuple[float, int, int] | None:
    """(statistic, lags, observations); the number of lags has the least AIC over one common sample."""
    n = len(values)
    most = min(n // 2 - constant - 1, math.ceil(12 * (n / 100) ** 0.25))
    if most < 0:
        return None
    scores = []
    for lags in range(most + 1):
        x, y = _lagged(values, lags, most, constant)
        if fit := _least_squares(x, y):
            scores.append((len(y) * math.log(max(fit[1], 1e-300) / len(y)) + 2 * x.shape[1], lags))
    if not scores:
        return None
    lags = min(scores)[1]
    x, y = _lagged(values, lags, lags, constant)
    fit = _least_squares(x, y)
    return fit and (fit[0], lags, len(y))


def level_stationarity(values: np.ndarray) -> tuple[float, int] | None:
    """(statistic, lags) with Bartlett weights; the number of lags follows the data (Hobijn, Franses and Ooms 1998)."""
    n = len(values)
    if n < 3:
        return None
    e = values - values.mean()
    cov = lambda k: float(e[k:] @ e[: n - k]) / n
    if cov(0) < 1e-28:
        return None
    first = [2 * cov(k) for k in range(1, int(n ** (2 / 9)) + 1)]
    s0, s1 = cov(0) + sum(first), sum(k * c for k, c in enumerate(first, 1))
    lags = min(int(1.1447 * abs(s1 / s0) ** (2 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    variance = cov(0) + 2 * sum((1 - k / (lags + 1)) * cov(k) for k in range(1, lags + 1))
    return (float((np.cumsum(e) ** 2).sum()) / n**2 / variance, lags) if variance > 0 else None


def _groups(df: DataFrame, by: list[str], columns: list[str], f, schema: str) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns).sort_values("year", kind="stable")
        found = f(*(pdf[c].to_numpy(np.float64) for c in columns))
        return pd.DataFrame([[*key, *found]], columns=[*by, *(x.split()[0] for x in schema.split(", "))]).astype(object).where(lambda x: x.notna(), None)

    own = df.select(*by, "year", *columns)
    return own.groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in by), schema]))


def stationarity(levels: DataFrame, by: list[str]) -> DataFrame:
    """Both tests of each index's yearly returns at the 5 % level: ``is_stationary`` where they agree that it is.

    With p-values: from a response surface for the unit root, interpolated for stationarity. Null values are left out; a test that too few or constant returns leave undetermined is null, and so is the verdict."""

    def f(r: np.ndarray) -> list:
        unit, level = dickey_fuller(r), level_stationarity(r)
        point = unit and critical(ONE_SERIES, unit[2])
        rejects, holds = unit and unit[0] < point, level and level[0] < LEVEL_POINT
        verdict = None if unit is None or level is None else bool(rejects and holds)
        p = unit and unit_root_p(unit[0], ONE_P), level and level_p(level[0])
        return [len(r), *(unit or (None, None))[:2], point, rejects, *(level or (None, None)), holds, verdict, *p]

    schema = "n long, adf double, adf_lags int, adf_critical double, adf_rejects boolean, kpss double, kpss_lags int, kpss_holds boolean, is_stationary boolean, adf_p double, kpss_p double"
    return _groups(returns(levels.where("index_value is not null"), by), by, ["r"], f, schema)


def cointegration(own: DataFrame, other: DataFrame, on: list[str], by: list[str], least: int = 20) -> DataFrame:
    """Engle-Granger test of two indices over their common years at the 5 % level; under ``least`` years it is false with no statistic.

    With its p-value, from a response surface. Null values are left out. Series that differ by a linear map only leave no residual: minus infinity, and true."""

    def f(y: np.ndarray, x: np.ndarray) -> list:
        if len(y) < least:
            return [len(y), None, None, None, False, None]
        design = np.column_stack([x, np.ones(len(x))])
        e = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        point = critical(TWO_SERIES, len(y) - 1)
        if (e @ e) <= 100 * math.sqrt(np.finfo(float).eps) * ((y - y.mean()) ** 2).sum():
            return [len(y), -math.inf, None, point, True, 0.0]
        unit = dickey_fuller(e, constant=False)
        return [len(y), *(unit or (None, None))[:2], point, bool(unit and unit[0] < point), unit and unit_root_p(unit[0], TWO_P)]

    both = own.select(*on, F.col("index_value").alias("y")).join(other.select(*on, F.col("index_value").alias("x")), on)
    return _groups(both, by, ["y", "x"], f, "n long, statistic double, lags int, critical double, cointegrated boolean, p double")
