"""Conjugate gradients against the dense solution."""

import random

import numpy as np
import pytest

from terrace.operators import bmn, sparse_fit

SCHEMA = "area string, period_1 int, period_2 int, n long, s double, x int, d double"


def some_cells(areas, periods, edges, seed=5):
    own, rows = random.Random(seed), []
    for a in range(areas):
        for k in range(1, periods):  # a tree connects all periods
            rows.append((f"a{a}", own.randrange(k), k, own.randrange(1, 9), own.gauss(0, 1), 0, 0.0))
        rows += [(f"a{a}", *sorted(own.sample(range(periods), 2)), own.randrange(1, 9), own.gauss(0, 1), 0, 0.0) for _ in range(edges)]
    return rows


def dense(rows):
    out = {}
    for area in sorted({r[0] for r in rows}):
        y1, y2, n, s = (np.array([r[k] for r in rows if r[0] == area]) for k in (1, 2, 3, 4))
        if n.sum() >= 10:
            fit = bmn.fit_cells(y1, y2, n, s, np.zeros(len(n)), 1e-8, 10)
            out |= {(area, int(y)): d for y, d in zip(fit["years"], fit["delta"], strict=True)}
    return out


def test_equal_to_the_dense_solution(spark):
    rows = [*some_cells(3, 60, 150), ("few", 1, 2, 9, 1.0, 0, 0.0), ("zero", 1, 2, 20, 0.0, 0, 0.0), ("two", 4, 9, 20, 3.0, 0, 0.0)]
    found = sparse_fit.coefficients(spark.createDataFrame(rows, SCHEMA), ["area"]).collect()
    want = dense(rows)
    assert {(r.area, r.period) for r in found} == set(want)
    assert max(abs(r.delta - want[r.area, r.period]) for r in found) < 1e-8
    assert max(r.residual for r in found) <= 1e-11 and 0 < found[0].steps <= 60


def test_steps_are_bounded_and_the_residual_tells(spark):
    found = sparse_fit.coefficients(spark.createDataFrame(some_cells(1, 40, 20), SCHEMA), ["area"], most=3).collect()
    assert found[0].steps == 3 and max(r.residual for r in found) > 1e-11
    assert sparse_fit.coefficients(spark.createDataFrame([], SCHEMA), ["area"]).count() == 0
    with pytest.raises(ValueError, match="period"):
        sparse_fit.period("d", "week")
