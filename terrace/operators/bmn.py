"""Bailey-Muth-Nourse regression from cells.

X'X of the -1/+1 design is a graph Laplacian over years and X'y has sums of log price differences, so counts and sums
by (area, year 1, year 2) are all that a fit needs. Cells are summed once for each tract and add up over tracts:
a fit for another grouping of tracts joins the grouping to cells, never to pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cells(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, year_1, year_2, n, s, ss): counts, sums and sums of squares of price relatives."""
    p = F.col("price_relative")
    own = pairs.select(*by, F.year("sale_date_1").alias("year_1"), F.year("sale_date_2").alias("year_2"), p)
    return own.groupBy(*by, "year_1", "year_2").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss"))


def regroup(cells_: DataFrame, mapping: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Cells of larger areas: ``mapping`` has ``on`` and ``by``."""
    return cells_.join(mapping.select(*dict.fromkeys([*on, *by])), on).groupBy(*by, "year_1", "year_2").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))


def fit_cells(y1: np.ndarray, y2: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray, ridge: float, least: int) -> dict | None:
    """Coefficients by year (0 in the first observed year), standard errors, connected parts and fit figures."""
    keep = y1 != y2
    y1, y2, n, s, ss = (x[keep] for x in (y1, y2, n.astype(float), s, ss))
    if n.sum() < least or not len(n):
        return None
    years = np.unique(np.r_[y1, y2])
    i, j = np.searchsorted(years, y1), np.searchsorted(years, y2)
    xx, xy = np.zeros((len(years), len(years))), np.zeros(len(years))
    for a, b, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
        np.add.at(xx, (a, b), sign * n)
    np.add.at(xy, j, s)
    np.add.at(xy, i, -s)
    # The smallest year spreads over each connected part until nothing changes.
    part, before = np.arange(len(years)), None
    while before is None or (part != before).any():
        before = part.copy()
        np.minimum.at(part, i, before[j])
        np.minimum.at(part, j, before[i])
    inverse = np.linalg.inv(xx[1:, 1:] + ridge * np.eye(len(years) - 1))
    delta = np.r_[0.0, inverse @ xy[1:]]
    count = n.sum()
    sse = max(0.0, float(ss.sum() - 2 * delta @ xy + delta @ xx @ delta))
    sst = float(ss.sum() - s.sum() ** 2 / count)
    free = count - (len(years) - 1)
    sigma = sse / free if free > 0 else np.nan
    error = np.r_[0.0, np.sqrt(np.maximum(0, sigma * np.diag(inverse)))]
    return {
        "years": years, "delta": delta, "error": error, "part": part, "n": int(count), "sse": sse, "rmse": float(np.sqrt(sse / count)),
        "r_squared": 1 - sse / sst if sst > 0 else np.nan, "residual_std": float(np.sqrt(sigma)),
    }


def _grouped(by: list[str], make, schema: str):
    types = ", ".join(schema.split(", "))

    def of(cells_: DataFrame) -> DataFrame:
        kinds = dict(cells_.dtypes)
        names = [*by, *(x.split()[0] for x in schema.split(", "))]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            fit = make(*(pdf[c].to_numpy() for c in ("year_1", "year_2", "n", "s", "ss")))
            out = pd.DataFrame(fit) if fit else pd.DataFrame(columns=names[len(by) :])
            for k, c in enumerate(by):
                out.insert(k, c, pdf[c].iloc[0] if len(out) else None)
            return out[names]

        return cells_.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), types]))

    return of


def coefficients(cells_: DataFrame, by: list[str], ridge: float = 1e-8, least: int = 10) -> DataFrame:
    """(by, year, delta, std_error, t_stat, part). An area is one group: its cells, years x years at most."""

    def make(*x):
        f = fit_cells(*x, ridge, least)
        if f is None:
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(f["error"] > 0, f["delta"] / f["error"], np.nan)
        return {"year": f["years"].astype("int32"), "delta": f["delta"], "std_error": f["error"], "t_stat": t, "part": f["part"].astype("int32")}

    return _grouped(by, make, "year int, delta double, std_error double, t_stat double, part int")(cells_)


def fit_statistics(cells_: DataFrame, by: list[str], ridge: float = 1e-8, least: int = 10) -> DataFrame:
    def make(*x):
        f = fit_cells(*x, ridge, least)
        return f and {"n_obs": [f["n"]], "n_years": [len(f["years"])], "sse": [f["sse"]], "rmse": [f["rmse"]], "r_squared": [f["r_squared"]], "residual_std": [f["residual_std"]]}

    return _grouped(by, make, "n_obs long, n_years int, sse double, rmse double, r_squared double, residual_std double")(cells_)


def residual_diagnostics(pairs: DataFrame, coefs: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute, least and largest residual: the only figures that need the pairs again."""
    d = coefs.select(*by, "year", "delta")
    a, b = (d.withColumnRenamed("year", f"year_{k}").withColumnRenamed("delta", f"d{k}") for k in (1, 2))
    own = pairs.withColumns({"year_1": F.year("sale_date_1"), "year_2": F.year("sale_date_2")}).join(a, [*by, "year_1"]).join(b, [*by, "year_2"])
    e = F.col("price_relative") - (F.col("d2") - F.col("d1"))
    return own.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.min(e).alias("min_residual"), F.max(e).alias("max_residual"))


def appreciation(coefs: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, appreciation): the step from the year before, where both years are observed and connected."""
    w = Window.partitionBy(*by).orderBy("year")
    before = lambda c: F.lag(c).over(w)
    own = coefs.withColumns({"y0": before("year"), "d0": before("delta"), "p0": before("part")})
    return own.where("y0 = year - 1 and p0 = part").select(*by, "year", (F.col("delta") - F.col("d0")).alias("appreciation"))


def index_levels(coefs: DataFrame, by: list[str], base_year: int, base: float = 100.0) -> DataFrame:
    """base x exp(delta - delta in the base year); without that year, from the first observed one."""
    w = Window.partitionBy(*by)
    at = F.coalesce(F.max(F.when(F.col("year") == base_year, F.col("delta"))).over(w), F.min_by("delta", "year").over(w))
    return coefs.select(*by, "year", (base * F.exp(F.col("delta") - at)).alias("index_value"))


def pooled_appreciation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, year, appreciation): the mean of pairs from the year before to this one, the two-period estimate."""
    y2 = F.year("sale_date_2")
    own = pairs.where(F.year("sale_date_1") == y2 - 1).groupBy(*by, y2.alias("year"))
    return own.agg(F.avg("price_relative").alias("appreciation"), F.count(F.lit(1)).alias("n"))
