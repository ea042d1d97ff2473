"""Data checks, index checks and comparisons of indices. Each check is a row; each table takes one aggregation."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.config import DataError


def _checks(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(check_name, violations, ok) of conditions that rows must not meet."""
    counts = df.groupBy(*(by or [])).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate(rules.values())))
    pairs = ", ".join(f"'{n}', c{i}" for i, n in enumerate(rules))
    return counts.selectExpr(*(by or []), f"stack({len(rules)}, {pairs}) as (check_name, violations)").withColumn("ok", F.col("violations") == 0)


def transaction_checks(tx: DataFrame, most: float = 1e8, first: str = "1975-01-01", last: str = "2021-12-31") -> DataFrame:
    needed = ("property_id", "transaction_date", "transaction_price", "census_tract", "cbsa_code")
    price = F.col("transaction_price")
    rules = {f"null_{c}": F.col(c).isNull() for c in needed}
    rules |= {"price_range": (price <= 0) | (price >= most), "date_range": ~F.col("transaction_date").between(first, last), "cbsa_format": ~F.col("cbsa_code").rlike("^[0-9]{5}$")}
    repeats = tx.groupBy("property_id", "transaction_date").agg((F.count(F.lit(1)) - 1).alias("more"))
    repeats = repeats.agg(F.coalesce(F.sum("more"), F.lit(0)).cast("long").alias("violations")).select(F.lit("repeated_property_date").alias("check_name"), "violations", (F.col("violations") == 0).alias("ok"))
    return _checks(tx, rules).unionByName(repeats)


def pair_checks(pairs: DataFrame) -> DataFrame:
    years = F.col("time_diff_years")
    return _checks(pairs, {
        "date_order": F.col("sale_date_2") <= F.col("sale_date_1"), "price_positive": (F.col("sale_price_1") <= 0) | (F.col("sale_price_2") <= 0),
        "gap_range": (years <= 0) | (years >= 50), "cagr_outlier": F.abs("cagr") > 0.5, "null_relative": F.col("price_relative").isNull(),
    })


def half_pair_checks(halves: DataFrame, least: int) -> DataFrame:
    """Rows below the threshold, their share, and approximate quartiles."""
    n = F.col("total_half_pairs")
    return halves.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(n < least).alias("below"), (100.0 * F.count_if(n < least) / F.expr("nullif(count(1), 0)")).alias("pct_below"),
        *(F.percentile_approx(n, p, 10000).alias(f"q{round(p * 100)}") for p in (0.25, 0.5, 0.75)),
    )


def geography_checks(tracts: DataFrame) -> DataFrame:
    out = lambda c, a, b: ~F.col(c).between(a, b)
    rules = {"latitude": out("centroid_lat", -90, 90), "longitude": out("centroid_lon", -180, 180), "college_share": out("college_share", 0, 1), "nonwhite_share": out("nonwhite_share", 0, 1)}
    repeats = tracts.groupBy("census_tract").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    return _checks(tracts, rules).unionByName(repeats.select(F.lit("unique_tract").alias("check_name"), "violations", (F.col("violations") == 0).alias("ok")))


def index_checks(levels: DataFrame, by: list[str], base: float = 100.0) -> DataFrame:
    """Nulls, signs, levels outside a tenth to ten times the base, and areas with fewer years than others."""
    x = F.col("index_value")
    own = _checks(levels, {"null_value": x.isNull(), "positive": x <= 0, "range": ~x.between(base / 10, base * 10)})
    counts = levels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    odd = counts.agg((F.max("n") != F.min("n")).cast("long").alias("violations"))
    return own.unionByName(odd.select(F.lit("balanced").alias("check_name"), F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), F.coalesce(F.col("violations") == 0, F.lit(True)).alias("ok")))


def index_health(index: DataFrame, schemes: int = 6, low: float = 50.0, high: float = 500.0) -> DataFrame:
    """One row of figures on a city index; ``ok`` if there are rows, none is negative or unusual, and all schemes are there."""
    x = F.col("index_value")
    own = index.agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.min("year").alias("first_year"),
        F.max("year").alias("last_year"), F.countDistinct("weight_type").alias("n_schemes"), F.count_if(x < 0).alias("negative"),
    )
    return own.withColumn("ok", F.coalesce((F.col("negative") == 0) & (F.col("n_schemes") >= schemes) & (F.col("least") >= low) & (F.col("most") <= high), F.lit(False)))


def data_health(transactions: DataFrame, pairs: DataFrame, cap: float = 1e8, growth: float = 0.5, share: float = 0.01) -> DataFrame:
    """(table_name, n, nulls, over, ok): nulls in needed columns and prices over ``cap`` of sales, nulls and yearly growth over ``growth`` of pairs.

    ``ok`` where there are rows, and no more than a ``share`` of them has either. One aggregation a table."""

    def of(df: DataFrame, name: str, needed: tuple[str, ...], over: Column) -> DataFrame:
        nulls = functools.reduce(Column.__or__, (F.col(c).isNull() for c in needed))
        own = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(nulls).alias("nulls"), F.count_if(F.coalesce(over, F.lit(False))).alias("over"))
        return own.select(F.lit(name).alias("table_name"), "*", ((F.col("n") > 0) & (F.col("nulls") <= share * F.col("n")) & (F.col("over") <= share * F.col("n"))).alias("ok"))

    sales = of(transactions, "transactions", ("property_id", "transaction_date", "transaction_price", "census_tract", "cbsa_code"), F.col("transaction_price") > cap)
    return sales.unionByName(of(pairs, "pairs", ("price_relative", "cagr"), F.abs("cagr") > growth))


def every_check(checks: dict[str, DataFrame]) -> DataFrame:
    """(table_name, check_name, violations, ok) of the checks of several tables."""
    named = [c.select(F.lit(name).alias("table_name"), "check_name", "violations", "ok") for name, c in checks.items()]
    return functools.reduce(DataFrame.unionByName, named)


def strict(checks: DataFrame) -> None:
    """Raise if a check fails; an action on a few rows."""
    if failed := [r.check_name for r in checks.where("not ok").collect()]:
        raise DataError(f"failed checks: {', '.join(sorted(failed))}")


def report(checks: DataFrame) -> str:
    """The checks as text."""
    return "\n".join(f"{'ok  ' if r.ok else 'FAIL'} {r.check_name}: {r.violations}" for r in checks.orderBy("check_name").collect())


def against_reference(own: DataFrame, other: DataFrame, on: list[str], tolerance: float = 0.001) -> DataFrame:
    """Largest, mean, median and 95th-percentile relative error over common keys."""
    both = own.select(*on, F.col("index_value").alias("x")).join(other.select(*on, F.col("index_value").alias("y")), on)
    e = F.abs(F.col("x") - F.col("y")) / F.abs(F.expr("nullif(y, 0)"))
    q = both.select(e.alias("e")).agg(
        F.count("e").alias("n"), F.max("e").alias("max_error"), F.avg("e").alias("mean_error"), F.percentile("e", F.lit(0.5)).alias("median_error"), F.percentile("e", F.lit(0.95)).alias("p95_error")
    )
    return q.withColumn("ok", (F.col("max_error") <= tolerance) & (F.col("mean_error") <= tolerance / 2))


def common_years(one: DataFrame, other: DataFrame) -> DataFrame:
    """Years that both panels have."""
    return one.select("year").intersect(other.select("year"))


def benchmark_metrics(own: DataFrame, other: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Correlation, rmse, largest deviation (all relative to the reference) and tracking error, with their tests."""
    both = own.select(*on, F.col("index_value").alias("x")).join(other.select(*on, F.col("index_value").alias("y")), on)
    d = (F.col("x") - F.col("y")) / F.expr("nullif(y, 0)")
    sums = both.groupBy(*by).agg(
        F.corr("x", "y").alias("correlation"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_deviation"), F.stddev_pop(d).alias("tracking_error")
    )
    return sums.withColumn("ok", F.coalesce((F.col("correlation") >= 0.95) & (F.col("rmse") <= 0.05) & (F.col("max_deviation") <= 0.10), F.lit(False)))


def deviation_matrix(levels: DataFrame, entity: str) -> DataFrame:
    """(entity_1, entity_2, deviation): mean of |a - b| / max(a, b) over common years. Meant for cities and schemes, hundreds of entities."""
    own = levels.select(F.col(entity).alias("id"), "year", F.col("index_value").alias("v"))
    a, b = own.alias("a"), own.alias("b")
    d = F.abs(F.col("a.v") - F.col("b.v")) / F.expr("nullif(greatest(a.v, b.v), 0)")
    met = a.join(b, F.expr("a.year = b.year and a.id < b.id"))
    return met.groupBy(F.col("a.id").alias("entity_1"), F.col("b.id").alias("entity_2")).agg(F.avg(d).alias("deviation"))


def returns(levels: DataFrame, by: list[str]) -> DataFrame:
    before = F.lag("index_value").over(Window.partitionBy(*by).orderBy("year"))
    return levels.withColumn("r", F.col("index_value") / before - 1).where("r is not null").select(*by, "year", "r")


def efficiency(levels: DataFrame, market: DataFrame, by: list[str], risk_free: float = 0.0) -> DataFrame:
    """Sharpe and information ratio, tracking error, beta, alpha, correlation and R squared against ``market`` (year, index_value).

    Beta is sample covariance over sample variance."""
    m = returns(market.withColumn("k", F.lit(1)), ["k"]).select("year", F.col("r").alias("m"))
    own = returns(levels, by).join(F.broadcast(m), "year")
    x = own.groupBy(*by).agg(
        F.avg("r").alias("mr"), F.avg("m").alias("mm"), F.stddev_samp("r").alias("sr"), F.covar_samp("r", "m").alias("c"), F.var_samp("m").alias("vm"),
        F.avg(F.col("r") - F.col("m")).alias("ma"), F.stddev_samp(F.col("r") - F.col("m")).alias("sa"), F.stddev_pop(F.col("r") - F.col("m")).alias("tracking_error"), F.corr("r", "m").alias("correlation"),
    )
    over = lambda a, b: a / F.when(F.abs(b) > 1e-12, b)
    beta = over(F.col("c"), F.col("vm"))
    return x.select(
        *by, over(F.col("mr") - risk_free, F.col("sr")).alias("sharpe"), over(F.col("ma"), F.col("sa")).alias("information"), "tracking_error", beta.alias("beta"),
        (F.col("mr") - risk_free - beta * (F.col("mm") - risk_free)).alias("alpha"), "correlation", (F.col("correlation") * F.col("correlation")).alias("r_squared"),
    )


def ljung_box(levels: DataFrame, by: list[str], lags: int = 2) -> DataFrame:
    """Q of the first ``lags`` autocorrelations of yearly returns."""
    w, o = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("year")
    r = returns(levels, by).withColumns({"d": F.col("r") - F.avg("r").over(w), "n": F.count(F.lit(1)).over(w)})
    for k in range(1, lags + 1):
        r = r.withColumn(f"l{k}", F.lag("d", k).over(o))
    rho = lambda k: F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)) / F.expr("nullif(sum(d * d), 0)")
    n = F.max("n")
    q = sum((rho(k) * rho(k) / F.when(n > k, n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return r.groupBy(*by).agg(n.alias("n"), (n * (n + 2) * q).alias("q"))


def cross_section(areas: DataFrame, tracts: DataFrame) -> DataFrame:
    """Variance of appreciation over areas in each year, and its slope by distance to the centre."""
    own = areas.join(tracts.select("census_tract", "distance_to_cbd"), "census_tract")
    return own.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.var_samp("appreciation").alias("variance"), F.regr_slope("appreciation", "distance_to_cbd").alias("gradient"))
