"""Weights, weighted appreciation, chained levels and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.config import SCHEMES, ConfigError


def normalised(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """``weight``: the share of ``raw`` in its group; equal shares where the group's sum is zero."""
    w = Window.partitionBy(*keys)
    total = F.sum(raw).over(w)
    return df.withColumn("weight", F.when(total > 0, F.coalesce(F.col(raw), F.lit(0.0)) / total).otherwise(1 / F.count(F.lit(1)).over(w)))


def weights(halves: DataFrame, measures: DataFrame, area: str = "census_tract", schemes: tuple[str, ...] = SCHEMES, mapping: DataFrame | None = None) -> DataFrame:
    """(cbsa_code, area, year, weight_type, weight) of all schemes in one pass.

    ``halves`` has a row for each tract and year; ``mapping`` (census_tract, cbsa_code, year, area) groups tracts."""
    if unknown := set(schemes) - set(SCHEMES):
        raise ConfigError(f"unknown weight schemes: {sorted(unknown)}")
    own = halves.select("census_tract", "cbsa_code", "year", "total_half_pairs").join(measures, ["census_tract", "cbsa_code", "year"], "left")
    own = own if mapping is None else own.join(mapping.select("census_tract", "cbsa_code", "year", area), ["census_tract", "cbsa_code", "year"])
    total = lambda e: F.sum(F.coalesce(F.expr(e).cast("double"), F.lit(0.0)))
    values = {
        "sample": "total_half_pairs", "value": "value_measure", "unit": "unit_measure", "upb": "upb_measure",
        "college": "unit_measure * college_share", "nonwhite": "unit_measure * nonwhite_share",
    }
    sums = own.groupBy("cbsa_code", area, "year").agg(*(total(values[k]).alias(k) for k in schemes))
    long = sums.unpivot(["cbsa_code", area, "year"], list(schemes), "weight_type", "raw")
    return normalised(long, ["cbsa_code", "year", "weight_type"]).select("cbsa_code", area, "year", "weight_type", "weight")


def weight_checks(weights_: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    sums = weights_.groupBy("cbsa_code", "year", "weight_type").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"))
    return sums.withColumn("ok", (F.abs(F.col("total") - 1) < tolerance) & (F.col("least") >= 0))


def combine_weights(weights_: DataFrame, meta: dict[str, float], area: str = "census_tract") -> DataFrame:
    """A scheme ``combined``: schemes weighted by ``meta``, normalised again."""
    factor = F.create_map(*(F.lit(x) for kv in meta.items() for x in kv))
    own = weights_.where(F.col("weight_type").isin(*meta)).groupBy("cbsa_code", area, "year").agg(F.sum(F.col("weight") * factor[F.col("weight_type")]).alias("raw"))
    return normalised(own, ["cbsa_code", "year"]).select("cbsa_code", area, "year", F.lit("combined").alias("weight_type"), "weight")


def city_appreciation(areas: DataFrame, weights_: DataFrame, area: str = "census_tract") -> DataFrame:
    """(cbsa_code, year, weight_type, appreciation, coverage): the mean over areas that have a value, and their weight."""
    own = areas.join(weights_, ["cbsa_code", area, "year"]).where("appreciation is not null")
    w = F.col("weight")
    return own.groupBy("cbsa_code", "year", "weight_type").agg(
        (F.sum(w * F.col("appreciation")) / F.expr("nullif(sum(weight), 0)")).alias("appreciation"), F.sum(w).alias("coverage")
    )


def city_index(
    appreciation: DataFrame, first: int, last: int, base_year: int, base: float = 100.0, cities: DataFrame | None = None, schemes: tuple[str, ...] = SCHEMES
) -> DataFrame:
    """(cbsa_code, weight_type, year, appreciation, index_value, yoy_change, is_default), a row for each year.

    Levels chain exp(sum of appreciations), a missing year keeps the level, and the base year is ``base``. There is a row
    for each of ``schemes`` and each cbsa_code of ``cities``, or where that is not given for those of ``appreciation``; one with no
    value at all stays at the base, and is a default."""
    keys = ["cbsa_code", "weight_type"]
    own_keys = appreciation.select(*keys) if cities is None else cities.select("cbsa_code").distinct().withColumn("weight_type", F.explode(F.array(*map(F.lit, schemes))))
    grid = own_keys.distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    own = grid.join(appreciation.select(*keys, "year", "appreciation"), [*keys, "year"], "left")
    every, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("year")
    step = F.when(F.col("year") > first, F.coalesce("appreciation", F.lit(0.0))).otherwise(0.0)
    own = own.withColumn("log", F.sum(step).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("at_base", F.max(F.when(F.col("year") == base_year, F.col("log"))).over(every)).withColumn("is_default", F.count("appreciation").over(every) == 0)
    own = own.withColumn("index_value", base * F.exp(F.col("log") - F.col("at_base")))
    return own.withColumn("yoy_change", F.col("index_value") / F.lag("index_value").over(so_far) - 1).select(*keys, "year", "appreciation", "index_value", "yoy_change", "is_default")


def tract_panel(levels: DataFrame, tracts: DataFrame, first: int, last: int, base_year: int, base: float = 100.0) -> DataFrame:
    """(census_tract, year, index_value, yoy_change): each tract's level carried forward, else the year's mean, else the
    base; then set to ``base`` in the base year where that year is not zero."""
    grid = tracts.select("census_tract").distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    own = grid.join(levels.select("census_tract", "year", "index_value"), ["census_tract", "year"], "left")
    w = Window.partitionBy("census_tract").orderBy("year")
    own = own.withColumn("index_value", F.last("index_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # A mean for each year, a few dozen rows, joined back: no window over a whole year's tracts.
    mean = own.groupBy("year").agg(F.avg("index_value").alias("year_mean"))
    own = own.join(F.broadcast(mean), "year").withColumn("index_value", F.coalesce("index_value", "year_mean", F.lit(base)))
    at = F.max(F.when(F.col("year") == base_year, F.col("index_value"))).over(Window.partitionBy("census_tract"))
    own = own.withColumn("index_value", base * F.col("index_value") / F.when(at != 0, at))
    return own.withColumn("yoy_change", F.col("index_value") / F.lag("index_value").over(w) - 1).select("census_tract", "year", "index_value", "yoy_change")


def panel_summary(panel: DataFrame) -> DataFrame:
    """Figures of a tract panel by year."""
    v = F.col("index_value")
    return panel.groupBy("year").agg(
        F.count(v).alias("n_tracts"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg("yoy_change").alias("mean_change")
    )


def balance_proxy(transactions: DataFrame, tracts: DataFrame, share: float = 0.8) -> DataFrame:
    """(census_tract, cbsa_code, year, upb_measure): unpaid balances taken as a share of the sales' value, for the tracts of a mapping."""
    own = transactions.join(tracts.select("census_tract").distinct(), "census_tract")
    return own.groupBy("census_tract", "cbsa_code", F.year("transaction_date").alias("year")).agg((F.sum("transaction_price") * share).alias("upb_measure"))


def index_changes(levels: DataFrame, by: list[str]) -> DataFrame:
    """Year-over-year change, log appreciation and compound growth since the first year."""
    w = Window.partitionBy(*by).orderBy("year")
    x, before, first = F.col("index_value"), F.lag("index_value").over(w), F.first("index_value").over(w)
    years = F.col("year") - F.first("year").over(w)
    return levels.select(
        *by, "year", (x / before - 1).alias("yoy_change"), (F.ln(x) - F.ln(before)).alias("log_appreciation"), (F.pow(x / first, F.when(years > 0, 1 / years)) - 1).alias("cagr")
    )


def chained(rates: DataFrame, by: list[str], base_year: int, base: float = 100.0) -> DataFrame:
    """Levels from growth rates (by, year, rate): forward by products, and backward by setting the base year."""
    w = Window.partitionBy(*by).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    own = rates.withColumn("log", F.sum(F.log1p("rate")).over(w))
    at = F.max(F.when(F.col("year") == base_year, F.col("log"))).over(Window.partitionBy(*by))
    return own.select(*by, "year", (base * F.exp(F.col("log") - F.coalesce(at, F.lit(0.0)))).alias("index_value"))


def volatility(levels: DataFrame, by: list[str], window: int = 3) -> DataFrame:
    """Rolling and expanding deviation of yearly returns; rolling is null until it has ``window`` of them."""
    w = Window.partitionBy(*by).orderBy("year")
    own = levels.withColumn("r", F.col("index_value") / F.lag("index_value").over(w) - 1).where("r is not null")
    rolling = w.rowsBetween(-(window - 1), 0)
    every = w.rowsBetween(Window.unboundedPreceding, 0)
    return own.select(*by, "year", F.when(F.count("r").over(rolling) == window, F.stddev_samp("r").over(rolling)).alias("rolling"), F.stddev_samp("r").over(every).alias("expanding"))


def merge_indices(levels: DataFrame, by: list[str], entity: str, shares: DataFrame) -> DataFrame:
    """Levels of several entities merged by ``shares`` (entity, share), over the entities present in a year."""
    own = levels.join(shares, entity)
    return own.groupBy(*by, "year").agg((F.sum(F.col("index_value") * F.col("share")) / F.expr("nullif(sum(share), 0)")).alias("index_value"))


def index_difference(appreciation: DataFrame, one: str, other: str) -> DataFrame:
    """The difference of two schemes' appreciation by city and year."""
    pick = lambda k, name: appreciation.where(F.col("weight_type") == k).select("cbsa_code", "year", F.col("appreciation").alias(name))
    both = pick(one, "a").join(pick(other, "b"), ["cbsa_code", "year"])
    return both.select("cbsa_code", "year", (F.col("a") - F.col("b")).alias("difference"))


def city_summary(index: DataFrame) -> DataFrame:
    """Total appreciation, mean growth, volatility and the extreme years of each city and scheme."""
    keys = ["cbsa_code", "weight_type"]
    x = F.col("yoy_change")
    return index.groupBy(*keys).agg(
        (F.max_by("index_value", "year") / F.min_by("index_value", "year") - 1).alias("total"), F.avg(x).alias("mean_growth"), F.stddev_samp(x).alias("volatility"),
        F.max(x).alias("best"), F.min(x).alias("worst"),
    )
