"""Tables of mergeable sketches: quartiles and distinct properties of any grouping from one pass over pairs.

A row of the stored table holds, for the finest grouping, counts and sums, a quantile sketch of price relatives (KLL) and a
distinct count sketch of properties (HLL). Rows of any coarser grouping are merged from it: sketches are a few kilobytes
(32 for many properties) whatever they stand for, and merging is an ordinary aggregation with partial results, so global figures never hold all
values in one task.

A KLL sketch of size ``k`` (200 by default) gives a value whose rank is off by ``rank_error(k)`` of the rows at 99 % confidence, and exact
values where fewer rows than k went in; an HLL count of ``lg`` (12) bits is off by ``distinct_error(lg)``, relative. Merged sketches deviate by
1.04 / sqrt(2 ** bits), and a table has many groups, so a sketch holds ``SPARE`` bits more: the bound is then over six deviations.
Null price relatives and properties don't count in their sketches; groups of nulls alone have null quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, BITS = 200, 12
#: Bits of a sketch beyond those of its bound; Spark's sketches have 21 at most.
SPARE, MOST = 4, 21
FIGURES = ("n_pairs", "n_properties", "mean", "std", "min", "p25", "median", "p75", "max")


def rank_error(k: int = SIZE) -> float:
    """Published bound of a KLL sketch's rank error for single quantiles, as a share of rows."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = BITS) -> float:
    """Bound of a distinct count's relative error: two deviations of a sketch of ``lg`` bits that was never merged, over six of what ``sketched`` stores."""
    return 2 * 0.8326 / (1 << lg) ** 0.5


def sketched(pairs: DataFrame, by: list[str], k: int = SIZE, lg: int = BITS) -> DataFrame:
    """(by, n_pairs, n, s, ss, low, high, quantiles, properties) of ``pairs``, to be stored."""
    p = F.col("price_relative")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count(p).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss"), F.min(p).alias("low"), F.max(p).alias("high"),
        F.kll_sketch_agg_double(p, F.lit(k)).alias("quantiles"), F.hll_sketch_agg("property_id", F.lit(min(lg + SPARE, MOST))).alias("properties"),
    )


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """The same table for a coarser grouping (none: one row)."""
    own = table.groupBy(*by) if by else table.groupBy()
    return own.agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("properties").alias("properties"),
    )


def figures(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, *FIGURES): what a grouping's sketches say."""
    q = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    variance = F.when(F.col("n") > 1, (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    return table.select(
        *by, F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"), F.hll_sketch_estimate("properties").alias("n_properties"), (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("mean"), F.when(variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std"),
        F.col("low").alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.col("high").alias("max"),
    )
