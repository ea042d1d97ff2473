"""The regression for many short periods: preconditioned conjugate gradients on cells, as joins and sums.

A year's dummies make a dense system of a few dozen unknowns; months or days make thousands, whose inverse no task should
hold. The matrix is the Laplacian of the graph of periods, and cells are its edges: multiplying it by a vector takes one
join of edges with the vector and one sum by period. All areas go through the steps together, scaled by their diagonals; the
vectors of a step are a table in the shared folder, so that a lost executor repeats one step. Steps end where every
area's residual is under ``tolerance`` of its right side, or at ``most`` steps; both figures are returned.

Periods that no pairs connect to an area's first are determined by the ridge alone, as in the dense fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.sources.tables import shared_folder

PERIODS = ("year", "quarter", "month", "day")


def period(date: str, kind: str) -> Column:
    """A running number of the year, quarter, month or day of ``date``."""
    if kind not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    year = F.year(date)
    return {"year": year, "quarter": year * 4 + F.quarter(date) - 1, "month": year * 12 + F.month(date) - 1, "day": F.unix_date(date)}[kind].cast("int")


def period_cells(pairs: DataFrame, by: list[str], kind: str = "month") -> DataFrame:
    """(by, period_1, period_2, n, s): counts and sums of price relatives of pairs between two periods. Pairs within one period say nothing."""
    own = pairs.select(*by, period("sale_date_1", kind).alias("period_1"), period("sale_date_2", kind).alias("period_2"), "price_relative")
    own = own.where("period_1 != period_2 and price_relative is not null")
    return own.groupBy(*by, "period_1", "period_2").agg(F.count(F.lit(1)).alias("n"), F.sum("price_relative").alias("s"))


def _kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def coefficients(cells: DataFrame, by: list[str], ridge: float = 1e-8, least: int = 10, tolerance: float = 1e-11, most: int = 500) -> DataFrame:
    """(by, period, delta, steps, residual): each area's coefficients, 0 in its first period, with the number of steps and its relative residual.

    Areas under ``least`` observations have no rows. ``most`` bounds the steps; a residual above ``tolerance`` tells that it did."""
    spark = cells.sparkSession
    folder = shared_folder(spark, "gradients")
    area, w = [F.col(c) for c in by], Window.partitionBy(*by)
    enough = cells.groupBy(*by).agg(F.sum("n").alias("__n")).where(F.col("__n") >= least).select(*by)
    ends = cells.join(enough, by).select(*by, F.inline(F.array(
        F.struct(F.col("period_1").alias("period"), F.col("period_2").alias("other"), "n", (-F.col("s")).alias("s")), F.struct(F.col("period_2").alias("period"), F.col("period_1").alias("other"), "n", "s")
    )))
    edges = _kept(ends.groupBy(*by, "period", "other").agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s")), folder, "edges")
    nodes = edges.groupBy(*by, "period").agg((F.sum("n") + ridge).alias("d"), F.sum("s").alias("b"))
    # An area's first period is the base: its unknown is zero and has no row.
    numbered = nodes.withColumn("first", F.min("period").over(w))
    bases = _kept(numbered.where("period = first").select(*by, "period"), folder, "bases")
    inner = numbered.where("period != first").drop("first")
    begun = inner.select(*area, "period", "d", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p"))
    rz, rr = F.sum(F.col("r") * F.col("r") / F.col("d")).over(w), F.sum(F.col("r") * F.col("r")).over(w)
    state = _kept(begun.withColumns({"rz": rz, "rr": rr, "bb": rr}), folder, "step-0")
    step = 0
    left = lambda df: df.agg(F.max(F.when(F.col("bb") > 0, F.sqrt(F.col("rr") / F.col("bb"))).otherwise(0.0))).first()[0] or 0.0
    while step < most and left(state) > tolerance:
        step += 1
        there = state.select(*by, F.col("period").alias("other"), F.col("p").alias("po"))
        pulled = edges.join(there, [*by, "other"]).groupBy(*by, "period").agg(F.sum(F.col("n") * F.col("po")).alias("pull"))
        own = state.join(pulled, [*by, "period"], "left").withColumn("ap", F.col("d") * F.col("p") - F.coalesce("pull", F.lit(0.0)))
        # An area that has converged stays as it is.
        more = F.col("rr") > F.col("bb") * tolerance * tolerance
        own = own.withColumn("alpha", F.when(more, F.col("rz") / F.sum(F.col("p") * F.col("ap")).over(w)).otherwise(0.0))
        own = own.withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("ap")})
        own = own.withColumns({"next": rz, "rr": rr})
        beta = F.when(F.col("rz") > 0, F.col("next") / F.col("rz")).otherwise(0.0)
        own = own.withColumn("p", F.when(F.col("alpha") != 0, F.col("r") / F.col("d") + beta * F.col("p")).otherwise(F.col("p")))
        state = _kept(own.select(*by, "period", "d", "x", "r", "p", F.col("next").alias("rz"), "rr", "bb"), folder, f"step-{step}")
    residual = F.when(F.col("bb") > 0, F.sqrt(F.col("rr") / F.col("bb"))).otherwise(0.0)
    solved = state.select(*by, "period", F.col("x").alias("delta"), F.lit(step).alias("steps"), residual.alias("residual"))
    anchors = bases.join(solved.groupBy(*by).agg(F.max("residual").alias("residual")), by, "left").select(
        *by, "period", F.lit(0.0).alias("delta"), F.lit(step).alias("steps"), F.coalesce("residual", F.lit(0.0)).alias("residual")
    )
    return solved.unionByName(anchors)
