"""Connected components of a link table by alternating large-star and small-star rounds.

Links and labels stay distributed; the driver sees one count a round. Each round is written to the shared
folder, so lost executors never replay earlier rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.shared import written


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest node around it."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # b > a: link b to m. Joined on a, where a hot node's many rows are one side that may be split.
    return both.where("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, are linked to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b"), F.col("m").alias("a"))
    kept = least.select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(kept).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b: long), the smallest node reachable.

    Self-links and repeated links count once; rows with a null end are left out; an empty table gives an
    empty result."""
    e = links.where("a != b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
    e = written(e, "links")
    size = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(20,0)"))).first()
    before = size(e)
    while before[0]:
        e = written(_small_star(_large_star(e)), "links")
        after = size(e)
        if after == before:
            break
        before = after
    # All links are now (smallest, member).
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
