"""Distances, neighbours, proximity groups and supertracts."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.scalars import RADIUS, haversine
from terrace.operators import nearby

SUPERTRACT = "cbsa_code string, year int, supertract_id string, census_tract string, n_tracts int, min_half_pairs long, below_threshold boolean"


def distance_matrix(tracts: DataFrame, unit: str = "km") -> DataFrame:
    """(cbsa_code, tract_1, tract_2, distance) of tracts of one CBSA, tract_1 < tract_2. A CBSA has hundreds of tracts."""
    own = tracts.select("cbsa_code", "census_tract", "centroid_lat", "centroid_lon")
    a, b = own.alias("a"), own.alias("b")
    d = haversine(*(F.col(f"{t}.centroid_{c}") for t in "ab" for c in ("lat", "lon")), unit)
    met = a.join(b, F.expr("a.cbsa_code = b.cbsa_code and a.census_tract < b.census_tract"))
    return met.select("a.cbsa_code", F.col("a.census_tract").alias("tract_1"), F.col("b.census_tract").alias("tract_2"), d.alias("distance"))


def _both_ways(distances: DataFrame) -> DataFrame:
    return distances.unionByName(distances.select("cbsa_code", F.col("tract_2").alias("tract_1"), F.col("tract_1").alias("tract_2"), "distance"))


def nearest_neighbors(tracts: DataFrame, k: int = 5, most: float | None = None, unit: str = "km", same_cbsa: bool = True) -> DataFrame:
    """The k nearest tracts of the same CBSA, with ties to the smaller id; of all CBSAs by a grid with ``same_cbsa=False``."""
    if not same_cbsa:
        found = nearby.nearest(tracts, k, unit=unit).select(F.col("id_1").alias("tract_1"), "rank", F.col("id_2").alias("tract_2"), "distance")
        return found if most is None else found.where(F.col("distance") <= most)
    d = _both_ways(distance_matrix(tracts, unit))
    d = d if most is None else d.where(F.col("distance") <= most)
    rank = F.row_number().over(Window.partitionBy("tract_1").orderBy("distance", "tract_2"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select("tract_1", "rank", "tract_2", "distance")


def within_radius(tracts: DataFrame, radius: float, unit: str = "km", same_cbsa: bool = True) -> DataFrame:
    """(tract_1, tract_2, distance) of tracts of one CBSA; of all by a grid with ``same_cbsa=False``."""
    if not same_cbsa:
        return nearby.within(tracts, radius, unit=unit).select(F.col("id_1").alias("tract_1"), F.col("id_2").alias("tract_2"), "distance")
    return _both_ways(distance_matrix(tracts, unit)).where(F.col("distance") <= radius).select("tract_1", "tract_2", "distance")


def geographic_weights(tracts: DataFrame, kind: str = "inverse", unit: str = "km") -> DataFrame:
    """Each tract's share in its CBSA: 1 / (distance to the CBSA's centre + 0.1), or uniform."""
    w = Window.partitionBy("cbsa_code")
    d = haversine(F.col("centroid_lat"), F.col("centroid_lon"), F.avg("centroid_lat").over(w), F.avg("centroid_lon").over(w), unit)
    raw = 1 / (d + 0.1) if kind == "inverse" else F.lit(1.0)
    own = tracts.select("cbsa_code", "census_tract", raw.alias("raw"))
    return own.select("cbsa_code", "census_tract", (F.col("raw") / F.sum("raw").over(w)).alias("weight"))


def _roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _haversine(lat1, lon1, lat2, lon2, unit: str) -> np.ndarray:
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS[unit] * np.arcsin(np.sqrt(np.minimum(1, h)))


def proximity_groups(tracts: DataFrame, radius: float, unit: str = "km") -> DataFrame:
    """Single-linkage clusters inside each CBSA; a group's id is its smallest tract."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("census_tract").reset_index(drop=True)
        lat, lon = pdf["centroid_lat"].to_numpy(), pdf["centroid_lon"].to_numpy()
        links = [(i, i + 1 + j) for i in range(len(pdf)) for j in np.flatnonzero(_haversine(lat[i], lon[i], lat[i + 1 :], lon[i + 1 :], unit) <= radius)]
        return pd.DataFrame({"cbsa_code": pdf["cbsa_code"], "census_tract": pdf["census_tract"], "group_id": pdf["census_tract"].to_numpy()[_roots(len(pdf), links)]})

    own = tracts.select("cbsa_code", "census_tract", "centroid_lat", "centroid_lon")
    return own.groupBy("cbsa_code").applyInPandas(run, "cbsa_code string, census_tract string, group_id string")


def pair_scores(tracts: DataFrame, grid: DataFrame, unit: str = "km") -> DataFrame:
    """(cbsa_code, tract_1, tract_2, total_half_pairs, score): how well two tracts of a CBSA go together, by their half-pairs over one more than their distance."""
    n = grid.groupBy("census_tract").agg(F.sum("total_half_pairs").alias("n"))
    one, two = (n.select(F.col("census_tract").alias(f"tract_{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    own = distance_matrix(tracts, unit).join(one, "tract_1").join(two, "tract_2").withColumn("total_half_pairs", F.col("n1") + F.col("n2"))
    return own.select("cbsa_code", "tract_1", "tract_2", "total_half_pairs", (F.col("total_half_pairs") / (1 + F.col("distance"))).alias("score"))


def merge_tracts(pdf: pd.DataFrame, least: int, unit: str = "km") -> pd.DataFrame:
    """Supertracts of one CBSA and year.

    The sparsest supertract (then the smallest id) below ``least`` joins the nearest other (then the smallest id); a
    merged one has its smallest tract's id, summed half-pairs of both years, and the mean of its tracts' centroids.
    Of several rows of a tract the last counts."""
    pdf = pdf.sort_values("census_tract", kind="stable").drop_duplicates("census_tract", keep="last")
    ids = pdf["census_tract"].tolist()
    now, before = (pdf[c].to_numpy(np.int64, copy=True) for c in ("now", "before"))
    lat, lon = (pdf[c].to_numpy(float, copy=True) for c in ("centroid_lat", "centroid_lon"))
    # An area is at the position of its smallest tract, as ids are in order.
    tracts, alive = [[i] for i in range(len(ids))], np.ones(len(ids), bool)
    fewest = lambda i: int(min(now[i], before[i]))
    heap = [(fewest(i), i) for i in range(len(ids)) if fewest(i) < least]
    heapq.heapify(heap)
    left = len(ids)
    while heap and left > 1:
        sparse, own = heapq.heappop(heap)
        if not alive[own] or sparse != fewest(own):
            continue  # of an area that has merged since
        d = np.round(_haversine(lat[own], lon[own], lat, lon, unit), 9)
        d[~alive] = d[own] = np.inf
        other = int(np.argmin(d))
        n, m = len(tracts[own]), len(tracts[other])
        kept, gone = min(own, other), max(own, other)
        for x in (lat, lon):
            x[kept] = (x[own] * n + x[other] * m) / (n + m)
        for x in (now, before):
            x[kept] = x[own] + x[other]
        tracts[kept] = tracts[own] + tracts[other]
        alive[gone], left = False, left - 1
        if fewest(kept) < least:
            heapq.heappush(heap, (fewest(kept), kept))
    year, cbsa = pdf["year"].iloc[0], pdf["cbsa_code"].iloc[0]
    rows = [(cbsa, year, ids[k], ids[t], len(tracts[k]), fewest(k), fewest(k) < least) for k in np.flatnonzero(alive) for t in sorted(tracts[k])]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SUPERTRACT.split(", ")])


def supertracts(grid: DataFrame, tracts: DataFrame, least: int = 40, unit: str = "km") -> DataFrame:
    """(cbsa_code, year, supertract_id, census_tract, ...): every tract of every year in one supertract of its CBSA.

    All CBSAs and years are groups of one job; a group is the tracts of one CBSA."""
    before = F.lag("total_half_pairs").over(Window.partitionBy("census_tract", "cbsa_code").orderBy("year"))
    own = grid.withColumn("before", before).where("before is not null").withColumnRenamed("total_half_pairs", "now")
    places = tracts.select("census_tract", "cbsa_code", "centroid_lat", "centroid_lon")
    return own.join(places, ["census_tract", "cbsa_code"]).groupBy("cbsa_code", "year").applyInPandas(lambda pdf: merge_tracts(pdf, least, unit), SUPERTRACT)


def supertract_list(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("cbsa_code", "year", "supertract_id").agg(F.array_sort(F.collect_list("census_tract")).alias("tract_list"), F.first("min_half_pairs").alias("min_half_pairs"))


def supertract_statistics(mapping: DataFrame, halves: DataFrame) -> DataFrame:
    n = F.col("total_half_pairs")
    own = mapping.join(halves, ["census_tract", "cbsa_code", "year"], "left")
    return own.groupBy("cbsa_code", "year", "supertract_id").agg(
        F.count(F.lit(1)).alias("n_tracts"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_half_pairs"), F.avg(F.coalesce(n, F.lit(0))).alias("mean_half_pairs")
    )


def aggregate_measures(measures: DataFrame, mapping: DataFrame | None = None, by: tuple[str, ...] = ("cbsa_code", "year")) -> DataFrame:
    """Measures of merged areas: sums of values, units and balances, and shares averaged by units.

    ``mapping`` (that of ``supertracts``) adds its columns, to group ``by`` supertract_id. A null share doesn't count; where no
    unit has one, shares are averaged over tracts."""
    own = measures if mapping is None else measures.join(mapping.select("census_tract", "cbsa_code", "year", "supertract_id"), ["census_tract", "cbsa_code", "year"])
    units = F.col("unit_measure")
    share = lambda c: F.coalesce(F.sum(F.col(c) * units) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), units)), F.lit(0.0)), F.avg(c)).alias(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    return own.groupBy(*by).agg(*map(total, ("value_measure", "unit_measure", "upb_measure")), *map(share, ("college_share", "nonwhite_share")))
