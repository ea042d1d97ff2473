"""Nearest neighbours by collision counting (query-aware hashing with virtual rehashing).

Each of ``m`` random lines is one hash function: vectors are projected on it and sorted. Around a query's own
projection a window is opened on every line; a vector collides with the query once for each window it lies in.
Vectors with ``threshold`` collisions or more are candidates and their distances are computed exactly. If fewer
than k candidates lie within the radius that the window stands for (its half width over ``slack``), all windows grow by the factor ``c``
(virtual rehashing: the sorted arrays stay) and only the newly covered stretches are counted.

The rows are dealt to blocks of about ``block_rows``, the queries to sets of at most about ``query_rows``; each block
meets each set in one unit of work with bounded memory, which yields k rows for each query. A last top-k merges them. No
candidate is capped: a window over many equal vectors verifies all of them. The work is queries times rows, in blocks:
between vectors without structure, whose tenth neighbour is nearly as far as any other, windows of no line rule out a block.

Vectors are projected after scaling by a power of two, which keeps huge components finite; distances are of the original ones.

Stopping in every block by itself finds more than one search over all rows would: a block's windows grow until k
vectors of that block are within the radius. Recall against brute force is measured in tests (0.9 at least).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import table, written

LINES, THRESHOLD, GROWTH, SLACK = 48, 0.68, 1.25, 1.2
BLOCK_ROWS, QUERY_ROWS = 32768, 4096
SEED = 20
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dims): rows whose vector is not null, not zero and wholly finite, and whose id is not null."""
    v = F.col(vector_col).cast("array<double>")
    # NaN is the largest double in comparisons.
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dims")
    )


def lines(dims: int, m: int, seed: int) -> np.ndarray:
    """m random directions; the same on every machine."""
    return np.random.default_rng([seed, dims]).standard_normal((dims, m))


def distance(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares overflow or vanish."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        away = vectors - q
        d = np.sqrt((away**2).sum(axis=1))
        odd = np.flatnonzero(~((d > 1e-140) & (d < 1e140)))
        if len(odd):
            largest = np.abs(away[odd]).max(axis=1)
            some = (largest > 0) & np.isfinite(largest)
            m = np.where(some, largest, 1.0)
            d[odd] = np.where(some, m * np.sqrt(((away[odd] / m[:, None]) ** 2).sum(axis=1)), largest)
    return d


class SortedLines:
    """One block's sorted projections; ``scale`` is a power of two."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int, scale: float = 1.0):
        self.ids, self.vectors, self.scale = ids, vectors, scale
        projected = (vectors * scale) @ lines(vectors.shape[1], m, seed)
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, self.order.T, axis=0).T)

    def search(self, query_id: int, q: np.ndarray, on_lines: np.ndarray, k: int, threshold: int, growth: float, slack: float, half: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of verified vectors, the k nearest ids with ties to smaller ones; ``half`` is the first window's half width."""
        n, m = len(self.ids), len(on_lines)
        counts = np.zeros(n, np.uint16)
        lo = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, on_lines, strict=True)])
        hi = lo.copy()
        seen = self.ids == query_id  # never its own neighbour
        rivals = n - int(seen.sum())
        ids, distances = np.empty(0, np.int64), np.empty(0)
        while rivals:
            for i in range(m):
                s, order = self.sorted[i], self.order[i]
                a, b = np.searchsorted(s, on_lines[i] - half), np.searchsorted(s, on_lines[i] + half, side="right")
                counts[order[a : lo[i]]] += 1
                counts[order[hi[i] : b]] += 1
                lo[i], hi[i] = min(a, lo[i]), max(b, hi[i])
            new = np.flatnonzero((counts >= threshold) & ~seen)
            if len(new):
                seen[new] = True
                rivals -= len(new)
                ids, distances = np.concatenate([ids, self.ids[new]]), np.concatenate([distances, distance(self.vectors[new], q)])
                best = np.lexsort((ids, distances))
                # Several rows of one id are one neighbour, at the smallest of their distances.
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])[:k]]
                ids, distances = ids[best], distances[best]
            # A vector at distance r has projections about r from the query's (standard normal directions).
            if len(ids) == k and distances[-1] * self.scale * slack <= half:
                break
            half *= growth
        return ids, distances


def block_search(k: int, m: int, threshold: float, growth: float, slack: float, seed: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dims = int(left["dims"].iloc[0])
            vectors, queries = np.stack(right["v"].to_numpy()), np.stack(left["v"].to_numpy())
            largest = max(float(np.abs(x).max()) for x in (vectors, queries))
            scale = 2.0 ** -min(1000, max(-1000, int(np.frexp(largest)[1])))
            block = SortedLines(right["vec_id"].to_numpy(), vectors, m, seed, scale)
            on_lines = (queries * scale) @ lines(dims, m, seed)
            # First windows of about a fiftieth of the block's spread.
            half = max(float(np.median(block.sorted[:, -1] - block.sorted[:, 0])) / 50, 1e-12)
            for query_id, q, p in zip(left["vec_id"].to_numpy(), queries, on_lines, strict=True):
                ids, distances = block.search(query_id, q, p, k, int(np.ceil(threshold * m)), growth, slack, half)
                out["query_id"].append(np.full(len(ids), query_id)), out["vec_id"].append(ids), out["score"].append(distances)
        return pd.DataFrame({n: np.concatenate(x) if x else [] for n, x in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 10, m: int = LINES, threshold: float = THRESHOLD, growth: float = GROWTH, slack: float = SLACK,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of ``vectors`` to each of ``queries`` (both as ``usable`` gives them).

    Vectors of other lengths than a query's take no part in its search. Fewer candidates than k give fewer rows;
    no usable query or vector gives an empty result. Rows with the query's id are never its neighbours. An id is one
    neighbour, at the smallest distance between any of its rows and any of the query's. Equal distances rank by id.
    A distance beyond the largest double is infinite."""
    spark = vectors.sparkSession
    numbered = lambda x: x.withColumn("row", F.monotonically_increasing_id())  # noqa: E731  made once, and written: repeated rows are dealt apart
    rows, asked = written(numbered(vectors), "vectors"), written(numbered(queries), "queries")
    count = lambda x: {r[0]: r[1] for r in x.groupBy("dims").count().collect()}  # noqa: E731  a row for each vector length
    n_rows, n_asked = count(rows), count(asked)
    blocks = {d: -(-n // block_rows) for d, n in n_rows.items()}
    # Few blocks meet more sets, so that all cores have work.
    least = 2 * spark.sparkContext.defaultParallelism
    sets = {d: min(n_asked[d], max(-(-n_asked[d] // query_rows), -(-least // blocks[d]))) for d in blocks if d in n_asked}
    sizes = spark.createDataFrame([(d, blocks[d], sets[d]) for d in sets], "dims int, n_blocks int, n_sets int")
    deal = lambda n, s: F.pmod(F.xxhash64("row", F.lit(s)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.join(F.broadcast(sizes), "dims").select("dims", deal("n_blocks", 1).alias("block"), every("n_sets").alias("set"), "vec_id", "v")
    left = asked.join(F.broadcast(sizes), "dims").select("dims", every("n_blocks").alias("block"), deal("n_sets", 2).alias("set"), "vec_id", "v")
    keys = ("dims", "block", "set")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_search(k, m, threshold, growth, slack, seed), FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_collision_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)
