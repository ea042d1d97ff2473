"""Shortest-pack-first packing over the length histogram.

1. ``pieces``: each document's ids (with the end id) are cut into full pieces of ``size`` and a rest; rests are
   never cut again. Each row is a piece's place, length and CRC-32, no ids.
2. ``pack_histogram``: on the histogram of piece lengths (``size`` rows at most) lengths are placed longest
   first, each into the shortest pack type with room, all packs of one type at once; a type is a pattern of
   lengths and its count. ``depth`` would bound pieces to a pack; there is no bound.
3. ``assign``: patterns give each (length, rank) a sequence and an offset; documents find theirs by their rank
   within their length. Ranks come from counts by (length, bucket) with a running sum over buckets, so that one
   length shared by a third of all rows is still ranked in many tasks.

Total padding is that of the last packs of each length only: a piece goes to an emptier pack whenever it fits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.shared import table, written
from terrace.llm.word_ids import default_path, encoder, slices

SIZE = 2048
END_ID = 1
BUCKETS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): one row for each piece; null text is empty and has the end id only."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, edges = own.encode(b.column(1).slice(lo, hi - lo))
                # The end id of each document goes in after its last id.
                ids = np.insert(ids, edges[1:], end_id).astype("<u4")
                edges = edges + np.arange(len(edges))
                tokens = np.diff(edges)
                count = -(-tokens // size)
                row = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
                length = np.minimum(size, tokens[row] - start)
                at = edges[:-1][row] + start
                crc = np.fromiter((zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                names = [x.split()[0] for x in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + row)), *map(pa.array, (start, length, crc, tokens[row]))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, count): pack types for ``counts`` pieces of each length; a pattern's lengths are in offset order.

    A type that can take no further piece of the lengths to come stays as it is. Work follows the number of
    types, not of pieces."""
    levels: list[int] = []  # pack lengths in use, ascending
    types: dict[int, dict[tuple[int, ...], int]] = {}

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if total not in types:
            insort(levels, total)
            types[total] = {}
        types[total][pattern] = types[total].get(pattern, 0) + n

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            if not levels or levels[0] + length > size:
                put(length, (length,), left)
                break
            total = levels[0]
            # A pack may take the length several times over; shortest first means one at a time.
            pattern, n = next(iter(types[total].items()))
            used = min(n, left)
            if used == n:
                del types[total][pattern]
                if not types[total]:
                    del types[total]
                    levels.pop(bisect_left(levels, total))
            else:
                types[total][pattern] = n - used
            put(total + length, (*pattern, length), used)
            left -= used
    return [(p, n) for total in levels for p, n in types[total].items()]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) by rank: ranks up to the next row's first rank
    lie at that offset of consecutive sequences."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in packs:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in found.items()}


def ranked(own: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``own`` with ``rank``: from 0 without gaps within each length."""
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = own.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = own.withColumn("inside", F.row_number().over(inside) - 1)
    return numbered.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "base", "inside")


def assign(own: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """``own`` (a written table of pieces) with sequence_id and offset; only the histogram reaches the driver."""
    counts = {r[0]: r[1] for r in own.groupBy("length").count().collect()}
    places = slots(pack_histogram(counts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                table_ = places[int(length[rows[0]])]
                at = np.searchsorted(table_[:, 0], rank[rows], side="right") - 1
                sequence[rows] = table_[at, 1] + rank[rows] - table_[at, 0]
                offset[rows] = table_[at, 2]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked(own, buckets).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Repeated rows and null ids are packed like others; an empty table gives an empty result; other columns are
    ignored. Very long texts make many pieces."""
    return assign(written(pieces(docs, path, size, end_id), "pieces"), size)


def op7_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
