"""Repeat-sales pairs and regression cells kept up to date from a stream of sales.

The sales of a bucket of properties are its keyed state, as compressed Arrow. A batch's sales are put among them by property and date (then tiebreak),
and only what changes goes out: pairs with ``sign`` 1 that have come about and pairs with ``sign`` -1 that a sale between their two sales has ended. Signed
sums of cells are additive, so cells of any number of batches, in any order of sales, equal those of one pass over all sales.

Late sales need no watermark: a property's sales are few and stay in the state. Sales of one day go by tiebreak; a repeated row is
a sale of its own, as in the batch operator. Sales without property or date are left out. Columns besides those of sales are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrace.config import Settings
from terrace.operators import pairs

#: Properties are kept by bucket of their hash, so that a group's fixed cost is shared and its state is a part in 4,096 of all sales. A stream keeps the number it began with.
BUCKETS = 4096
SALE = pa.schema([("property_id", pa.string()), ("day", pa.int64()), ("tie", pa.int64()), ("price", pa.float64()), ("tract", pa.string()), ("cbsa", pa.string()), ("distance", pa.float64())])
STATE = "sales binary"
CHANGE = "property_id string, census_tract string, cbsa_code string, distance_to_cbd double, day_1 long, day_2 long, sale_price_1 double, sale_price_2 double, sign int"


def _changed(owner: np.ndarray, day: np.ndarray, tie: np.ndarray, known: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Positions (first sales, second sales) of new and of ended pairs, after the sales at ``known`` and later are put among those before."""
    order = np.lexsort((tie, day, owner))  # stable: sales of one day and tiebreak stay as they came
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    a, b = order[:-1], order[1:]
    come = (owner[a] == owner[b]) & ((a >= known) | (b >= known))
    old = order[order < known]
    c, d = old[:-1], old[1:]
    ended = (owner[c] == owner[d]) & (place[d] - place[c] > 1)
    return (a[come], b[come]), (c[ended], d[ended])


def _adjacent(sales: list[tuple], known: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The same of one property's (day, tie, ...), as sorted positions."""
    day, tie = (np.array([x[i] for x in sales], "int64") for i in (0, 1))
    come, ended = (sorted(zip(a.tolist(), b.tolist(), strict=True)) for a, b in _changed(np.zeros(len(sales), "int64"), day, tie, known))
    return come, ended


def _kept(sales: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, SALE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(sales)
    return out.getvalue().to_pybytes()


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = [pa.ipc.open_stream(state.get[0]).read_all()] if state.exists else []
    known = sum(map(len, before))
    sales = pa.concat_tables([*before, *(pa.Table.from_pandas(pdf[SALE.names], SALE, preserve_index=False) for pdf in frames)]).combine_chunks()
    state.update((_kept(sales),))
    owner = sales["property_id"].combine_chunks().dictionary_encode().indices
    for (first, second), sign in zip(_changed(*(x.to_numpy() for x in (owner, sales["day"], sales["tie"])), known), (1, -1), strict=True):
        if len(first):
            a, b = sales.take(pa.array(first)), sales.take(pa.array(second))
            columns = [a["property_id"], a["tract"], a["cbsa"], a["distance"], a["day"], b["day"], a["price"], b["price"], pa.array(np.full(len(first), sign, "int32"))]
            yield pa.table(columns, names=[x.split()[0] for x in CHANGE.split(", ")]).to_pandas()


def pair_changes(sales: DataFrame, tiebreak: str = "tiebreak") -> DataFrame:
    """Signed pairs, with the columns of ``repeat_sales`` and ``sign``, from a stream of sales."""
    own = sales.where("property_id is not null and transaction_date is not null").select(
        F.col("property_id").cast("string").alias("property_id"), F.unix_date("transaction_date").cast("long").alias("day"), F.coalesce(F.col(tiebreak).cast("long"), F.lit(0)).alias("tie"),
        F.col("transaction_price").cast("double").alias("price"), F.col("census_tract").alias("tract"), F.col("cbsa_code").alias("cbsa"), F.col("distance_to_cbd").cast("double").alias("distance"),
    )
    found = own.withColumn("bucket", F.pmod(F.xxhash64("property_id"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(_changes, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)
    dated = found.withColumns({f"sale_date_{k}": F.date_from_unix_date(F.col(f"day_{k}").cast("int")) for k in (1, 2)})
    return pairs.with_growth(dated.drop("day_1", "day_2"))


def signed_cells(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, year_1, year_2, n, s, ss): what signed pairs add to cells."""
    p, sign = F.col("price_relative"), F.col("sign")
    own = changes.select(*by, F.year("sale_date_1").alias("year_1"), F.year("sale_date_2").alias("year_2"), p, sign)
    return own.groupBy(*by, "year_1", "year_2").agg(F.sum(sign).alias("n"), F.sum(sign * p).alias("s"), F.sum(sign * p * p).alias("ss"))


def merged_cells(changes: DataFrame, by: list[str]) -> DataFrame:
    """Cells from several tables of changes; a cell that all its pairs have left is gone."""
    return changes.groupBy(*by, "year_1", "year_2").agg(F.sum("n").cast("long").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).where("n > 0")


class CellStream:
    """Cells of a stream of sales below ``folder``: a table of changes for each batch, and the stream's checkpoint.

    A batch that is run again after a failure replaces its own table, so it never counts twice. ``folder`` is one that
    the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, by: tuple[str, ...] = ("cbsa_code",)):
        self.spark, self.folder, self.s, self.by = spark, folder.rstrip("/"), settings, list(by)

    def advance(self, sales: DataFrame, tiebreak: str = "tiebreak") -> int:
        """Take in all sales that have come since the last call; the number of batches so far."""

        def put(batch: DataFrame, number: int) -> None:
            signed_cells(batch, self.by).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={number}")

        changes = pairs.apply_filters(pair_changes(sales, tiebreak), self.s)
        stream = changes.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        stream.awaitTermination()
        return len(stream.recentProgress)

    def cells(self) -> DataFrame:
        """The cells of all sales taken in."""
        return merged_cells(self.spark.read.parquet(f"{self.folder}/changes"), self.by)
