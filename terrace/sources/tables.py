"""Schemas, readers, writers, stage outputs, and the housing view of the driver's tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terrace.config import DataError, Settings
from terrace.sources import arrow_source, validated


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


TRANSACTIONS = _schema("property_id string, transaction_date date, transaction_price double, census_tract string, cbsa_code string, distance_to_cbd double")
GEOGRAPHY = _schema("census_tract string, cbsa_code string, centroid_lat double, centroid_lon double, distance_to_cbd double")
MEASURES = _schema(
    "census_tract string, cbsa_code string, year int, value_measure double, unit_measure double, upb_measure double, college_share double, nonwhite_share double"
)
FORMATS = ("parquet", "csv", "json", "orc")
#: Arrow's file format, which is also Feather's second version.
ARROW = "arrow"
#: Stores whose Arrow files tasks read by record batches; from others Spark's own readers fetch each file whole.
DIRECT = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _arrow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Arrow files; one task reads a file of 2 GB at most, in its record batches."""
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                names = pa.ipc.open_file(content.as_buffer()).schema.names
                options = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in wanted.names])
                file = pa.ipc.open_file(content.as_buffer(), options=options)
                for i in range(file.num_record_batches):
                    yield from pa.Table.from_batches([file.get_batch(i)]).select(wanted.names).cast(wanted).to_batches(max_chunksize=65536)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", columns: list[str] | None = None, rules: dict[str, str] | None = None, quarantine: str | None = None
) -> DataFrame:
    """A lazy scan with a declared schema; only ``columns`` are read.

    With ``rules`` the input is split at once: rows that meet them come back, the others stay in ``quarantine`` with what they break."""
    if rules is not None:
        if quarantine is None:
            raise DataError("rules need a folder for the rows that break them")
        return validated.load(spark, path, schema, rules, quarantine, fmt).good.select(*(columns or schema.names))
    if fmt == ARROW:
        own = schema if columns is None else T.StructType([schema[c] for c in columns])
        return arrow_source.read_arrow(spark, path, own) if path.partition("://")[0] in DIRECT or "://" not in path else _arrow(spark, path, own)
    if fmt not in FORMATS:
        raise DataError(f"format must be one of {(*FORMATS, ARROW)}")
    frame = spark.read.schema(schema).format(fmt)
    frame = frame.option("header", True) if fmt == "csv" else frame
    return frame.load(path).select(*(columns or schema.names))


def of_year(measures: DataFrame, year: int) -> DataFrame:
    return measures.where(F.col("year") == year)


def in_area(transactions: DataFrame, cbsa: str, tracts: DataFrame | None = None) -> DataFrame:
    """Transactions of a CBSA, and of the tracts of a table if one is given."""
    own = transactions.where(F.col("cbsa_code") == cbsa)
    return own if tracts is None else own.join(tracts.select("census_tract").distinct(), "census_tract", "left_semi")


def save(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Write and replace ``path``; ``by`` are partition columns, which Arrow files don't have."""
    if fmt not in (*FORMATS, ARROW) or fmt == ARROW and by:
        raise DataError(f"format must be one of {FORMATS}, or {ARROW} without partition columns")
    if fmt == ARROW:
        return arrow_source.save_arrow(df, path)
    out = df.write.mode("overwrite").format(fmt)
    out = out.option("header", True) if fmt == "csv" else out.option("compression", "snappy") if fmt == "parquet" else out
    (out.partitionBy(*by) if by else out).save(path)


def save_results(results: DataFrame, metadata: dict, path: str) -> None:
    """The city index by weight scheme, and what made it as one JSON row."""
    save(results, f"{path}/index", by=("weight_type",))
    results.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, in its order and types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def schema_errors(df: DataFrame, schema: T.StructType) -> list[str]:
    """What ``df`` lacks or has otherwise; whole numbers pass where fractions are declared."""
    got = {f.name: f.dataType for f in df.schema.fields}
    ok = lambda have, want: have == want or isinstance(want, T.DoubleType) and isinstance(have, T.NumericType)
    lost = [f"missing column {f.name}" for f in schema.fields if f.name not in got]
    return lost + [f"{f.name} is {got[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema.fields if f.name in got and not ok(got[f.name], f.dataType)]


def narrowed(df: DataFrame) -> DataFrame:
    """Whole-number columns in the smallest of smallint, int and bigint that holds their values, found by one aggregation.

    Columns of nulls alone, fractions and text stay: a float lacks the index's digits, and Parquet keeps repeated text in dictionaries."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ShortType | T.IntegerType | T.LongType)]
    if not whole:
        return df
    ends = df.agg(*(end(f"`{c}`") for c in whole for end in (F.min, F.max))).first()
    fits = lambda lo, hi, bits: -(1 << bits) <= lo and hi < 1 << bits
    casts = {}
    for c, lo, hi in zip(whole, ends[::2], ends[1::2], strict=True):
        if lo is not None:
            casts[c] = F.col(f"`{c}`").cast("smallint" if fits(lo, hi, 15) else "int" if fits(lo, hi, 31) else "bigint").alias(c)
    return df.select(*(casts.get(c, F.col(f"`{c}`")) for c in df.columns))


def _state(df: DataFrame) -> list:
    """What a table's rows depend on: its plan, and its files' paths, sizes and times; without files, the plan's own hash."""
    spark = df.sparkSession
    most, shown = "spark.sql.debug.maxToStringFields", spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set(most, str(1 << 30))
    try:
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        spark.conf.set(most, shown)
    files = []
    for uri in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        files.append([uri, status.getLen(), status.getModificationTime()])
    return [plan, files or df.semanticHash()]


class Stages:
    """Stage outputs as Parquet below ``folder``; the path holds a hash of the settings and the inputs, so others never reuse them."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings, inputs: tuple[DataFrame, ...] = ()):
        key = hashlib.sha256(json.dumps([settings.key(), *map(_state, inputs)]).encode()).hexdigest()[:16]
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/{key}"

    def get(self, name: str, make) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


class Scratch:
    """Stage outputs of one run below ``folder``, never taken over by another."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def get(self, name: str, make) -> DataFrame:
        df = make()
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh URI below ``spark.checkpoint.dir``, which the driver and all executors see; a temporary folder only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise DataError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, c_nationkey and the segment's alphabetical number."""
    customers = _driver(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # Ranked over the distinct segments, five of them, and not over all customers.
    numbers = customers.select("c_mktsegment").distinct().withColumn("seg", F.dense_rank().over(Window.orderBy("c_mktsegment")))
    return customers.join(F.broadcast(numbers), "c_mktsegment").drop("c_mktsegment")


def _places() -> list:
    cbsa = (F.lit(10000) + F.col("c_nationkey")).cast("string")
    return [F.concat(cbsa, F.col("seg").cast("string")).alias("census_tract"), cbsa.alias("cbsa_code")]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sales of customers' properties, with ``tiebreak`` to order sales of one day."""
    orders = _driver(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    sold = orders.join(_customers(spark, sf_dir), orders["o_custkey"] == F.col("c_custkey"))
    return sold.select(
        F.col("o_custkey").cast("string").alias("property_id"), F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("o_totalprice").cast("double").alias("transaction_price"), *_places(), (F.col("seg") * 2.5).cast("double").alias("distance_to_cbd"),
        F.col("o_orderkey").alias("tiebreak"),
    )


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracts with a centroid and shares."""
    seg, nation = F.col("seg"), F.col("c_nationkey")
    return _customers(spark, sf_dir).select("c_nationkey", "seg").distinct().select(
        *_places(),
        (25 + nation % 5 * 4 + seg * 0.05).cast("double").alias("centroid_lat"),
        (-120 + F.floor(nation / 5) * 8 + seg * seg * 0.03).cast("double").alias("centroid_lon"),
        (seg * 2.5).cast("double").alias("distance_to_cbd"), (seg / 10.0).alias("college_share"), (nation % 10 / 10.0).alias("nonwhite_share"),
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight measures by tract and year."""
    tracts = _customers(spark, sf_dir).select(*_places(), "seg", "c_nationkey")
    units = tracts.groupBy("census_tract", "cbsa_code").agg(F.count(F.lit(1)).cast("double").alias("unit_measure"), F.first("seg").alias("seg"), F.first("c_nationkey").alias("nation"))
    values = transactions(spark, sf_dir).groupBy("census_tract", F.year("transaction_date").alias("year")).agg(F.sum("transaction_price").alias("value_measure"))
    return values.join(units, "census_tract").select(
        "census_tract", "cbsa_code", "year", "value_measure", "unit_measure", (F.col("value_measure") * 0.8).alias("upb_measure"),
        (F.col("seg") / 10.0).alias("college_share"), (F.col("nation") % 10 / 10.0).alias("nonwhite_share"),
    )


def sample_transactions(spark: SparkSession, properties: int, tracts: int = 100, cbsas: int = 10, first_year: int = 2000, years: int = 22, growth: float = 0.04) -> DataFrame:
    """Noise-free sales: price = property's level x exp(growth x years), two or three sales each; a tract lies in one CBSA."""
    p = spark.range(properties).select("id", F.pmod(F.xxhash64("id"), F.lit(tracts)).cast("int").alias("tract"))
    sales = p.withColumn("sale", F.explode(F.sequence(F.lit(0), 1 + (F.col("id") % 2).cast("int"))))
    day = F.pmod(F.xxhash64("id", "sale"), F.lit(years * 365 // 3)) + F.col("sale") * (years * 365 // 3)
    year = F.year(F.date_add(F.lit(f"{first_year}-01-01").cast("date"), day.cast("int")))
    return sales.select(
        F.format_string("P%09d", "id").alias("property_id"), F.date_add(F.lit(f"{first_year}-01-01").cast("date"), day.cast("int")).alias("transaction_date"),
        ((100000 + F.col("id") % 1000 * 100) * F.exp((year - first_year) * F.lit(growth))).cast("double").alias("transaction_price"),
        F.concat((F.lit(10000) + F.col("tract") % cbsas).cast("string"), F.lpad(F.col("tract").cast("string"), 6, "0")).alias("census_tract"),
        (F.lit(10000) + F.col("tract") % cbsas).cast("string").alias("cbsa_code"), (F.col("tract") % 20 * 1.5).cast("double").alias("distance_to_cbd"),
        (F.col("id") * 4 + F.col("sale")).alias("tiebreak"),
    )
