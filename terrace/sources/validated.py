"""Loading with rules: every row is told which rules it breaks, and bad rows go to quarantine, in one pass over the input.

A rule is a name and an SQL condition that good rows meet; a condition that is null counts as broken. All rules of a table are
one array expression. ``split`` writes the input once, by whether a row is good, so neither the good rows, the bad ones nor
the counts scan it again. Rows of text formats that don't parse are bad as ``malformed``, with their text.

Repeated rows are each told the same; an empty input gives two empty tables; a row may break any number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_RULES = {
    "property_id": "property_id is not null and property_id != ''", "census_tract": "census_tract is not null and census_tract != ''", "cbsa_code": "cbsa_code rlike '^[0-9]{5}$'",
    "transaction_date": "transaction_date between date '1975-01-01' and date '2021-12-31'", "transaction_price": "transaction_price > 0 and transaction_price < 1e8",
    "distance_to_cbd": "distance_to_cbd is null or distance_to_cbd >= 0",
}
GEOGRAPHY_RULES = {
    "census_tract": "census_tract is not null and census_tract != ''", "cbsa_code": "cbsa_code rlike '^[0-9]{5}$'", "centroid_lat": "centroid_lat between -90 and 90",
    "centroid_lon": "centroid_lon between -180 and 180", "distance_to_cbd": "distance_to_cbd is null or distance_to_cbd >= 0",
}
MEASURE_RULES = {
    "census_tract": "census_tract is not null and census_tract != ''", "year": "year between 1975 and 2021", "measures": "coalesce(least(value_measure, unit_measure, upb_measure), 0) >= 0",
    "shares": "coalesce(college_share, 0) between 0 and 1 and coalesce(nonwhite_share, 0) between 0 and 1",
}
BROKEN, TEXT, MALFORMED = "broken_rules", "malformed_text", "malformed"


def broken_rules(rules: dict[str, str]) -> Column:
    """The names of the rules that a row breaks, in the rules' order."""
    marks = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


@dataclass(frozen=True)
class Split:
    """``good`` rows with their own columns, ``bad`` ones with ``broken_rules`` too, and the number of rows that break each rule."""

    good: DataFrame
    bad: DataFrame
    counts: dict[str, int]


def split(df: DataFrame, rules: dict[str, str], folder: str) -> Split:
    """Write ``df`` below ``folder`` (which it replaces) as good and bad rows; counts are observed while writing."""
    told = df.withColumn(BROKEN, broken_rules(rules))
    seen, counted = Observation("rules"), [*rules]
    totals = [F.count_if(F.array_contains(BROKEN, name)).alias(f"c{i}") for i, name in enumerate(counted)]
    told = told.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size(BROKEN) > 0).alias("bad"), *totals)
    told.withColumn("good", F.size(BROKEN) == 0).write.mode("overwrite").partitionBy("good").parquet(folder)
    got = seen.get
    written = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(BROKEN, T.ArrayType(T.StringType())), T.StructField("good", T.BooleanType())])).parquet(folder)
    counts = {name: got[f"c{i}"] for i, name in enumerate(counted)}
    return Split(written.where("good").select(*df.columns), written.where("not good").select(*df.columns, BROKEN), counts | {"rows": got["rows"], "bad": got["bad"]})


def load(spark: SparkSession, path: str, schema: T.StructType, rules: dict[str, str], folder: str, fmt: str = "parquet") -> Split:
    """Read ``path`` under ``schema`` and split it by ``rules``. In CSV and JSON, rows that don't parse are bad and keep their text."""
    if fmt not in ("csv", "json"):
        from terrace.sources.tables import read

        return split(read(spark, path, schema, fmt), rules, folder)
    told = T.StructType([*schema.fields, T.StructField(TEXT, T.StringType())])
    rows = spark.read.schema(told).format(fmt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", TEXT).option("header", fmt == "csv").option("enforceSchema", True).load(path)
    found = split(rows, {MALFORMED: f"{TEXT} is null"} | rules, folder)
    return Split(found.good.drop(TEXT), found.bad, found.counts)


def rule_counts(bad: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, violations) of quarantined rows, zeros included."""
    names = bad.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    found = bad.select(F.explode(BROKEN).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    return names.join(found, "rule", "left").select("rule", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))
