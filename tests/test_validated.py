"""Rules on load: what each row breaks, counts, quarantine and rows that don't parse."""

import json

import pytest

from terrace.config import DataError
from terrace.sources import tables, validated


def test_split_of_odd_rows(spark, tmp_path):
    rows = [
        ("p", "1999-01-01", 100.0, "t", "10000", 1.0), ("p", "1999-01-01", 100.0, "t", "10000", None), (None, None, None, None, None, None), ("q", "1960-01-01", -5.0, "t", "1000", -1.0),
        ("q", "1960-01-01", -5.0, "t", "1000", -1.0), ("r", "1999-01-01", float("nan"), "t", "10000", 1.0), ("", "1999-01-01", 1e9, "t", "10000", 1.0),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "property_id string, d string, transaction_price double, census_tract string, cbsa_code string, distance_to_cbd double, good string")
    df = df.selectExpr("property_id", "cast(d as date) as transaction_date", "transaction_price", "census_tract", "cbsa_code", "distance_to_cbd")
    found = validated.split(df, validated.TRANSACTION_RULES, f"file://{tmp_path}/a")
    assert found.good.count() == 2 and found.good.columns == df.columns
    got = sorted((r.property_id or "", r.broken_rules) for r in found.bad.collect())
    late = ["cbsa_code", "transaction_date", "transaction_price", "distance_to_cbd"]
    assert got == [
        ("", ["property_id", "census_tract", "cbsa_code", "transaction_date", "transaction_price"]), ("", ["property_id", "transaction_price"]), ("q", late), ("q", late), ("r", ["transaction_price"]),
    ]
    assert found.counts == {"property_id": 2, "census_tract": 1, "cbsa_code": 3, "transaction_date": 3, "transaction_price": 5, "distance_to_cbd": 2, "rows": 7, "bad": 5}
    assert {r.rule: r.violations for r in validated.rule_counts(found.bad, validated.TRANSACTION_RULES).collect()} == {k: v for k, v in found.counts.items() if k not in ("rows", "bad")}
    none = validated.split(df.where("false"), validated.TRANSACTION_RULES, f"file://{tmp_path}/b")
    assert none.good.count() == none.bad.count() == 0 and none.counts["rows"] == 0


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rows_that_do_not_parse_keep_their_text(spark, tmp_path, fmt):
    names = tables.GEOGRAPHY.names
    good, odd = ("t1", "10000", 12.5, 30.0, 1.0), ("t2", "10000", 95.0, 30.0, 1.0)
    lines = [",".join(names), ",".join(map(str, good)), ",".join(map(str, odd)), "t3,10000,north,30.0,1.0"] if fmt == "csv" else [json.dumps(dict(zip(names, x, strict=True))) for x in (good, odd)] + ['{"census_tract": "t3", "centroid_lat":']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("\n".join(lines) + "\n")
    found = validated.load(spark, f"{tmp_path}/in", tables.GEOGRAPHY, validated.GEOGRAPHY_RULES, f"file://{tmp_path}/out", fmt)
    assert [tuple(r) for r in found.good.collect()] == [good]
    bad = {r[validated.TEXT] or r.census_tract: r.broken_rules for r in found.bad.collect()}
    assert bad.pop("t2") == ["centroid_lat"] and len(bad) == 1
    ((text, broken),) = bad.items()
    assert text == lines[-1] and broken[0] == "malformed" and found.counts["malformed"] == 1


def test_read_with_rules(spark, tmp_path):
    spark.createDataFrame([("t1", "10000", 1.0, 1.0, 1.0), ("t2", "x", 1.0, 1.0, 1.0)], tables.GEOGRAPHY).write.parquet(f"{tmp_path}/g")
    got = tables.read(spark, f"{tmp_path}/g", tables.GEOGRAPHY, rules=validated.GEOGRAPHY_RULES, quarantine=f"file://{tmp_path}/q", columns=["census_tract"])
    assert [tuple(r) for r in got.collect()] == [("t1",)]
    assert spark.read.parquet(f"{tmp_path}/q").where("not good").select("census_tract").first()[0] == "t2"
    with pytest.raises(DataError):
        tables.read(spark, f"{tmp_path}/g", tables.GEOGRAPHY, rules=validated.GEOGRAPHY_RULES)
