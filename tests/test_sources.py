import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quality import Contract
from tidemark.sources import payloads, publish, scans


def one(spark, text):
    return spark.createDataFrame([(text,)], "p string")


def test_json_shapes(spark):
    nested = json.dumps({"properties": {"parameter": {"T2M": {"20200101": 25.5, "20200102": None}, "RH": {"20200101": 80}}}})
    got = one(spark, nested).select(F.inline(payloads.series_json(F.col("p")))).collect()
    assert sorted((r.parameter, str(r.date), r.value) for r in got if r.value) == [("RH", "2020-01-01", 80.0), ("T2M", "2020-01-01", 25.5)]
    rates = json.dumps({"base": "EUR", "rates": {"2024-01-02": {"USD": 1.1, "GBP": 0.9}}})
    assert one(spark, rates).select(F.inline(payloads.rates_json(F.col("p")))).count() == 2
    grid = json.dumps({"columns": ["A", "B"], "data": [["1", "x"], ["2", None]]})
    assert [tuple(r) for r in one(spark, grid).select(F.inline(payloads.columns_and_data(F.col("p"), ["B", "C"]))).collect()] == [("x", None), (None, None)]
    pair = json.dumps([{"page": 1}, [{"date": "2020", "value": 3.5}]])
    assert [tuple(r) for r in one(spark, pair).select(F.inline(payloads.meta_and_rows(F.col("p"), "date string, value double"))).collect()] == [("2020", 3.5)]
    assert one(spark, "not json").select(F.explode_outer(payloads.series_json(F.col("p")))).first()[0] is None


def test_text_shapes(spark, tmp_path):
    wide = tmp_path / "wide.txt"
    wide.write_text("preamble 1990 x\n1991 " + " ".join(f"{k}.5" for k in range(12)) + "\n1992 " + " ".join(["-99.9"] * 12) + "\n")
    assert payloads.months_wide(spark.read.text(str(wide)), missing=-99.9).orderBy("month").first()["value"] == 0.5
    assert payloads.months_wide(spark.read.text(str(wide)), missing=-99.9).count() == 12
    fixed = tmp_path / "fixed.txt"
    fixed.write_text(" SEAS YR ANOM\n DJF 1950 -1.53\n JFM 1950 bad\n")
    rows = payloads.fixed_text(spark, str(fixed), ["SEAS", "YR", "ANOM"], "seas string, yr int, anom double").collect()
    assert [tuple(r) for r in rows] == [("DJF", 1950, -1.53), ("JFM", 1950, None)]
    with pytest.raises(Exception, match="unexpected header"):
        payloads.fixed_text(spark, str(fixed), ["SEAS", "YEAR", "ANOM"], "seas string, yr int, anom double").collect()
    packed = tmp_path / "t.tsv.gz"
    packed.write_bytes(gzip.compress(b"a\tb\n1\tx\nbad\ty\n"))
    good, bad = payloads.delimited(spark, str(packed), "a int, b string", "\t")
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and [r.b for r in bad.collect()] == ["y"]


def test_feed_and_html(spark):
    xml = "<rss><channel><item><title>T</title><link>u</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title>S</title><link>v</link><pubDate>?</pubDate></item></channel></rss>"
    got = one(spark, xml).select(F.inline(payloads.feed_items(F.col("p")))).collect()
    assert got[0].published == dt.datetime(2024, 1, 1, 10) and got[1].published is None
    grid = payloads.html_tables("<table><tr><th rowspan=2>Y</th><th colspan=2>M</th></tr><tr><td>1</td><td>2 &amp; 3</td></tr></table><p>x</p>")
    assert grid == [[["Y", "M", "M"], ["Y", "1", "2 & 3"]]]
    pages = spark.createDataFrame([(1, "<table><tr><td>a</td></tr></table>"), (2, None), (3, "<td>stray</td>")], "id long, html string")
    assert [tuple(r) for r in payloads.html_cells(pages, "id", "html").collect()] == [(1, 0, 0, 0, "a")]


def test_files_are_parsed_and_failures_kept(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "k,v\na,1\nb,\n")
    (tmp_path / "b.zip").write_bytes(b"junk")
    good, bad = scans.parse_files(spark, str(tmp_path), payloads.zipped_csv, "k string, v string", "*.zip")
    assert sorted((r.k, r.v) for r in good.collect()) == [("a", "1"), ("b", "")]
    assert ["BadZipFile" in r.parse_error for r in bad.collect()] == [True]
    assert scans.inventory(spark, str(tmp_path), "*.zip", least_bytes=10).count() == 1


def test_scan_prunes_and_pushes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2020, 1, 1.0), (2021, 2, float("nan"))], "year int, k int, v double").write.partitionBy("year").parquet(path)
    df = scans.scan(spark, path, ["k", "v", "nope"], F.col("k") > 1, (2021, 2022))
    plan = df._jdf.queryExecution().toString()
    assert df.columns == ["k", "v"] and df.first()["v"] is None
    assert "PartitionFilters: [isnotnull(year" in plan and "GreaterThan(k,1)" in plan
    empty = scans.scan_or_empty(spark, str(tmp_path / "no"), df.schema)
    assert empty.count() == 0


CONTRACT = Contract({"k": "bigint", "d": "date", "v": "double"}, ("k",), ("v",), {"v": (0, 10)})


def test_publish_checks_before_it_shows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(1, dt.date(2020, 1, 1), v)], "k int, d date, v double")
    publish.publish(rows(1.0), path, CONTRACT)
    with pytest.raises(ValueError, match="range:v"):
        publish.publish(rows(99.0), path, CONTRACT)
    assert spark.read.parquet(path).first()["v"] == 1.0
    publish.publish(rows(2.0), path, CONTRACT)
    assert spark.read.parquet(path).first()["v"] == 2.0 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="null in partition column d"):
        publish.write_partitions(rows(1.0).withColumn("d", F.lit(None).cast("date")), str(tmp_path / "p"), CONTRACT, ["d"])
    with pytest.raises(Exception, match="bad key: 1"):
        scans.check_keys(rows(1.0).union(rows(2.0)), CONTRACT).collect()


def test_refresh_list(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    sources = spark.createDataFrame([("a", t(1)), ("a", t(5)), ("b", t(1)), ("c", t(1))], "k string, modificationTime timestamp")
    targets = spark.createDataFrame([("a", t(3)), ("b", t(3))], "k string, modificationTime timestamp")
    assert sorted(r.k for r in scans.to_refresh(sources, targets, ["k"]).collect()) == ["a", "c"]
