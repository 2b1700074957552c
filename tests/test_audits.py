"""Statistics that merge, gates and audits: nulls, NaN, ties, empty tables, files that come, change and go."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, census

NAN = float("nan")


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_partials_merge_to_the_statistics_of_all(spark):
    rows = [("a", 1.0, None, "x"), ("a", NAN, NAN, None), ("b", 1.0, None, "x"), (None, None, NAN, "y")]
    df = spark.createDataFrame(rows, "part string, one double, none double, name string")
    got = by(census.merged(census.partials(df, ["part"], ["one", "none", "name", "lost"])), "column")
    assert set(got) == {"one", "none", "name"}
    assert (got["one"].n_parts, got["one"].n_rows, got["one"].n_values, got["one"].constant) == (3, 4, 2, True)
    assert got["none"].all_missing and not got["none"].constant and got["none"].distinct_at_least == 0
    assert (got["name"].low_text, got["name"].high_text, got["name"].distinct_at_least, got["name"].saturated) == ("x", "y", 2, False)
    assert census.merged(census.partials(df.where("false"), ["part"], ["one"])).count() == 0
    with pytest.raises(ValueError, match="none of the columns"):
        census.partials(df, ["part"], ["lost"])


def test_one_value_a_part_is_not_one_value(spark):
    df = spark.createDataFrame([(1, -999.0, 3), (2, -999.0, 4)], "part int, gone double, n int")
    got = by(census.merged(census.partials(df, ["part"], ["gone", "n"])), "column")
    assert got["gone"].saturated and not got["n"].constant
    assert not by(census.merged(census.partials(df, ["part"], ["gone"]), ()), "column")["gone"].saturated


def test_only_new_files_are_read(spark, tmp_path):
    path, kept_path = tmp_path / "t with space", str(tmp_path / "kept")
    path.mkdir()
    put = lambda name, values: pq.write_table(pa.table({"v": pa.array(values, pa.float64())}), path / name)
    put("1.parquet", [1.0, 2.0])
    put("2.parquet", [None])
    first = census.refresh(spark, str(path), None, ["v"])
    assert by(census.merged(first), "column")["v"].n_rows == 3
    first.write.parquet(kept_path)
    kept = spark.read.parquet(kept_path)
    poisoned = kept.withColumn("n_rows", F.col("n_rows") + 100)  # shows whose numbers are used
    put("3.parquet", [9.0])
    (path / "2.parquet").unlink()
    again = census.refresh(spark, str(path), poisoned, ["v"])
    assert sorted(r.n_rows for r in again.collect()) == [1, 102]
    put("1.parquet", [1.0, 2.0, 3.0])
    assert sorted(r.n_rows for r in census.refresh(spark, str(path), poisoned, ["v"]).collect()) == [1, 3]
    for name in ("1.parquet", "3.parquet"):
        (path / name).unlink()
    assert census.refresh(spark, str(path), kept, ["v"]).count() == 0


def test_floors_of_seasons(spark):
    floors = spark.createDataFrame([("a", 0.5, None, None), ("a", 0.9, 11, 2), ("a", 0.7, 1, 3), ("b", 0.2, 6, 8)], "column string, floor double, first_month int, last_month int")
    at = lambda month: {r.column: r.floor for r in census.floors_at(floors, month).collect()}
    assert at(1) == {"a": 0.9} and at(3) == {"a": 0.7} and at(12) == {"a": 0.9} and at(7) == {"a": 0.5, "b": 0.2} and at(None) == {"a": 0.5}


def test_gate_tells_each_kind(spark):
    states = census.partials(spark.createDataFrame([(1, 1.0, None, -999.0, "d"), (2, None, None, -999.0, "d")], "part int, half double, none double, mark double, known string"), ["part"], ["half", "none", "mark", "known"])
    floors = census.floors_at(spark.createDataFrame([(c, 0.6, None, None) for c in ("half", "none", "mark", "lost")], "column string, floor double, first_month int, last_month int"))
    found = {(r.column, r.kind) for r in census.gate(census.merged(states), floors, "known").collect()}
    assert found == {("half", "below_floor"), ("half", "constant"), ("none", "all_missing"), ("mark", "saturated"), ("lost", "absent"), ("known", "single_vintage")}
    assert census.gate(census.merged(states.where("false")), floors).select("kind").distinct().collect()[0].kind == "absent"
    assert [r.column for r in census.diverging(census.merged(states.where("part = 1")), census.merged(states), floors).collect()] == ["half"]


def test_leaks(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(day, day), (None, day), (dt.date(2020, 1, 2), day), (day, None)], "known date, at date")
    rules = audits.Names("^target_", "^area", "_lag$")
    got = {tuple(r) for r in audits.leaks(df, ["x", "target_x", "area", "area_lag"], rules, "known", "at").collect()}
    assert got == {("known_later", None, 1), ("target_like", "target_x", 4), ("same_period", "area", 4)}
    assert audits.leaks(df.where("false"), ["x"], rules, "known", "at").count() == 0
    assert audits.leaks(df.where("false"), [], rules, "known", "at").count() == 0


def test_events_count_once_a_group(spark):
    rows = [("t", 1, 1, True, 5.0, True, "o", 1), ("t", 1, 2, False, 7.0, True, "o", 2), ("t", 1, 3, None, 9.0, True, "o", 2), ("t", 2, 1, True, NAN, None, "p", 1), ("t", 2, 1, False, 3.0, True, "p", 1), (None, 3, 1, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "target string, g int, at int, label boolean, value double, ready boolean, origin string, stage int")
    balance = lambda x: audits.event_balance(x, "target", ["g"], "at", "label", "value", "ready", "origin", "stage")
    got = by(balance(df), "target")
    t = got["t"]
    assert (t.n_rows, t.n_groups, t.n_event_groups, t.event_group_share, t.n_event_rows, t.event_row_share) == (5, 2, 1, 0.5, 2, 0.5)
    assert (t.mean, t.low, t.n_trainable_groups, t.median_snapshots, t.least_origin_share, t.least_stage_share) == (7.0, 7.0, 1, 2.5, 0.0, 0.0)
    n = got[None]
    assert (n.n_rows, n.n_groups, n.event_group_share, n.mean, n.least_origin_share) == (1, 1, None, None, None)
    assert balance(df.where("false")).count() == 0


def test_coverage_of_features(spark):
    df = spark.createDataFrame([("a", True, 1.0, 2), ("a", None, NAN, 2), ("b", False, None, 2), (None, True, 1.0, 2)], "s string, ready boolean, x double, k int")
    got = by(audits.coverage(df, ["x", "k", "lost"], "ready", ["s"]), "feature")
    assert (got["x"].share, got["x"].trainable_share, got["x"].least_s, got["x"].n_distinct, got["x"].mode_share, got["x"].bucket) == (0.5, 1.0, 0.0, 1, 1.0, "constant")
    assert got["k"].bucket == "constant" and (got["lost"].bucket, got["lost"].n_rows, got["lost"].n_trainable) == ("missing", 4, 2)
    assert audits.coverage(df.where("false"), ["x"], "ready", ["s"]).count() == 0
