"""Hand-computed cases of the operators, nulls and ties among them."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, series
from tidemark.operators import conform, evaluate, graph, metric, pit, prices, quality, retrieve, text, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_trailing_z_needs_values_and_never_sees_its_own_row(spark):
    levels = [20.0, 22.0, 21.0, 25.0, 19.0, 30.0]
    df = frame(spark, [("k", 2000 + i, v) for i, v in enumerate(levels)], "k string, y int, v double")
    z = column(windows.z_score(df, ["k"], ["y"], "v", "z", 30, 3), "z", "y")
    assert z[:3] == [None] * 3 and z[3] == pytest.approx((25 - 21) / 1.0)
    changed = df.withColumn("v", F.when(F.col("y") == 2005, 999.0).otherwise(F.col("v")))
    assert column(windows.z_score(changed, ["k"], ["y"], "v", "z", 30, 3), "z", "y")[:5] == z[:5]
    flat = df.withColumn("v", F.lit(1.0))
    assert column(windows.z_score(flat, ["k"], ["y"], "v", "z", 30, 3), "z", "y") == [None] * 6


def test_rolling_z_of_one_to_nine(spark):
    df = frame(spark, [("k", i, float(i)) for i in range(1, 10)], "k string, t int, v double")
    z = column(windows.z_score(df, ["k"], ["t"], "v", "z", 8, 8, current=True, population=True), "z", "t")
    assert z[:7] == [None] * 7 and z[7] == pytest.approx(3.5 / math.sqrt(5.25))


@pytest.mark.parametrize(("mode", "want"), [("zero_ends", [0, 1, 2, 0, 1, -1, -2]), ("skip_zero", [0, 1, 2, 2, 3, -1, -2]), ("reset", [0, 1, 2, 0, 1, 2, 3])])
def test_streaks(spark, mode, want):
    deltas = [None, 1.0, 2.0, 0.0, 3.0, -1.0, -2.0]
    df = frame(spark, [("k", i, d) for i, d in enumerate(deltas)], "k string, t int, d double")
    assert column(windows.streak(df, ["k"], ["t"], "d", "s", mode), "s", "t") == want


def test_longest_run_and_null_is_false(spark):
    df = frame(spark, [("a", i, v) for i, v in enumerate([4.0, 4.0, None, 4.0, 4.0, 4.0, 9.0])] + [("b", 0, 9.0)], "k string, t int, v double")
    assert {r.k: r.n for r in windows.longest_run(df, ["k"], ["t"], F.col("v") < 5, "n").collect()} == {"a": 3, "b": 0}


def test_episodes_split_on_gaps_and_skip_junk(spark):
    days = ["1994-06-10", "1994-08-01", "2021-06-01", "2021-07-15", None]
    df = frame(spark, [("k", d and dt.date.fromisoformat(d)) for d in days], "k string, d date")
    got = windows.episodes(df, ["k"], "d", 90).orderBy("episode").collect()
    assert [(str(r.first_date), str(r.last_date)) for r in got] == [("1994-06-10", "1994-08-01"), ("2021-06-01", "2021-07-15")]


@pytest.mark.parametrize(("horizon", "want"), [(90, 1), (30, 3)])
def test_independent_windows(spark, horizon, want):
    df = frame(spark, [("k", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(90)], "k string, d date")
    assert windows.independent_windows(df, ["k"], "d", horizon, "n").first()["n"] == want


def test_asof_ties_strict_and_null_times(spark):
    left = frame(spark, [(1, "a", 5), (2, "a", 7), (3, "a", None), (4, None, 7), (5, "b", 7)], "id int, k string, t int")
    right = frame(spark, [("a", 5, 1.0), ("a", 5, 2.0), ("a", 6, 3.0), (None, 1, 9.0)], "k string, u int, v double")
    got = {r.id: r.v for r in pit.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None, 4: None, 5: None}
    strict = {r.id: r.v for r in pit.asof_join(left, right, ["k"], "t", "u", ["v"], strict=True).collect()}
    assert strict[1] is None and strict[2] == 3.0


def test_vintage_moves_with_the_date(spark):
    df = frame(spark, [("x", 1, "2024-05-01", 10.0), ("x", 2, "2024-06-20", 11.0), ("x", 4, "2025-01-10", 12.0)], "k string, survey int, known string, v double")
    at = lambda day: pit.latest_vintage(df, ["k"], "known", F.lit(day)).first()["survey"]
    assert (at("2024-07-01"), at("2025-06-01")) == (2, 4)


def test_month_lag_counts_from_the_months_end(spark):
    df = frame(spark, [(2024, m) for m in range(1, 13)], "year int, month int")
    seen = df.where(pit.known_by_month("year", "month", 43, F.lit("2024-05-13").cast("date"))).count()
    assert seen == 3  # March 31 and 43 days is May 13


def test_conflicts_fail_and_copies_collapse(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("b", 2.0)], "k string, v double")
    assert conform.collapse_or_fail(df, ["k"], ["v"]).count() == 2
    with pytest.raises(Exception, match="conflicting rows for b"):
        conform.collapse_or_fail(df.union(frame(spark, [("b", 3.0)], "k string, v double")), ["k"], ["v"]).collect()


def test_units_sentinels_numbers_and_keys(spark):
    df = frame(spark, [("kg", 2.0), ("stone", 3.0), (None, 4.0)], "unit string, v double")
    assert column(conform.convert_units(df, "unit", "v", {"kg": 0.001}, "t"), "t", "v") == [0.002, None, None]
    with pytest.raises(Exception, match="unknown unit: stone"):
        conform.convert_units(df.where("v = 3"), "unit", "v", {"kg": 0.001}, "t", strict=True).collect()
    raw = frame(spark, [("1.782,18",), ("1,782.18",), ("(12.5)",), ("3*",), ("n/a",), ("1.234",)], "s string")
    assert [r[0] for r in raw.select(conform.parse_number(F.col("s"))).collect()] == [1782.18, 1782.18, -12.5, 3.0, None, 1.234]
    assert frame(spark, [("Côte d'Ivoire ",)], "s string").select(conform.snake_case(F.col("s"))).first()[0] == "cote_d_ivoire"
    nan = frame(spark, [(float("nan"),), (1.0,)], "v double")
    assert [r.v for r in conform.nan_to_null(nan).collect()] == [None, 1.0]


def test_front_contract_rules(spark):
    rows = [("s", "2026-06-15", m, oi) for m, oi in (("2026-05", 5000.0), ("2026-07", 900.0), ("2026-09", 900.0), ("2026-11", None))]
    df = frame(spark, rows, "slug string, trade_date string, contract_month string, oi double").withColumn("trade_date", F.to_date("trade_date"))
    assert [r.contract_month for r in prices.front_contract(df, "oi").collect()] == ["2026-07"]


def test_graph_with_a_cycle(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src string, dst string")
    assert [r.node for r in graph.roots(edges).collect()] == ["a"]
    got = {r.node: r.depth for r in graph.reachable(edges, frame(spark, [("a",)], "node string"), 5).collect()}
    assert got == {"b": 1, "c": 2, "d": 3}
    assert sorted(r.node for r in graph.on_cycles(edges).collect()) == ["b", "c"]


def test_rules_need_all_or_some(spark):
    active = frame(spark, [("e", "x"), ("e", "y")], "entity string, driver string")
    rules = frame(spark, [("two", "x", 2), ("two", "y", 2), ("two", "z", 2), ("all", "x", None), ("all", "z", None)], "rule string, driver string, needed int")
    assert [(r.rule, r.n_active) for r in graph.fires(active, rules).collect()] == [("two", 2)]


def test_metric_refusals_and_empty_scope(spark):
    card = metric.TableCard(("v",), ("s",), "d", "data_date", annual=True)
    df = frame(spark, [("a", dt.date(2020, 1, 1), 1.0)], "s string, d date, v double")
    with pytest.raises(ValueError, match="no months"):
        metric.compile_query(df, card, metric.MetricQuery("v", "sum", "2021-01-01", start="2020-02-01", end="2020-03-01"))
    with pytest.raises(ValueError, match="no metric"):
        metric.compile_query(df, card, metric.MetricQuery("w", "sum", "2021-01-01"))
    assert metric.compile_query(df, card, metric.MetricQuery("v", "sum", "2021-01-01", scopes=(("s", ()),))).first()["n_rows"] == 0


def test_named_statistics_by_hand(spark):
    flags = frame(spark, [([0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0],)], "f array<double>")
    s = flags.select(series.compute("flag_events", F.col("f")).alias("s")).first()["s"]
    assert (s.total, s.in_window, s.since) == (2, 1, 2)
    short = frame(spark, [([1.0, None],)], "f array<double>")
    assert short.select(series.compute("zscore", F.col("f"))).first()[0] is None
    assert short.select(series.decline("zscore", F.col("f"))).first()[0] == "too_few_values"
    line = frame(spark, [([1.0, 3.0, 5.0, 7.0],)], "f array<double>")
    assert line.select(series.compute("trend", F.col("f"))).first()[0] == pytest.approx(2.0)
    assert len(series.TRANSFORMS) >= 18


def test_calendar(spark):
    df = frame(spark, [(dt.date(2024, 3, 4), dt.date(2024, 3, 11))], "a date, b date")
    row = df.select(dates.previous_business_day(F.col("a")), dates.business_days_between(F.col("a"), F.col("b")), dates.season_label(F.col("a"), 4), dates.next_release(F.col("a"), "business_day", 2), dates.next_release(F.col("a"), "quarter_end", 70), dates.contract_year(F.lit(3), F.col("a"))).first()
    assert [str(x) for x in row] == ["2024-03-01", "5", "2023-24", "2024-04-02", "2024-03-10", "2033"]
    seasons = frame(spark, [("2011/2012",), ("2011-12",), ("x",)], "s string").select(dates.normalized_season(F.col("s"))).collect()
    assert [r[0] for r in seasons] == ["2011-12", "2011-12", None]


def test_contract_evolution(spark):
    old = quality.Contract({"a": "int", "b": "float"}, ("a",))
    assert old.may_become(quality.Contract({"a": "bigint", "b": "double", "c": "string"}, ("a",))) == []
    assert old.may_become(quality.Contract({"b": "float", "a": "int"}, ("a",)))
    assert "narrowed: a" in old.may_become(quality.Contract({"a": "smallint", "b": "float"}, ("a",)))
    assert "PARTITIONED BY (`b` float)" in old.ddl("t", "s3://x/y", ("b",))


def test_average_precision_by_hand(spark):
    df = frame(spark, [("k", 0.9, 1, 1), ("k", 0.8, 0, 2), ("k", 0.7, 1, 3)], "k string, s double, y int, id int")
    assert evaluate.average_precision(df, ["k"], "s", F.col("y") == 1, "id").first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)


def test_texts(spark):
    df = frame(spark, [(1, "A  b\nC", "<p>x &amp; y</p><script>no</script><a href='u'>l</a>"), (2, None, None), (3, "", "")], "id int, t string, h string")
    rows = df.select(text.normalized(F.col("t")), text.html_text(F.col("h")), F.size(text.shingles(F.col("t"), 2))).collect()
    assert rows[0][:2] == ("a b c", "x & y l") and rows[0][2] == 2 and rows[2][2] == 0
    assert [(r.id, r.href) for r in text.links(df, "id", "h").collect()] == [(1, "u")]
    long = frame(spark, [(1, "one two. three four.\n\nfive.\n\n" + "word " * 50 + "end.")], "id int, t string")
    got = text.chunks(long, "id", "t", 40).orderBy("chunk").collect()
    assert got[0].chunk_text == "one two. three four.\n\nfive." and got[0].previous is None and got[-1].next is None
    a, b = text.bottom_sketch(F.lit("a b c d e"), 2), text.bottom_sketch(F.lit("a b c d f"), 2)
    assert spark.range(1).select(text.sketch_jaccard(a, b)).first()[0] > 0.4


def test_fusion_and_hits(spark):
    a, b = frame(spark, [(1, 1), (2, 2)], "id int, rank int"), frame(spark, [(2, 1)], "id int, rank int")
    assert {r.id: round(r.fused, 6) for r in retrieve.fuse([a, b], "id").collect()} == {1: round(1 / 61, 6), 2: round(1 / 62 + 1 / 61, 6)}


def test_stateful_revisions(spark, tmp_path):
    from tidemark.streaming import jobs

    path = str(tmp_path / "r.parquet")
    frame(spark, [("a", dt.datetime(2020, 5, 12), 120.0), ("a", dt.datetime(2020, 6, 12), 117.0), ("a", dt.datetime(2020, 7, 12), 113.0), ("b", dt.datetime(2020, 7, 12), None)], "k string, t timestamp, v double").coalesce(1).write.parquet(path)
    got = jobs.replay(spark, path, lambda df: jobs.revisions(df, "k", "t", "v"), "append")
    assert [r.revision for r in got.where("k = 'a'").orderBy("t").collect()] == [None, -3.0, -4.0]


def test_values_out_of_range_become_the_bound(spark):
    from tidemark.operators import features

    registry = features.Registry()
    registry.add("f", low=-1.0, high=2.0)(lambda df: df)
    registry.add("g", high=0.5)(lambda df: df)
    rows = spark.createDataFrame([("a", 1, "f", v) for v in (-5.0, 0.25, 9.0, None, float("nan"))], "entity string, period int, feature string, value double")
    assert sorted(r.value for r in registry.spine(rows).collect()) == [-5.0, -1.0, 0.25, 0.25, 0.5, 2.0]


def test_alerts_that_held_so_often_so_far(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import evaluate

    held = [True, False, True, None, True, False, True]
    rows = spark.createDataFrame([("a", k, x) for k, x in enumerate(held)], "g string, k int, x boolean")
    alerts = lambda **more: [r.persistent_alert for r in evaluate.persistent(rows, ["g"], "k", F.col("x"), 2, **more).orderBy("k").collect()]
    assert alerts() == [False, False, True, False, True, False, True]
    assert alerts(consecutive=True) == [False] * 7


def test_old_events_and_repeated_rows_of_a_peak(spark):
    from tidemark.operators import windows

    rows = spark.createDataFrame([("a", "2024-01-31")] * 2 + [("a", "2024-01-01"), ("b", "2024-01-31"), ("a", None)], "k string, day string")
    events = spark.createDataFrame([("a", "2024-01-01", 8.0), ("a", "2024-01-30", 0.25), ("a", "2024-02-09", 99.0), ("a", None, 99.0), ("b", "2024-01-31", -1.0)], "k string, at string, s double")
    got = windows.decayed_peak(rows, events, ["k"], "day", "at", "s", 10.0, "peak", own_day=True).collect()
    assert sorted((r.k, r.day or "", r.peak and round(r.peak, 9)) for r in got if r.peak) == [("a", "2024-01-01", 8.0), ("a", "2024-01-31", 1.0), ("a", "2024-01-31", 1.0)]
    assert len(got) == 5
