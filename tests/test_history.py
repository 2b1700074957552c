"""Releases, outcomes, admission, spans, search, validation and scores by hand-computed or plain cases."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as S
from tidemark.operators import admission, conform, evaluate, folds, graph, lexicon, outcomes, pit, prices, retrieve, scores, text, vintages, windows

DAY = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# outcomes


@pytest.fixture(scope="module")
def tape(spark):
    rows = [("a", DAY(2024, 1, 1) + dt.timedelta(days=k), 100.0 + k) for k in range(0, 200) if k % 7 < 5]
    rows += [("late", DAY(2024, 3, 1), 50.0), ("late", DAY(2024, 3, 2), 51.0), ("zero", DAY(2024, 1, 1), 0.0), ("zero", DAY(2024, 1, 31), 5.0), ("zero", DAY(2024, 6, 30), 5.0), ("a", DAY(2024, 1, 1), None), ("a", None, 3.0)]
    rows += [("gap", DAY(2024, 1, 1), 10.0), ("gap", DAY(2024, 1, 10), 11.0), ("gap", DAY(2024, 6, 30), 20.0)]
    return frame(spark, rows, "k string, day date, price double")


def test_outcomes_closed_pending_and_declined(spark, tape):
    events = [(1, "a", DAY(2024, 1, 6)), (2, "a", DAY(2024, 6, 20)), (3, "none", DAY(2024, 1, 6)), (4, "late", DAY(2024, 1, 6)), (5, "zero", DAY(2024, 1, 1)), (6, "gap", DAY(2024, 1, 20)), (7, "gap", DAY(2024, 1, 10)), (8, "a", DAY(2024, 8, 1)), (9, "a", None), (1, "a", DAY(2024, 1, 6))]
    told = outcomes.outcomes(frame(spark, events, "id int, k string, at date"), tape, ["k"], "at", "day", "price", [30], F.lit(DAY(2024, 7, 10))).collect()
    got = {r.id: r for r in told}
    assert len(told) == 8 and sum(r.id == 1 for r in told) == 2 and 9 not in got
    # 6 January is no session: the 8th is; 30 days on, the 5th of February is one
    assert (got[1].status, got[1].anchor_date, got[1].endpoint_date) == ("closed", DAY(2024, 1, 8), DAY(2024, 2, 5))
    assert got[1].move_pct == pytest.approx(100 * (135 / 107 - 1)) and got[1].readable_date == DAY(2024, 2, 5)
    assert got[2].status == "pending" and got[2].move_pct is None and got[2].endpoint_price is None and got[2].readable_date == DAY(2024, 6, 20)
    assert [got[k].status for k in (3, 4, 5, 6, 7)] == ["declined_no_series", "declined_pre_coverage", "declined_no_price", "declined_no_anchor", "declined_no_endpoint"]


def test_a_horizon_in_the_settling_days_is_pending(spark, tape):
    events = frame(spark, [(1, "a", DAY(2024, 1, 1))], "id int, k string, at date")
    status = lambda day: outcomes.outcomes(events, tape, ["k"], "at", "day", "price", [30], F.lit(day)).first().status
    assert status(DAY(2024, 2, 5)) == "pending" and status(DAY(2024, 2, 6)) == "closed"


def test_reading_an_outcome_table_earlier_gives_no_later_move(spark, tape):
    events = frame(spark, [(1, "a", DAY(2024, 1, 1), DAY(2024, 1, 1)), (2, "a", DAY(2024, 2, 1), DAY(2026, 1, 1))], "id int, k string, at date, written date")
    told = outcomes.outcomes(events, tape, ["k"], "at", "day", "price", [30], F.lit(DAY(2024, 7, 10)))
    rows = {r.id: r for r in outcomes.readable(told, F.lit(DAY(2024, 2, 3)), written_at="written").collect()}
    assert list(rows) == [1] and rows[1].status == "pending" and rows[1].move_pct is None
    assert {r.id: r.status for r in outcomes.readable(told, F.lit(DAY(2024, 2, 8)), written_at="written").collect()} == {1: "closed"}


def test_distributions_are_suppressed_by_reason(spark):
    start = DAY(2024, 1, 1)
    rows = [("daily", start + dt.timedelta(days=k), 90, "closed", float(k)) for k in range(90)]
    rows += [("thin", start + dt.timedelta(days=100 * k), 90, "closed", 1.0) for k in range(4)]
    rows += [("fine", start + dt.timedelta(days=100 * k), 90, "closed", float(k)) for k in range(10)] + [("fine", start, 90, "pending", None)]
    rows += [("open", start, 90, "pending", None), ("bad", start, 90, "declined_no_anchor", None)]
    rows += [("heavy", start + dt.timedelta(days=100 * k), 90, "closed", 1.0) for k in range(8)] + [("heavy", start, 90, "pending", None)] * 12
    told = frame(spark, rows, "k string, at date, horizon_days int, status string, move_pct double")
    got = {r.k: r for r in outcomes.distribution(told, ["k"], "at").collect()}
    assert {k: r.suppressed for k, r in got.items()} == {"daily": "overlap", "thin": "too_thin", "fine": None, "open": "all_pending", "bad": "unmeasurable", "heavy": "pending_heavy"}
    assert got["daily"].n_independent == 1 and got["fine"].n_independent == 10 and got["fine"].joined == 11
    assert (got["fine"].median, got["fine"].p10, got["fine"].share_up) == (4.5, 0.9, 0.9) and got["thin"].median is None


# two clocks


def test_validity_merges_repeats_and_tells_withdrawals(spark):
    rows = [("x", 1, 1, 5.0), ("x", 1, 2, 5.0), ("x", 1, 3, None), ("x", 1, 4, 6.0), ("x", 1, 4, 7.0), ("x", 1, None, 9.0)]
    got = vintages.validity(frame(spark, rows, "k string, p int, at int, v double"), ["k", "p"], "at", "v").orderBy("valid_from").collect()
    assert [(r.v, r.valid_from, r.valid_to) for r in got] == [(5.0, 1, 3), (None, 3, 4), (7.0, 4, None)]
    held = vintages.as_of(vintages.validity(frame(spark, rows, "k string, p int, at int, v double"), ["k", "p"], "at", "v"), F.lit(3)).collect()
    assert [r.v for r in held] == [None]


def test_released_z_equals_one_build_a_release(spark):
    rnd = random.Random(4)
    rows = [(k, p, at, None if rnd.random() < 0.1 else 1e6 + rnd.random()) for k in "ab" for p in range(1, 16) for at in sorted(rnd.sample(range(p, 24), 3))]
    got = vintages.released_z(frame(spark, rows, "k string, p int, at int, v double"), ["k"], "p", "at", "v", 6, 3).collect()
    for k in "ab":
        for at in range(1, 26):
            known = {}
            for kk, p, t, v in sorted(rows, key=lambda r: r[2]):
                if kk == k and t <= at:
                    known[p] = v
            for p in known:
                past = [known[q] for q in range(p - 5, p + 1) if known.get(q) is not None]
                (row,) = [r for r in got if r.k == k and r.p == p and r.valid_from <= at and (r.valid_to is None or r.valid_to > at)]
                assert row.v == known[p] and row.n == len(past)
                if known[p] is None or len(past) < 3:
                    assert row.z is None
                else:
                    assert row.z == pytest.approx((known[p] - np.mean(past)) / np.std(past, ddof=1), abs=1e-4)


def test_same_vintage_refuses_mixed_releases(spark):
    rows = [("k", 1, "a", 1, 4.0), ("k", 1, "b", 1, 2.0), ("k", 2, "a", 1, 4.0), ("k", 2, "a", 2, 5.0), ("k", 2, "b", 1, 2.0), ("k", 3, "a", 1, 4.0), ("k", 4, "a", 1, 4.0), ("k", 4, "b", 1, 2.0), ("k", 4, "b", 1, 3.0), ("k", 1, "a", 9, 7.0)]
    got = {r.p: r for r in vintages.same_vintage(frame(spark, rows, "k string, p int, s string, at int, v double"), ["k"], "p", "s", ["a", "b"], "at", "v", F.lit(5)).collect()}
    assert set(got) == {1, 2, 4} and (got[1].a, got[1].b, got[1].vintage, got[1].refused) == (4.0, 2.0, 1, False)
    assert got[2].refused and got[2].a is None and got[2].vintage is None and got[4].refused


def test_standing_wants_recent_history(spark):
    rows = [("ok", p, float(p)) for p in range(1, 7)] + [("tail", p, None if p == 6 else 1.0) for p in range(1, 7)] + [("old", p, None if p < 4 else 2.0) for p in range(1, 7)] + [("none", 1, None)]
    got = {r.k: r for r in vintages.standing(frame(spark, rows, "k string, p int, v double"), ["k"], "p", "v", 4, 0.5, 1).collect()}
    assert (got["ok"].latest_period, got["ok"].latest, got["ok"].share_below, got["ok"].mean) == (6, 6.0, 1.0, 3.5)
    assert got["tail"].declined == "gappy" and got["none"].declined == "no_history" and got["old"].declined is None


# spans


def plain_spans(lex, words):
    low = lexicon.fold(words)
    keys = sorted(lex.names, key=len, reverse=True)
    rx = re.compile(r"(?<![a-z0-9])(?:" + "|".join(r"\s+".join(map(re.escape, k.split(" "))) for k in keys) + r")(?![a-z0-9])")
    return [(m.start(), m.end(), lex.names[" ".join(m[0].split())]) for m in rx.finditer(low) if lex.names[" ".join(m[0].split())] is not None]


def test_spans_are_leftmost_longest_at_original_places():
    lex = lexicon.Lexicon([("South Africa", "za"), ("south", "s"), ("Côte d'Ivoire", "ci"), ("africa", "af"), ("U.S.", "us"), ("georgia", "ge"), ("Georgia", "us-ga"), ("", "x")], ["south african rand"])
    auto = lex.automaton()
    assert lex.spans(auto, "In SOUTH \n  AFRICA, côte d’x; CÔTE D'IVOIRE and the U.S. of africa1") == [(3, 18, "za"), (30, 43, "ci"), (52, 56, "us")]
    assert lex.spans(auto, "south african rand; south") == [(20, 25, "s")]
    assert lex.spans(auto, "Georgia") == [] and "georgia" in lex.ambiguous
    rnd = random.Random(1)
    pieces = ["south", "africa", " ", "  ", "\n", "african", "rand", "u.s.", "côte d'ivoire", "x", "1", ".", "Á", "ﬁ", "İ"]
    for _ in range(2000):
        words = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12)))
        assert lex.spans(auto, words) == plain_spans(lex, words), words


def test_followers_drop_a_span():
    lex = lexicon.Lexicon([("brazil", "br"), ("china", "cn")], followers=["real", "new year"])
    auto = lex.automaton()
    assert lex.spans(auto, "Brazil's real fell; China New Year; Brazil rose, real") == [(36, 42, "br")]


def test_fold_keeps_lengths_and_spans_in_tables(spark):
    for s in ("ÀÉîõü ß ŒÆ ﬁ ½ İı 漢字 👍", "ſtraße", ""):
        assert len(lexicon.fold(s)) == len(s)
    assert lexicon.fold("ÀÉîõü") == "aeiou"
    df = frame(spark, [(1, "É x é"), (2, None), (3, ""), (1, "é")], "id int, t string")
    got = lexicon.find_spans(df, "id", "t", lexicon.Lexicon([("é", "e")])).collect()
    assert sorted((r.id, r.place, r.start, r.end, r.name) for r in got) == [(1, 0, 0, 1, "e"), (1, 0, 0, 1, "e"), (1, 1, 4, 5, "e")]
    assert lexicon.find_spans(df, "id", "t", lexicon.Lexicon([])).count() == 0
    assert sorted((r.id, r.f) for r in lexicon.folded(df, "t", "f").where("f is not null").collect()) == [(1, "e"), (1, "e x e"), (3, "")]


# admission


def plain_admission(rows, least=0.85, size=128, long_text=150_000):
    told, copies, kept = [], set(), []
    for i, copy, sketch, n in rows:
        if copy in copies:
            told.append((i, False, "exact_dup"))
            continue
        best = 0.0
        for other in kept:
            union = sorted(set(sketch) | set(other))[: max(len(sketch), len(other)) and min(size, max(len(sketch), len(other)))]
            both = [h for h in union if h in set(sketch) and h in set(other)]
            best = max(best, len(both) / len(union) if union else 0.0)
        over, long = best >= least, n > long_text
        if over and not long:
            told.append((i, False, "near_dup"))
            continue
        copies.add(copy)
        kept.append(sketch)
        told.append((i, True, "partial_kept" if over else "novel"))
    return sorted(told)


def test_admission_is_in_order_and_not_transitive(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(400)]
    texts = []
    step = list(base)
    for _ in range(12):  # a chain: neighbours alike, far ones not
        texts.append(" ".join(step))
        at = rnd.randrange(380)
        step[at : at + 4] = [rnd.choice(vocabulary) for _ in range(4)]
    for _ in range(120):  # a crowd around one text
        some = list(base)
        some[rnd.randrange(400)] = rnd.choice(vocabulary)
        texts.append(" ".join(some))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(20)] + [texts[3].upper(), texts[0], "", None, "  ", "short text", "Short  text", " ".join(base) + " tail"]
    rnd.shuffle(texts)
    df = frame(spark, list(enumerate(texts)), "id int, t string")
    rows = df.select("id", text.copy_key(F.coalesce("t", F.lit(""))).alias("c"), text.bottom_sketch(F.coalesce("t", F.lit(""))).alias("s"), F.coalesce(F.length("t"), F.lit(0)).alias("n")).orderBy("id").collect()
    for full in (64, 4):
        monkeypatch.setattr(admission, "FULL", full)
        for long_text in (150_000, 2_300):
            got = admission.admit(df, "id", "t", [], long_text=long_text).collect()
            assert sorted((r.id, r.admitted, r.reason) for r in got) == plain_admission(rows, long_text=long_text)


def test_admission_by_another_order_and_empty(spark):
    same = "one two three four five six seven eight nine ten eleven"
    df = frame(spark, [(1, 9, same), (2, 1, same), (3, None, "else")], "id int, o int, t string")
    got = {r.id: r.reason for r in admission.admit(df, "id", "t", ["o"]).collect()}
    assert got == {1: "exact_dup", 2: "novel", 3: "novel"}
    assert admission.admit(df.limit(0), "id", "t", []).count() == 0


# search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    around = rng.standard_normal((40, 16))
    rows = [(i, (around[i % 40] + 0.4 * rng.standard_normal(16)).tolist(), i % 3, i) for i in range(3000)]
    rows += [(9001, None, 0, 1), (9002, [0.0] * 16, 0, 1), (9003, [1.0], 0, 1), (9004, [float("nan")] * 16, 0, 1), (9005, rows[0][1], 0, None)]
    return frame(spark, rows, "id int, v array<double>, label int, seen int")


def plain_top(rows, queries, k, same=False, seen=False):
    usable = [r for r in rows if r.v is not None and len(r.v) == 16 and np.isfinite(r.v).all() and any(r.v)]
    unit = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in usable}
    out = set()
    for q in queries:
        if q.id in unit:
            found = [(-round(float(unit[q.id] @ unit[r.id]), 6), r.id) for r in usable if r.id != q.id and (not same or r.label == q.label) and (not seen or (r.seen is not None and q.seen is not None and r.seen <= q.seen))]
            out |= {(q.id, i) for _, i in sorted(found)[:k]}
    return out


def test_search_is_exact_and_filters_inside_lists(spark, vectors, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS_AT_ONCE", 40)
    monkeypatch.setattr(retrieve, "QUERIES_AT_ONCE", 7)
    rows = vectors.collect()
    asked = [r for r in rows if r.id % 60 == 0 or r.id > 9000]
    queries = vectors.where("id % 60 = 0 or id > 9000")
    for more, plain in (({}, {}), ({"same": ["label"], "not_later": "seen"}, {"same": True, "seen": True})):
        got = {(r.query_id, r.id) for r in retrieve.cosine_top(queries, vectors, 8, "id", "v", **more).collect()}
        assert got == plain_top(rows, asked, 8, **plain)


def test_search_without_exactness_finds_most_in_few_lists(spark, vectors):
    queries = vectors.where("id % 10 = 0")
    rows = vectors.collect()
    right = plain_top(rows, [r for r in rows if r.id % 10 == 0], 8)
    got = {(r.query_id, r.id) for r in retrieve.cosine_top(queries, vectors, 8, "id", "v", exact=False).collect()}
    assert len(got & right) >= 0.9 * len(right)
    centres = retrieve.fit_centres(vectors, "v", 8)
    assert centres.probes < len(centres.centres) / 4


def test_search_of_nothing(spark, vectors):
    assert retrieve.cosine_top(vectors, vectors.limit(0), 3, "id", "v").count() == 0
    assert retrieve.cosine_top(vectors.limit(0), vectors, 3, "id", "v").count() == 0
    assert retrieve.cosine_top(vectors, vectors.where("id = 9002"), 3, "id", "v").count() == 0


# joins and graphs


def test_asof_over_spans_equals_one_series(spark):
    rnd = random.Random(5)
    day = lambda: DAY(2024, 1, 1) + dt.timedelta(days=rnd.randrange(900))
    left = frame(spark, [(i, rnd.choice("aab"), day()) for i in range(400)] + [(900, "a", None), (901, None, day())], "id int, k string, t date")
    right = frame(spark, [(rnd.choice("aac"), day(), float(i)) for i in range(60)], "k string, u date, v double")
    for how in ({}, {"strict": True}, {"forward": True}, {"forward": True, "strict": True}, {"within": F.expr("INTERVAL 20 DAYS")}):
        one, many = (sorted((r.id, str(r.u), r.v or 0) for r in pit.asof_join(left, right, ["k"], "t", "u", ["v"], span_days=s, **how).collect()) for s in (None, 30))
        assert one == many and len(one) == 402
    with pytest.raises(ValueError, match="prefix"):
        pit.asof_join(left, right.withColumnRenamed("u", "t"), ["k"], "t", "t", ["v"])


def test_asof_shares_one_key_among_tasks(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.expr("date_add(date'2000-01-01', cast(id % 7000 as int))").alias("t"), "id")
    right = spark.range(7_000).select(F.lit("hot").alias("k"), F.expr("date_add(date'2000-01-01', cast(id as int))").alias("u"), "id").withColumnRenamed("id", "v")
    joined = pit.asof_join(left, right, ["k"], "t", "u", ["v"])
    assert joined.where("v <> id % 7000").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)


def test_closure_of_a_long_chain_and_strong_components(spark):
    chain = frame(spark, [(k, k + 1) for k in range(12)] + [(None, 3), (3, None)], "src int, dst int")
    got = {r.node: r.depth for r in graph.reachable(chain, frame(spark, [(0,), (None,)], "node int")).collect()}
    assert got == {k: k for k in range(1, 13)}
    plan = graph.reachable(chain, frame(spark, [(0,)], "node int"), 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("g", "a"), ("a", "b")], "src string, dst string")
    assert {r.node: r.component for r in graph.strong_components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d"}
    assert sorted(r.node for r in graph.on_cycles(edges).collect()) == ["a", "b", "c", "d", "e", "f"]
    left = graph.without_back_edges(edges)
    assert sorted(map(tuple, left.collect())) == [("a", "b"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("g", "a")]
    assert graph.on_cycles(left).count() == 0
    assert graph.strong_components(edges.limit(0)).count() == 0


def test_decayed_peak_counts_strictly_earlier_events(spark):
    rows = frame(spark, [(1, "k", DAY(2024, 1, 1)), (2, "k", DAY(2024, 1, 11)), (3, "k", DAY(2024, 1, 21)), (4, "other", DAY(2024, 1, 1))], "id int, k string, day date")
    events = frame(spark, [("k", DAY(2024, 1, 1), 8.0), ("k", DAY(2024, 1, 1), float("nan")), ("k", DAY(2024, 1, 11), 1.0), ("k", DAY(2024, 1, 12), None)], "k string, at date, s double")
    got = {r.id: (r.peak, r.short) for r in windows.decayed_peak(rows, events, ["k"], "day", "at", "s", 10.0, "peak", short="short").collect()}
    assert got == {1: (None, None), 2: (pytest.approx(4.0), True), 3: (pytest.approx(2.0), False), 4: (None, None)}
    least = {r.id: r.peak for r in windows.decayed_peak(rows, events, ["k"], "day", "at", "s", 10.0, "peak", least=9.0).collect()}
    assert set(least.values()) == {None}


# validation and scores


def test_grouped_folds_keep_groups_whole_and_even(spark):
    rows = [(f"g{k}", k) for k in range(400)] + [("large", 1)] * 100 + [(None, 2)] * 5
    got = folds.grouped_folds(frame(spark, rows, "g string, v int"), ["g"], 4).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in of.values())
    sizes = [sum(r.fold == k for r in got) for k in range(4)]
    assert max(sizes) < 1.25 * min(sizes) and set(of["large"]) <= {0, 1, 2, 3}


def test_walk_forward_counts_straddling_groups(spark):
    rows = [("a", 1), ("b", 2), ("a", 3), ("c", 3), ("d", None)]
    got = {r.fold: r for r in folds.grouped_walk_forward(frame(spark, rows, "g string, y int"), ["g"], "y", 1).collect()}
    assert {k: (r.train_periods, r.train_rows, r.test_rows, r.test_groups, r.straddling) for k, r in got.items()} == {2: (1, 1, 1, 1, 0), 3: (2, 2, 2, 2, 1)}
    later = {r.fold: (r.train_periods, r.straddling) for r in folds.grouped_walk_forward(frame(spark, rows, "g string, y int"), ["g"], "y", 1, train_from=2).collect()}
    assert later == {3: (1, 0)}


def test_collapse_policies(spark):
    rows = [("a", 1, 2.0, 0.0), ("a", 2, 4.0, None), ("b", 1, 2.0, 1.0), ("b", 2, 8.0, 3.0), ("b", 3, None, 2.0), ("n", 1, 5.0, -1.0)]
    df = frame(spark, rows, "g string, at int, p double, w double")
    got = lambda policy: {r.g: r.p for r in folds.collapse(df, ["g"], "at", "p", policy, "w").collect()}
    assert got("latest") == {"a": 4.0, "b": None, "n": 5.0}
    assert got("mean") == {"a": 3.0, "b": 5.0, "n": 5.0}
    assert got("weighted_mean") == {"a": 3.0, "b": pytest.approx(26 / 6), "n": 5.0}
    with pytest.raises(ValueError):
        folds.collapse(df, ["g"], "at", "p", "median")


def test_permutation_is_the_same_on_any_partitioning(spark):
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(i) if i % 5 else None) for i in range(300)]
    df = frame(spark, rows, "id int, k string, v double")
    once, again = ({r.id: r.v for r in folds.permuted(x, ["k"], "v", "id", 7).collect()} for x in (df, df.repartition(13)))
    assert once == again and once != {i: v for i, _, v in rows}
    for key in ("a", "b", None):
        own = sorted(str(v) for _, k, v in rows if k == key)
        assert sorted(str(once[i]) for i, k, _ in rows if k == key) == own
    assert {r.id: r.v for r in folds.permuted(df, ["k"], "v", "id", 8).collect()} != once


def test_greedy_budget_skips_and_goes_on(spark):
    rows = [("k", 1, 10.0, 5.0), ("k", 2, 9.0, 6.0), ("k", 3, 1.0, 4.0), ("k", 4, 100.0, 50.0), ("k", 5, 3.0, 0.0), ("k", 6, None, 1.0), ("k", 7, 1.0, None), ("e", 8, 1.0, 11.0)]
    df = frame(spark, rows, "k string, id int, value double, cost double").withColumn("budget", F.lit(10.0))
    got = folds.greedy_budget(df, ["k"], "value", "cost", "budget", ["id"]).collect()
    assert [(r.id, r.spent) for r in sorted(got, key=lambda r: (r.spent, r.id))] == [(1, 5.0), (3, 9.0), (5, 9.0), (6, 10.0), (7, 10.0)]


def plain_fallback(rows, least):
    told = {}
    for i, a, b, at, v in rows:
        told[i] = (None, 0, None)
        for name, same in (("fine", lambda r: (r[1], r[2]) == (a, b)), ("wide", lambda r: r[1] == a)):
            prior = [r[4] for r in rows if same(r) and r[3] < at and r[4] is not None and r[4] == r[4]]
            if len(prior) >= least:
                x = np.array(prior)
                if len(x) >= 20:
                    x = np.clip(x, np.quantile(x, 0.05), np.quantile(x, 0.95))
                z = None if v is None or v != v or x.std() <= 1e-12 else max(-8.0, min(8.0, (v - x.mean()) / x.std()))
                told[i] = (name, len(prior), z)
                break
    return told


def test_fallback_takes_the_finest_level_that_suffices(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("xy"), rnd.choice("pqr"), DAY(2024, 1, 1) + dt.timedelta(days=i // 3), None if i % 11 == 0 else float("nan") if i % 13 == 0 else rnd.gauss(0, 1)) for i in range(150)] + [(500, "x", "p", DAY(2025, 1, 1), 1e9)]
    df = frame(spark, rows, "id int, a string, b string, at date, v double")
    right = plain_fallback(rows, 8)
    for r in scores.fallback_z(df, [("fine", ["a", "b"]), ("wide", ["a"])], "at", "v", 8).collect():
        level, n, z = right[r.id]
        assert (r.level, r.n_prior) == (level, n)
        assert r.z is None if z is None else r.z == pytest.approx(z)
    assert {r[0] for r in right.values()} == {None, "fine", "wide"}


def test_correlations_with_nulls_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(500)
    data = {"a": x + 1e6, "b": -x, "c": rng.standard_normal(500), "d": np.full(500, 3.0)}
    rows = [tuple(None if (k + i) % 9 == 0 and n == "b" else float(data[n][i]) for k, n in enumerate(data)) for i in range(500)]
    pairs = scores.correlations(frame(spark, rows, "a double, b double, c double, d double").repartition(5), list(data))
    got = {(r.a, r.b): (r.n, r.correlation) for r in pairs.collect()}
    kept = [i for i in range(500) if rows[i][1] is not None]
    assert got["a", "b"] == (len(kept), pytest.approx(-1.0)) and got["a", "d"][1] is None
    assert got["b", "c"][1] == pytest.approx(np.corrcoef(data["b"][kept], data["c"][kept])[0, 1])
    assert sorted((r.component, r.cluster, r.size) for r in scores.clusters(pairs, 0.9).collect()) == [("a", "a", 2), ("b", "a", 2)]


def test_average_precision_over_ranges(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("ab"), i, rnd.randrange(40) / 40, rnd.random() < 0.3) for i in range(500)]
    got = {r.k: r.average_precision for r in evaluate.average_precision(frame(spark, rows, "k string, id int, s double, y boolean"), ["k"], "s", F.col("y"), "id", parts=9).collect()}
    for k in "ab":
        ranked = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        hits, shares = 0, []
        for n, r in enumerate(ranked, 1):
            hits += r[3]
            shares += [hits / n] if r[3] else []
        assert got[k] == pytest.approx(np.mean(shares))


# small ones


def test_front_answers_only_if_every_month_has_the_metric(spark):
    day = DAY(2024, 3, 10)
    rows = [("oi", day, "2024-05", 1.0, ""), ("oi", day, "2024-07", None, ""), ("oi", day, "2024-01", None, ""), ("vol", day, "2024-05", None, "10"), ("cycle", day, "2024-05", None, ""), ("blank", day, "2024-05", 1.0, " "), ("past", day, "2024-01", 1.0, ""), ("unknown", day, "2024-05", 1.0, "")]
    got = {r.slug: (r.n_eligible, r.n_missing, r.answers) for r in prices.front_inputs(frame(spark, rows, "slug string, trade_date date, contract_month string, oi double, vol string"), {"oi": "oi", "vol": "vol", "cycle": None, "blank": "vol", "past": "oi", "lacking": "none"}).collect()}
    assert got == {"oi": (2, 1, False), "vol": (1, 0, True), "cycle": (1, 0, True), "blank": (1, 1, False), "past": (0, 0, False), "unknown": (1, 1, False)}


def test_group_digests(spark):
    digest = lambda rows: {r.k: r.digest for r in conform.group_digest(frame(spark, rows, "k string, a string, b int"), ["k"], ["a", "b"]).collect()}["k"]
    base = [("k", "x", 1), ("k", "y", None), ("k", "x", 1)]
    assert digest(base) == digest(base[::-1]) != digest(base[:2])
    assert len({digest([("k", "", 1)]), digest([("k", None, 1)]), digest([("k", "1", None)]), digest([("k", "x\x1f1", 1)])}) == 4


def test_statistics_of_long_series_and_new_ones(spark):
    one = frame(spark, [([1.0, 1.0, 3.0, 2.0, None, 4.0], ["a", "b", "c", "d", "e", "f"], [2.0, 8.0])], "v array<double>, l array<string>, o array<double>")
    row = one.select(S.compute("revision_count", F.col("v")).alias("n"), S.compute("revision_count", F.col("v"), "down").alias("d"), S.compute("ratio", F.col("v"), F.col("o"), 100.0).alias("r"), S.compute("expiry_spread", F.col("v"), F.col("l"), "a", "f").alias("s"), S.compute("expiry_spread", F.col("v"), F.col("l"), "a", "z").alias("none")).first()
    assert (row.n, row.d, row.r, row.s, row.none) == (3, 1, 50.0, 3.0, None)
    long = spark.range(20_000).agg(F.collect_list((F.col("id") % 17).cast("double")).alias("v"))
    got = long.select(S.compute("spread", F.col("v")).alias("s")).first().s
    assert got == pytest.approx(np.std([k % 17 for k in range(20_000)], ddof=1))
