"""Queries on series: prior statistics, trends, streaks, runs, named statistics, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import conform, evaluate, windows
from .base import DAILY, MONTHLY, daily, monthly, query, table

BY, AT = ["nation"], ["month"]
_W = "PARTITION BY nation ORDER BY month ROWS BETWEEN"
BANDS = [(1.0, "high"), (2.0, "extreme")]


def _z(frame: str, least: int, spread: str = "stddev_samp") -> str:
    return f"CASE WHEN COUNT(value) OVER ({_W} {frame}) >= {least} AND {spread}(value) OVER ({_W} {frame}) > 0 THEN ROUND((value - AVG(value) OVER ({_W} {frame})) / {spread}(value) OVER ({_W} {frame}), 6) END"


@query(f"WITH {MONTHLY} SELECT nation, month, {_z('12 PRECEDING AND 1 PRECEDING', 6)} AS z FROM monthly")
def trailing_z(spark, sf_dir):
    z = windows.z_score(monthly(spark, sf_dir), BY, AT, "value", "z", 12, 6)
    return z.select("nation", "month", F.round("z", 6).alias("z"))


@query(f"WITH {MONTHLY} SELECT nation, month, {_z('7 PRECEDING AND CURRENT ROW', 8, 'stddev_pop')} AS z FROM monthly")
def rolling_z_inclusive(spark, sf_dir):
    z = windows.z_score(monthly(spark, sf_dir), BY, AT, "value", "z", 8, 8, current=True, population=True)
    return z.select("nation", "month", F.round("z", 6).alias("z"))


@query(f"WITH {MONTHLY} SELECT nation, month, {_z('UNBOUNDED PRECEDING AND 1 PRECEDING', 8, 'stddev_pop')} AS z FROM monthly")
def expanding_z(spark, sf_dir):
    z = windows.z_score(monthly(spark, sf_dir), BY, AT, "value", "z", None, 8, population=True)
    return z.select("nation", "month", F.round("z", 6).alias("z"))


@query(f"WITH {MONTHLY}, t AS (SELECT *, year(month) * 12 + month(month) AS x FROM monthly), l AS (SELECT *, regr_slope(value, x) OVER w * x + regr_intercept(value, x) OVER w AS line, COUNT(value) OVER w AS c FROM t WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT nation, month, CASE WHEN c >= 5 AND abs(line) > 1e-9 THEN ROUND((value - line) / abs(line), 4) END AS deviation FROM l")
def trend_deviation(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("x", F.year("month") * 12 + F.month("month"))
    return windows.trend_deviation(rows, BY, AT, "x", "value", "d", 5).select("nation", "month", F.round("d", 4).alias("deviation"))


@query(f"WITH {MONTHLY}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY month) AS k FROM monthly) SELECT a.nation, a.month, CASE WHEN COUNT(b.value) >= 6 THEN ROUND(AVG(CASE WHEN b.value <= a.value THEN 1.0 ELSE 0.0 END), 6) END AS share FROM r a LEFT JOIN r b ON a.nation = b.nation AND b.k BETWEEN a.k - 24 AND a.k - 1 GROUP BY a.nation, a.month")
def prior_percentile(spark, sf_dir):
    p = windows.prior_share_below(monthly(spark, sf_dir), BY, AT, "value", "share", 24, 6)
    return p.select("nation", "month", F.round("share", 6).alias("share"))


@query(f"WITH {MONTHLY}, p AS (SELECT *, CASE WHEN COUNT(value) OVER w >= 6 THEN quantile_cont(value, 0.2) OVER w END AS q FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)), f AS (SELECT *, COALESCE(value < q, false) AS dry FROM p), g AS (SELECT *, SUM(CASE WHEN dry THEN 0 ELSE 1 END) OVER (PARTITION BY nation ORDER BY month) AS g FROM f), n AS (SELECT nation, g, SUM(CASE WHEN dry THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2) SELECT nation, CAST(MAX(n) AS INTEGER) AS longest FROM n GROUP BY 1")
def longest_dry_run(spark, sf_dir):
    rows = windows.prior_quantile(monthly(spark, sf_dir), BY, AT, "value", "q", 24, 6, 0.2)
    return windows.longest_run(rows, BY, AT, F.col("value") < F.col("q"), "longest")


@query(f"WITH {MONTHLY}, d AS (SELECT *, value - LAG(value) OVER (PARTITION BY nation ORDER BY month) AS d1, n - LAG(n) OVER (PARTITION BY nation ORDER BY month) AS d2 FROM monthly), c AS (SELECT nation, month, corr(CAST(d1 AS DOUBLE), CAST(d2 AS DOUBLE)) OVER w AS c, COUNT(d1) OVER w AS k, stddev_pop(d1) OVER w AS s1, stddev_pop(CAST(d2 AS DOUBLE)) OVER w AS s2 FROM d WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT nation, month, CASE WHEN k >= 6 AND s1 > 0 AND s2 > 0 THEN ROUND(c, 6) END AS c FROM c")
def rolling_correlation(spark, sf_dir):
    rows = windows.change(windows.change(monthly(spark, sf_dir), BY, AT, "value", "d1"), BY, AT, "n", "d2").withColumn("d2", F.col("d2").cast("double"))
    return windows.rolling_correlation(rows, BY, AT, "d1", "d2", "c", 12, 6).select("nation", "month", F.round("c", 6).alias("c"))


_DELTAS = f"{MONTHLY}, d AS (SELECT nation, month, n - LAG(n) OVER (PARTITION BY nation ORDER BY month) AS d FROM monthly), s AS (SELECT *, CAST(COALESCE(sign(d), 0) AS INTEGER) AS s FROM d)"


def _deltas(spark, sf_dir):
    return windows.change(monthly(spark, sf_dir), BY, AT, "n", "d")


@query(f"WITH {_DELTAS}, m AS (SELECT *, CASE WHEN s = COALESCE(LAG(s) OVER (PARTITION BY nation ORDER BY month), 9) THEN 0 ELSE 1 END AS brk FROM s), g AS (SELECT *, SUM(brk) OVER (PARTITION BY nation ORDER BY month) AS g FROM m) SELECT nation, month, CAST(s * COUNT(*) OVER (PARTITION BY nation, g ORDER BY month) AS INTEGER) AS streak FROM g")
def streak_zero_ends(spark, sf_dir):
    return windows.streak(_deltas(spark, sf_dir), BY, AT, "d", "streak", "zero_ends").select("nation", "month", "streak")


@query(f"WITH {_DELTAS}, z AS (SELECT *, LAST_VALUE(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s), m AS (SELECT *, CASE WHEN s <> 0 AND s <> COALESCE(p, 0) THEN 1 ELSE 0 END AS brk FROM z), g AS (SELECT *, SUM(brk) OVER (PARTITION BY nation ORDER BY month) AS g FROM m) SELECT nation, month, CAST(SUM(s) OVER (PARTITION BY nation, g ORDER BY month) AS INTEGER) AS streak FROM g")
def streak_skip_zero(spark, sf_dir):
    return windows.streak(_deltas(spark, sf_dir), BY, AT, "d", "streak", "skip_zero").select("nation", "month", "streak")


@query(f"WITH {_DELTAS}, g AS (SELECT *, SUM(CASE WHEN s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nation ORDER BY month) AS g FROM s) SELECT nation, month, CAST(SUM(CASE WHEN s <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nation, g ORDER BY month) AS INTEGER) AS streak FROM g")
def streak_reset(spark, sf_dir):
    return windows.streak(_deltas(spark, sf_dir), BY, AT, "d", "streak", "reset").select("nation", "month", "streak")


@query("WITH g AS (SELECT *, SUM(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), n AS (SELECT user_id, g, SUM(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1, 2) SELECT user_id, CAST(MAX(n) AS INTEGER) AS longest FROM n GROUP BY 1")
def longest_low_run(spark, sf_dir):
    return windows.longest_run(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 50, "longest")


@query(f"WITH {MONTHLY}, s AS (SELECT nation, year(month) AS season, month(month) AS slot, value FROM monthly) SELECT nation, CAST(season AS INTEGER) AS season, CAST(slot AS INTEGER) AS slot, CASE WHEN COUNT(value) OVER w >= 2 THEN ROUND((value - AVG(value) OVER w) / abs(AVG(value) OVER w), 6) END AS slot_change, CASE WHEN COUNT(value) OVER w >= 2 AND stddev_samp(value) OVER w > 0 THEN ROUND((value - AVG(value) OVER w) / stddev_samp(value) OVER w, 4) END AS slot_z FROM s WINDOW w AS (PARTITION BY nation, slot ORDER BY season RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def same_slot_prior_seasons(spark, sf_dir):
    rows = monthly(spark, sf_dir).select("nation", F.year("month").alias("season"), F.month("month").alias("slot"), "value")
    rows = windows.prior_seasons(rows, BY, "season", "slot", "value", 3, 2)
    return rows.select("nation", "season", "slot", F.round("slot_change", 6).alias("slot_change"), F.round("slot_z", 4).alias("slot_z"))


@query(f"WITH {DAILY} SELECT day, SUM(quantity) OVER (PARTITION BY year(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS to_date FROM daily")
def cumulative_to_date(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("year", F.year("day"))
    return windows.cumulative(rows, ["year"], ["day"], "quantity", "to_date").select("day", "to_date")


@query("WITH d AS (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS d FROM events), b AS (SELECT *, CASE WHEN date_diff('day', LAG(d) OVER (PARTITION BY user_id, event_type ORDER BY d), d) <= 2 THEN 0 ELSE 1 END AS brk FROM d), e AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id, event_type ORDER BY d) AS episode FROM b) SELECT user_id, event_type, CAST(episode AS INTEGER) AS episode, MIN(d) AS first_date, MAX(d) AS last_date, COUNT(*) AS n_events FROM e GROUP BY 1, 2, 3")
def episodes_by_gap(spark, sf_dir):
    days = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("d")).distinct()
    return windows.episodes(days, ["user_id", "event_type"], "d", 2)


@query("WITH RECURSIVE days AS (SELECT DISTINCT user_id AS u, CAST(ts AS DATE) AS d FROM events), walk(u, d, n) AS (SELECT u, MIN(d), 1 FROM days GROUP BY 1 UNION ALL SELECT u, nx, n + 1 FROM (SELECT w.u, w.n, (SELECT MIN(x.d) FROM days x WHERE x.u = w.u AND x.d >= w.d + 7) AS nx FROM walk w) q WHERE nx IS NOT NULL) SELECT u AS user_id, CAST(MAX(n) AS INTEGER) AS n_windows FROM walk GROUP BY 1")
def independent_windows(spark, sf_dir):
    return windows.independent_windows(table(spark, sf_dir, "events"), ["user_id"], "ts", 7, "n_windows")


@query("SELECT a.event_id, ROUND(MAX(b.value * pow(0.5, date_diff('day', CAST(b.ts AS DATE), CAST(a.ts AS DATE)) / 3.0)), 6) AS peak FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND CAST(b.ts AS DATE) < CAST(a.ts AS DATE) AND b.event_type = 'error' AND b.value > 0 AND NOT isnan(b.value) GROUP BY 1")
def decayed_peak(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = windows.decayed_peak(events.select("event_id", "user_id", "ts"), events.where("event_type = 'error'"), ["user_id"], "ts", "ts", "value", 3.0, "peak")
    return found.select("event_id", F.round("peak", 6).alias("peak"))


@query(f"WITH {DAILY}, r AS (SELECT *, ln(revenue / LAG(revenue) OVER (ORDER BY day)) AS lr, revenue / LAG(revenue, 60) OVER (ORDER BY day) - 1 AS momentum FROM daily), v AS (SELECT *, CASE WHEN COUNT(lr) OVER w >= 15 THEN stddev_samp(lr) OVER w * sqrt(252) END AS vol FROM r WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), q AS (SELECT *, quantile_cont(vol, 0.75) OVER (ORDER BY day ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS q FROM v) SELECT day, ROUND(vol, 6) AS volatility, ROUND(momentum, 6) AS momentum, CAST(COALESCE(vol > q, false) AS INTEGER) AS high_volatility FROM q")
def volatility_momentum(spark, sf_dir):
    from ..operators.prices import volatility_momentum as measure

    rows = measure(daily(spark, sf_dir).withColumn("slug", F.lit("all")), ["slug"], "day", "revenue", 30, 15, 60, 252)
    return rows.select("day", F.round("volatility", 6).alias("volatility"), F.round("momentum", 6).alias("momentum"), "high_volatility")


@query(f"WITH {MONTHLY}, z AS (SELECT nation, month, {_z('12 PRECEDING AND 1 PRECEDING', 6)} AS z FROM monthly) SELECT nation, month, z, CASE WHEN z >= 2 THEN 'extreme' WHEN z >= 1 THEN 'high' WHEN z IS NOT NULL THEN 'normal' END AS band FROM z")
def regime_bands(spark, sf_dir):
    return trailing_z(spark, sf_dir).withColumn("band", conform.band(F.col("z"), BANDS, "normal"))


def _arrays(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("month", F.col("value").alias("v"), F.col("n").cast("double").alias("n"))))
    return monthly(spark, sf_dir).groupBy("nation").agg(pairs.alias("p")).select("nation", F.transform("p", lambda x: x["v"]).alias("v"), F.transform("p", lambda x: x["n"]).alias("n"))


_LISTS = f"{MONTHLY}, l AS (SELECT nation, list(value ORDER BY month) AS v, list(CAST(n AS DOUBLE) ORDER BY month) AS n FROM monthly GROUP BY 1)"


@query(f"WITH {_LISTS} SELECT nation, v[-1] AS latest, ROUND((v[-1] - list_avg(v)) / list_stddev_pop(v), 6) AS zscore, ROUND(CAST(len(list_filter(v[:-2], lambda x: x <= v[-1])) AS DOUBLE) / (len(v) - 1), 6) AS percentile, ROUND(v[-1] - v[-2], 2) AS delta, ROUND((v[-1] - v[-13]) / abs(v[-13]), 6) AS pace, ROUND(v[-1] - v[-4], 2) AS window_change, ROUND(v[-1] / list_max(v) - 1, 6) AS drawdown, ROUND(list_avg(v), 2) AS mean, ROUND(list_stddev_samp(v), 2) AS spread FROM l")
def named_statistics(spark, sf_dir):
    v = F.col("v")
    got = lambda name, digits, *more: F.round(S.compute(name, v, *more), digits).alias(name)
    return _arrays(spark, sf_dir).select("nation", S.compute("latest", v).alias("latest"), got("zscore", 6), got("percentile", 6), got("delta", 2), got("pace", 6, 12), got("window_change", 2, 3), got("drawdown", 6), got("mean", 2), got("spread", 2))


@query(f"WITH {_LISTS} SELECT nation, ROUND(quantile_cont(value, 0.25), 2) AS q25, ROUND(quantile_cont(value, 0.5), 2) AS q50, ROUND(quantile_cont(value, 0.75), 2) AS q75, MIN(value) AS low, CAST(list_position(ANY_VALUE(v), MIN(value)) - 1 AS BIGINT) AS low_at, MAX(value) AS high, CAST(list_position(ANY_VALUE(v), MAX(value)) - 1 AS BIGINT) AS high_at FROM monthly JOIN l USING (nation) GROUP BY nation")
def quantiles_extremes(spark, sf_dir):
    v = F.col("v")
    rows = _arrays(spark, sf_dir).select("nation", S.compute("quantiles", v).alias("q"), S.compute("extremes", v).alias("e"))
    return rows.select("nation", *(F.round(F.get("q", F.lit(k)), 2).alias(f"q{s}") for k, s in enumerate((25, 50, 75))), "e.low", "e.low_at", "e.high", "e.high_at")


@query(f"WITH {_LISTS}, z AS (SELECT nation, month, {_z('12 PRECEDING AND 1 PRECEDING', 6)} AS z, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY month) - 1 AS i, COUNT(*) OVER (PARTITION BY nation) AS k FROM monthly) SELECT nation, CAST(COUNT(*) FILTER (WHERE z >= 1) AS INTEGER) AS total, CAST(COUNT(*) FILTER (WHERE z >= 1 AND i >= k - 4) AS INTEGER) AS in_window, CAST(MAX(k) - 1 - MAX(i) FILTER (WHERE z >= 1) AS INTEGER) AS since FROM z GROUP BY 1")
def flag_events(spark, sf_dir):
    flagged = trailing_z(spark, sf_dir).groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("month", F.coalesce(F.col("z") >= 1, F.lit(False)).cast("double").alias("f")))).alias("p"))
    rows = flagged.select("nation", S.compute("flag_events", F.transform("p", lambda x: x["f"])).alias("s"))
    return rows.select("nation", "s.total", "s.in_window", F.col("s.since").cast("int").alias("since"))


@query(f"WITH {MONTHLY}, s AS (SELECT nation, sign(value - LAG(value) OVER w) AS a, sign(n - LAG(n) OVER w) AS b FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month)) SELECT nation, ROUND(AVG(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM s WHERE a IS NOT NULL GROUP BY 1")
def sign_agreement(spark, sf_dir):
    return _arrays(spark, sf_dir).select("nation", F.round(S.compute("sign_agreement", F.col("v"), F.col("n")), 6).alias("agreement"))


@query("WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS fold, COUNT(*) AS test_rows FROM orders GROUP BY 1), f AS (SELECT fold, MIN(fold) OVER w AS train_from, MAX(fold) OVER w AS train_to, COUNT(*) OVER w AS train_periods, CAST(SUM(test_rows) OVER w AS BIGINT) AS train_rows, test_rows FROM y WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM f WHERE train_periods >= 2")
def walk_forward_folds(spark, sf_dir):
    return evaluate.walk_forward(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), "year", 2)


@query(f"WITH {MONTHLY}, p AS (SELECT *, LAG(value) OVER (PARTITION BY nation ORDER BY month) AS before, AVG(value) OVER (PARTITION BY nation ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS predicted FROM monthly), e AS (SELECT *, predicted - value AS e, sign(value - before) * sign(predicted - before) AS m FROM p) SELECT nation, COUNT(e) AS n, ROUND(sqrt(AVG(e * e)), 2) AS rmse, ROUND(AVG(abs(e)), 2) AS mae, ROUND(AVG(e), 2) AS bias, ROUND(AVG(CASE WHEN m <> 0 THEN CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END END), 6) AS direction FROM e GROUP BY 1")
def baseline_errors(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("nation").orderBy("month")
    rows = monthly(spark, sf_dir).withColumns({"before": F.lag("value").over(w), "predicted": F.avg("value").over(w.rowsBetween(-3, -1))})
    e = evaluate.errors(rows, BY, "value", "predicted", "before")
    return e.select("nation", "n", *(F.round(c, 2).alias(c) for c in ("rmse", "mae", "bias")), F.round("direction", 6).alias("direction"))


_SCORED = "s AS (SELECT doc_id, lang, LEAST(n_chars / 10000.0, 1.0) AS score, quality FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("score"))
    return documents.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(f"WITH {_SCORED}, r AS (SELECT *, SUM(quality) OVER w / CAST(ROW_NUMBER() OVER w AS DOUBLE) AS p FROM s WINDOW w AS (PARTITION BY lang ORDER BY score DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT lang, COUNT(*) AS n, CAST(SUM(quality) AS BIGINT) AS n_positive, ROUND(AVG(CASE WHEN quality = 1 THEN p END), 6) AS average_precision, ROUND(AVG(quality), 6) AS base_rate FROM r GROUP BY 1")
def average_precision(spark, sf_dir):
    rows = evaluate.average_precision(_scored(spark, sf_dir), ["lang"], "score", F.col("quality") == 1, "doc_id")
    return rows.select("lang", "n", "n_positive", F.round("average_precision", 6).alias("average_precision"), F.round("base_rate", 6).alias("base_rate"))


@query(f"WITH {_SCORED}, l AS (SELECT lang, quantile_cont(score, 0.9) AS lim FROM s GROUP BY 1), c AS (SELECT s.*, CASE WHEN score >= lim THEN 1.0 ELSE 0.0 END AS c FROM s JOIN l USING (lang)) SELECT lang, CAST(SUM(c) AS BIGINT) AS n_chosen, ROUND(SUM(c * quality) / SUM(c), 6) AS precision, ROUND(SUM(c * quality) / SUM(quality), 6) AS recall FROM c GROUP BY 1")
def precision_top_share(spark, sf_dir):
    rows = evaluate.precision_at_share(_scored(spark, sf_dir), ["lang"], "score", F.col("quality") == 1, 0.1)
    return rows.select("lang", "n_chosen", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_SCORED}, t AS (SELECT lang, t.threshold, SUM(CASE WHEN score >= t.threshold THEN quality ELSE 0 END) AS tp, SUM(CASE WHEN score >= t.threshold THEN 1 ELSE 0 END) AS chosen, SUM(quality) AS pos FROM s, (VALUES (0.02), (0.1), (0.2), (0.4)) t(threshold) GROUP BY 1, 2), f AS (SELECT *, COALESCE(5.0 * tp / NULLIF(4.0 * pos + chosen, 0), 0) AS f FROM t) SELECT lang, CAST(threshold AS DOUBLE) AS threshold, ROUND(f, 6) AS f_score FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY f DESC, threshold) = 1")
def best_f2_threshold(spark, sf_dir):
    rows = evaluate.best_threshold(_scored(spark, sf_dir), ["lang"], "score", F.col("quality") == 1, [0.02, 0.1, 0.2, 0.4], 2.0)
    return rows.select("lang", "threshold", F.round("f_score", 6).alias("f_score"))


@query(f"WITH {MONTHLY}, z AS (SELECT nation, month, {_z('12 PRECEDING AND 1 PRECEDING', 6)} AS z FROM monthly) SELECT nation, month, COALESCE(z > 0, false) AND SUM(CASE WHEN z > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY nation, year(month) ORDER BY month ROWS UNBOUNDED PRECEDING) >= 3 AS persistent_alert FROM z")
def persistent_alerts(spark, sf_dir):
    return evaluate.persistent(trailing_z(spark, sf_dir).withColumn("year", F.year("month")), [*BY, "year"], "month", F.col("z") > 0, 3).select("nation", "month", "persistent_alert")


_PAIRS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(corr({a}, {b}), 4) AS correlation FROM lineitem" for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1 :]) + ") ORDER BY abs(correlation) DESC, a, b LIMIT 1")
def correlated_pairs(spark, sf_dir):
    return evaluate.correlated_pairs(table(spark, sf_dir, "lineitem"), _PAIRS, 1, 4)
