"""Queries on tables: scans, contracts, conforming, joins, vintages, metrics, prices, features, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import budget, conform, features, graph, metric, pit, prices, quality
from ..sources import scans
from .base import CURVE, MONTHLY, curve, monthly, query, table
from .series_queries import trailing_z


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-02-01' AND l_returnflag = 'R'")
def scan_filter(spark, sf_dir):
    where = (F.col("l_shipdate") >= "1996-01-01") & (F.col("l_shipdate") < "1996-02-01") & (F.col("l_returnflag") == "R")
    rows = scans.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "no_such_column"], where)
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


LINES = quality.Contract({"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_discount": "double"}, ("l_orderkey", "l_linenumber"), ("l_quantity",), {"l_quantity": (1, 40), "l_discount": (0, 0.08)})


@query("SELECT 'null:l_orderkey' AS \"check\", COUNT(*) FILTER (WHERE l_orderkey IS NULL) AS n_rows FROM lineitem UNION ALL SELECT 'null:l_linenumber', COUNT(*) FILTER (WHERE l_linenumber IS NULL) FROM lineitem UNION ALL SELECT 'null:l_quantity', COUNT(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem UNION ALL SELECT 'range:l_quantity', COUNT(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 40) FROM lineitem UNION ALL SELECT 'range:l_discount', COUNT(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08) FROM lineitem UNION ALL SELECT 'rows', COUNT(*) FROM lineitem UNION ALL SELECT 'duplicate_keys', COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem")
def contract_report(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "lineitem"), LINES)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", COUNT(*) AS n_rows, COUNT({c}) AS n_values, CAST(MIN({c}) AS VARCHAR) AS low, CAST(MAX({c}) AS VARCHAR) AS high, MIN({c}) = MAX({c}) AS constant FROM events" for c in ("event_id", "user_id", "event_type")))
def column_census(spark, sf_dir):
    return quality.census(table(spark, sf_dir, "events"), ["event_id", "user_id", "event_type"])


@query("SELECT p_type AS g, 'cheap' AS \"column\", ROUND(AVG(CASE WHEN p_retailprice < 1200 THEN 0.0 ELSE 1.0 END), 6) AS null_rate FROM part GROUP BY 1 UNION ALL SELECT p_type, 'small', ROUND(AVG(CASE WHEN p_size < 10 THEN 0.0 ELSE 1.0 END), 6) FROM part GROUP BY 1")
def missing_rates(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("g"), F.when(F.col("p_retailprice") < 1200, 1).alias("cheap"), F.when(F.col("p_size") < 10, 1).alias("small"))
    return quality.missing_rates(parts, ["g"], ["cheap", "small"]).withColumn("null_rate", F.round("null_rate", 6))


@query("WITH d AS (SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, COUNT(DISTINCT CAST(l_shipdate AS DATE)) AS n_days FROM lineitem GROUP BY 1, 2) SELECT * FROM d WHERE n_days = day(last_day(month))")
def complete_months(spark, sf_dir):
    return quality.complete_months(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_shipdate")


@query("SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt_long(spark, sf_dir):
    return conform.melt(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def melt_widen_roundtrip(spark, sf_dir):
    return conform.widen(melt_long(spark, sf_dir), ["p_partkey"], "variable", "value", ["p_size", "p_retailprice"])


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value * 0.5 WHEN event_type = 'view' THEN value * 2.0 END AS converted FROM events")
def convert_units(spark, sf_dir):
    return conform.convert_units(table(spark, sf_dir, "events"), "event_type", "value", {"click": 0.5, "view": 2.0}, "converted").select("event_id", "converted")


@query("SELECT p_partkey, CASE WHEN p_size NOT IN (1, 50) THEN p_size END AS p_size FROM part")
def scrub_sentinels(spark, sf_dir):
    return conform.scrub(table(spark, sf_dir, "part"), "p_size", [1, 50]).select("p_partkey", "p_size")


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def dedup_latest(spark, sf_dir):
    return conform.dedup_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT c_nationkey, c_mktsegment, COUNT(*) AS n_rows, COUNT(DISTINCT CAST(c_acctbal > 0 AS VARCHAR)) AS n_versions, MIN(c_acctbal > 0) AS in_credit FROM customer GROUP BY 1, 2")
def dedup_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("in_credit", F.col("c_acctbal") > 0)
    return conform.collapse(rows, ["c_nationkey", "c_mktsegment"], ["in_credit"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderkey) = 1")
def preference_rank(spark, sf_dir):
    return conform.prefer(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT p_brand, p_size, COUNT(*) AS n FROM part WHERE (p_brand, p_size) IN (SELECT DISTINCT p_brand, p_size FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)) GROUP BY 1, 2")
def admitted(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    dear = parts.agg(F.avg("p_retailprice").alias("mean"))
    registry = parts.join(F.broadcast(dear)).where("p_retailprice > mean").select("p_brand", "p_size").distinct()
    return conform.admit(parts, registry, ["p_brand", "p_size"]).groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_retailprice > (SELECT AVG(p_retailprice) FROM part) AND q.p_brand = part.p_brand AND q.p_size = part.p_size)")
def declined(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    dear = parts.agg(F.avg("p_retailprice").alias("mean"))
    registry = parts.join(F.broadcast(dear)).where("p_retailprice > mean").select("p_brand", "p_size").distinct()
    return conform.decline(parts, registry, ["p_brand", "p_size"]).select("p_partkey", "p_brand")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_entities(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return quality.missing(table(spark, sf_dir, "nation").select("n_nationkey"), suppliers, ["n_nationkey"])


@query("SELECT 'full' AS side, c_custkey AS key FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000) UNION ALL SELECT 'truncated', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_parity(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    b = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("key")).distinct()
    return pit.differences(a, b)


_HALVES = "a AS (SELECT o_custkey AS k, ROUND(SUM(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, ROUND(SUM(o_totalprice), 2) AS v FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)"


@query(f"WITH {_HALVES} SELECT COALESCE(a.k, b.k) AS k, CASE WHEN a.v IS NULL THEN 'right_only' WHEN b.v IS NULL THEN 'left_only' WHEN abs(a.v - b.v) <= 0.01 THEN 'matched' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.k = b.k")
def reconcile_outer(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    total = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return conform.reconcile(total(orders.where("o_orderstatus <> 'F'")), total(orders.where("o_orderpriority <> '1-URGENT'")), ["k"], "v", 0.01).select("k", "status")


@query("SELECT r_name, n_name, c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def tier_rollup(spark, sf_dir):
    orders, customers, nations, regions = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return features.tiers(joined, ["r_name", "n_name", "c_mktsegment"], "o_totalprice").select("r_name", "n_name", "c_mktsegment", F.col("n_rows").alias("n_orders"), F.round("total", 2).alias("value"))


@query("WITH c AS (SELECT n_regionkey AS basin, n_nationkey, AVG(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT basin, COUNT(*) AS n_cells, ROUND(AVG(v), 4) AS mean, ROUND(AVG(CASE WHEN v >= 4500 THEN 1.0 ELSE 0.0 END), 6) AS tail_share FROM c GROUP BY 1 HAVING COUNT(*) >= 2")
def basin_tail_share(spark, sf_dir):
    customers, nations = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    cells = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("basin"), "n_nationkey").agg(F.avg("c_acctbal").alias("v"))
    return features.tail_shares(cells, ["basin"], "v", 4500, 2).withColumns({"mean": F.round("mean", 4), "tail_share": F.round("tail_share", 6)})


@query("WITH s AS (SELECT n_name, year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS season, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT MAX(d) AS seen FROM s) SELECT n_name, CAST(s.season AS INTEGER) AS season, CASE WHEN ANY_VALUE(seen) >= make_date(s.season + 1, 2, 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY THEN ROUND(AVG(v) FILTER (WHERE month(d) >= 11 OR month(d) <= 2), 4) END AS stage_mean FROM s, m GROUP BY n_name, s.season")
def stage_window(spark, sf_dir):
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    seen = orders.agg(F.max(F.to_date("o_orderdate")).alias("seen"))
    inside = F.when(dates.month_in_window(F.month("d"), 11, 2), F.col("v"))
    grouped = rows.groupBy("n_name", dates.crop_year(F.col("d"), 9).alias("season")).agg(F.avg(inside).alias("mean")).join(F.broadcast(seen))
    return grouped.select("n_name", "season", F.when(F.col("seen") >= dates.stage_end(F.col("season"), 9, 2), F.round("mean", 4)).alias("stage_mean"))


_ASOF = "SELECT e.event_id, p.ts AS purchase_ts, p.value AS purchase_value FROM events e ASOF LEFT JOIN (SELECT user_id, ts, MAX(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts {} p.ts"


def _purchases(spark, sf_dir, **how):
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return pit.asof_join(events.select("event_id", "user_id", F.col("ts").alias("at")), bought, ["user_id"], "at", "ts", ["value"], prefix="purchase_", **how).select("event_id", "purchase_ts", "purchase_value", "at")


@query(_ASOF.format(">="))
def asof_backward(spark, sf_dir):
    return _purchases(spark, sf_dir).drop("at")


@query(_ASOF.format(">"))
def asof_strict(spark, sf_dir):
    return _purchases(spark, sf_dir, strict=True).drop("at")


@query(_ASOF.format("<="))
def asof_forward(spark, sf_dir):
    return _purchases(spark, sf_dir, forward=True).drop("at")


@query(f"WITH a AS ({_ASOF.format('>=').replace('e.event_id,', 'e.event_id, e.ts,')}) SELECT event_id, CASE WHEN purchase_ts >= ts - INTERVAL 2 DAY THEN purchase_ts END AS purchase_ts, CASE WHEN purchase_ts >= ts - INTERVAL 2 DAY THEN purchase_value END AS purchase_value FROM a")
def asof_within(spark, sf_dir):
    return _purchases(spark, sf_dir, within=F.expr("INTERVAL 2 DAYS")).drop("at")


_RELEASES = "r AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS period, CAST(o_orderdate AS DATE) AS known, o_totalprice AS v, o_orderkey FROM orders)"


def _releases(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("period"), F.to_date("o_orderdate").alias("known"), F.col("o_totalprice").alias("v"), "o_orderkey")


@query(f"WITH {_RELEASES} SELECT k, period, known, v FROM r WHERE known <= DATE '1997-06-30' QUALIFY ROW_NUMBER() OVER (PARTITION BY k, period ORDER BY known DESC, o_orderkey DESC) = 1")
def vintage_as_of(spark, sf_dir):
    return pit.latest_vintage(_releases(spark, sf_dir), ["k", "period"], "known", F.lit("1997-06-30").cast("date"), ["o_orderkey"]).select("k", "period", "known", "v")


@query(f"WITH {_RELEASES}, s AS (SELECT DISTINCT k, period, make_date(period, 10, 1) AS cutoff FROM r) SELECT s.k, s.period, arg_max(r.v, (r.known, r.o_orderkey)) AS prior_value, COUNT(r.v) AS n_releases FROM s LEFT JOIN r ON r.k = s.k AND r.period = s.period AND r.known <= s.cutoff GROUP BY 1, 2")
def prior_period_latest(spark, sf_dir):
    rows = _releases(spark, sf_dir)
    spine = rows.select("k", "period").distinct().withColumn("cutoff", F.make_date("period", F.lit(10), F.lit(1)))
    seen = pit.prior_periods(rows, spine, ["k"], "period", "known", "cutoff")
    return seen.groupBy("k", "period").agg(F.max_by("v", F.struct("known", "o_orderkey")).alias("prior_value"), F.count("v").alias("n_releases"))


@query(f"WITH {_RELEASES} SELECT o_orderkey, ROUND(v - LAG(v) OVER (PARTITION BY k, period ORDER BY known, o_orderkey), 4) AS revision FROM r")
def lag_revision(spark, sf_dir):
    rows = _releases(spark, sf_dir).withColumn("known", F.struct("known", "o_orderkey"))
    return pit.revision(rows, ["k", "period"], "known", "v", "revision").select("o_orderkey", F.round("revision", 4).alias("revision"))


@query(f"WITH {MONTHLY} SELECT nation, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS m, value FROM monthly WHERE last_day(month) + INTERVAL 20 DAY <= DATE '1996-05-15'")
def year_month_guard(spark, sf_dir):
    rows = monthly(spark, sf_dir).select("nation", F.year("month").alias("year"), F.month("month").alias("m"), "value")
    return rows.where(pit.known_by_month("year", "m", 20, F.lit("1996-05-15").cast("date")))


@query("WITH a AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS k, COUNT(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS k, COUNT(*) AS n FROM orders WHERE o_orderdate < DATE '1997-07-01' GROUP BY 1) SELECT k, n, 'full' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, n, 'truncated' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def truncated_inputs_differ(spark, sf_dir):
    """Years that a build on truncated inputs tells otherwise: those not over by then, and none before."""
    build = lambda orders: orders.groupBy(F.year("o_orderdate").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders")
    return pit.differences(build(orders), build(orders.where("o_orderdate < '1997-07-01'")))


CARD = metric.TableCard(("o_totalprice",), ("o_orderpriority",), "day", "data_date", lag_days=30, tiebreak=("o_orderkey",), expiry="o_orderstatus")
_ORDERS = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1997-12-31' - 30)"


def _metric(spark, sf_dir, agg, **more):
    rows = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return metric.compile_query(rows, CARD, metric.MetricQuery("o_totalprice", agg, "1997-12-31", **more))


@query(f"WITH {_ORDERS} SELECT ROUND(SUM(o_totalprice), 2) AS value, COUNT(o_totalprice) AS n_rows FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND day >= DATE '1996-01-01'")
def metric_sum(spark, sf_dir):
    return _metric(spark, sf_dir, "sum", scopes=(("o_orderpriority", ("1-URGENT", "2-HIGH")),), start="1996-01-01").withColumn("value", F.round("value", 2))


@query(f"WITH {_ORDERS} SELECT ROUND(AVG(o_totalprice), 4) AS value, COUNT(o_totalprice) AS n_rows FROM o")
def metric_mean(spark, sf_dir):
    return _metric(spark, sf_dir, "mean").withColumn("value", F.round("value", 4))


@query(f"WITH {_ORDERS} SELECT day, o_orderpriority, o_totalprice AS value FROM o WHERE o_orderpriority = '3-MEDIUM'")
def metric_series(spark, sf_dir):
    return _metric(spark, sf_dir, "series", scopes=(("o_orderpriority", ("3-MEDIUM",)),))


@query(f"WITH {_ORDERS} SELECT o_orderstatus, day, o_totalprice AS value FROM o QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY day DESC, o_orderkey DESC) = 1")
def metric_curve(spark, sf_dir):
    return _metric(spark, sf_dir, "curve")


@query(f"WITH {MONTHLY} SELECT month AS day, nation, value FROM monthly WHERE nation = (SELECT MIN(n_name) FROM nation) AND month <= DATE '1997-12-31' ORDER BY month DESC LIMIT 6")
def metric_newest(spark, sf_dir):
    first = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    card = metric.TableCard(("value",), ("nation",), "day", "data_date")
    rows = monthly(spark, sf_dir).withColumnRenamed("month", "day")
    return metric.compile_query(rows, card, metric.MetricQuery("value", "series", "1997-12-31", (("nation", (first,)),), limit=6))


_FRONT = f"{CURVE}, front AS (SELECT * FROM curve WHERE contract_month >= strftime(trade_date, '%Y-%m') QUALIFY ROW_NUMBER() OVER (PARTITION BY slug, trade_date ORDER BY open_interest DESC, contract_month) = 1)"


@query(f"WITH {_FRONT} SELECT slug, trade_date, contract_month, open_interest, settle FROM front")
def front_contract(spark, sf_dir):
    return prices.front_contract(curve(spark, sf_dir), "open_interest").select("slug", "trade_date", "contract_month", "open_interest", "settle")


@query(f"WITH {CURVE} SELECT slug, contract_month, trade_date, settle FROM curve WHERE trade_date <= DATE '1996-06-30' QUALIFY ROW_NUMBER() OVER (PARTITION BY slug, contract_month ORDER BY trade_date DESC) = 1")
def curve_as_of(spark, sf_dir):
    return prices.curve_as_of(curve(spark, sf_dir), F.lit("1996-06-30").cast("date")).select("slug", "contract_month", "trade_date", "settle")


def _legs(weights):
    joined = " JOIN ".join(f"(SELECT trade_date, settle, contract_month FROM front WHERE slug = '{s}') l{k}" + (" USING (trade_date)" if k else "") for k, (s, _) in enumerate(weights))
    total = " + ".join(f"l{k}.settle * {w}" for k, (_, w) in enumerate(weights))
    rolled = " OR ".join(f"l{k}.contract_month <> LAG(l{k}.contract_month) OVER (PARTITION BY year(trade_date) ORDER BY trade_date)" for k in range(len(weights)))
    return f"WITH {_FRONT} SELECT trade_date, ROUND({total}, 8) AS margin, COALESCE({rolled}, false) AS rolled FROM {joined}"


SPREAD, MARGIN = [("Brand#11", 1.0), ("Brand#12", -1.0)], [("Brand#11", -1.0), ("Brand#12", 0.8), ("Brand#13", 0.2)]


@query(_legs(SPREAD))
def leg_spread(spark, sf_dir):
    rows = prices.spread(prices.front_contract(curve(spark, sf_dir), "open_interest"), SPREAD, "margin")
    return rows.withColumn("margin", F.round("margin", 8))


@query(_legs(MARGIN))
def three_leg_margin(spark, sf_dir):
    rows = prices.spread(prices.front_contract(curve(spark, sf_dir), "open_interest"), MARGIN, "margin")
    return rows.withColumn("margin", F.round("margin", 8))


FAMILIES = features.Registry()


@FAMILIES.add("order_value", low=0.0)
def _order_value(rows):
    return rows.select(F.col("nation").alias("entity"), F.col("month").alias("period"), F.lit("order_value").alias("feature"), "value")


@FAMILIES.add("order_count")
def _order_count(rows):
    return rows.select(F.col("nation").alias("entity"), F.col("month").alias("period"), F.lit("order_count").alias("feature"), F.col("n").cast("double").alias("value"))


@FAMILIES.add("summer_value", label=True)
def _summer_value(rows):
    return rows.where(F.month("month").isin(6, 7, 8)).select(F.col("nation").alias("entity"), F.col("month").alias("period"), F.lit("summer_value").alias("feature"), "value")


_SPINE = f"{MONTHLY}, spine AS (SELECT nation AS entity, month AS period, 'order_value' AS feature, GREATEST(value, 0) AS value, false AS is_label FROM monthly WHERE value IS NOT NULL UNION ALL SELECT nation, month, 'order_count', GREATEST(LEAST(CAST(n AS DOUBLE), 9), 2), false FROM monthly UNION ALL SELECT nation, month, 'summer_value', value, true FROM monthly WHERE month(month) IN (6, 7, 8))"


#: The spine with order counts as they are.
_WHOLE_SPINE = _SPINE.replace("GREATEST(LEAST(CAST(n AS DOUBLE), 9), 2)", "CAST(n AS DOUBLE)")


@query(f"WITH {_WHOLE_SPINE} SELECT * FROM spine")
def feature_spine(spark, sf_dir):
    return FAMILIES.spine(monthly(spark, sf_dir))


@query(f"WITH {_WHOLE_SPINE} SELECT entity, period, MIN(value) FILTER (WHERE feature = 'order_value') AS order_value, MIN(value) FILTER (WHERE feature = 'order_count') AS order_count, MIN(value) FILTER (WHERE feature = 'summer_value') AS summer_value FROM spine GROUP BY 1, 2")
def feature_matrix(spark, sf_dir):
    return features.matrix(feature_spine(spark, sf_dir), ["order_value", "order_count", "summer_value"])


@query(f"WITH {_SPINE}, a AS (SELECT COUNT(DISTINCT entity) AS k FROM spine) SELECT feature, COUNT(*) AS n_rows, COUNT(DISTINCT entity) AS n_entities, MIN(period) AS first_period, MAX(period) AS last_period, CASE WHEN COUNT(DISTINCT entity) = ANY_VALUE(k) THEN 'shared' WHEN COUNT(DISTINCT entity) = 1 THEN 'own' ELSE 'partial' END AS scope FROM spine, a GROUP BY 1")
def feature_catalog(spark, sf_dir):
    return features.catalog(feature_spine(spark, sf_dir))


@query(f"WITH {_SPINE}, p AS (SELECT period, COUNT(*) FILTER (WHERE feature = 'order_value') * 1.0 / COUNT(DISTINCT entity) >= 0.5 AS a, COUNT(*) FILTER (WHERE feature = 'summer_value') * 1.0 / COUNT(DISTINCT entity) >= 0.5 AS b FROM spine GROUP BY 1) SELECT 'core' AS tier, MIN(period) AS first_period, MAX(period) AS last_period, MIN(period) FILTER (WHERE a) AS dense_from FROM p UNION ALL SELECT 'all', MIN(period), MAX(period), MIN(period) FILTER (WHERE a AND b) FROM p")
def training_windows(spark, sf_dir):
    return features.training_windows(feature_matrix(spark, sf_dir), {"core": ["order_value"], "all": ["order_value", "summer_value"]}, 1.0)


_EDGES = "edges AS (SELECT DISTINCT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'region' AS kind FROM nation UNION ALL SELECT DISTINCT 'n' || c_nationkey, 'c' || c_custkey, 'nation' FROM customer UNION ALL SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey, 'customer' FROM orders)"


def _edges(spark, sf_dir):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    parts = [("nation", "r", "n_regionkey", "n", "n_nationkey", "region"), ("customer", "n", "c_nationkey", "c", "c_custkey", "nation"), ("orders", "c", "o_custkey", "o", "o_orderkey", "customer")]
    return quality.union_all([table(spark, sf_dir, t).select(name(a, x).alias("src"), name(b, y).alias("dst"), F.lit(kind).alias("kind")).distinct() for t, a, x, b, y, kind in parts])


@query(f"WITH {_EDGES} SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)")
def graph_roots(spark, sf_dir):
    return graph.roots(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, c(origin, node, depth) AS (SELECT DISTINCT src, src, 0 FROM edges WHERE kind = 'region' UNION ALL SELECT origin, dst, depth + 1 FROM c JOIN edges ON src = node WHERE depth < 3) SELECT origin, node, MIN(depth) AS depth FROM c WHERE depth > 0 GROUP BY 1, 2")
def graph_descendants(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.reachable(edges, edges.where("kind = 'region'").select(F.col("src").alias("node")), 3)


@query(f"WITH RECURSIVE {_EDGES}, c(origin, node, depth) AS (SELECT dst, dst, 0 FROM edges WHERE kind = 'customer' UNION ALL SELECT origin, src, depth + 1 FROM c JOIN edges ON dst = node WHERE depth < 3) SELECT origin, node, MIN(depth) AS depth FROM c WHERE depth > 0 GROUP BY 1, 2")
def graph_ancestors(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.reachable(edges, edges.where("kind = 'customer'").select(F.col("dst").alias("node")), 3, upstream=True)


@query(f"WITH {_EDGES} SELECT COALESCE(n_name, dst) AS node, kind, MIN(src) AS source, COUNT(*) AS n_edges FROM edges LEFT JOIN nation ON dst = 'n' || n_nationkey GROUP BY 1, 2")
def edge_inversion(spark, sf_dir):
    alias = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("node"))
    return graph.inverted(_edges(spark, sf_dir), alias)


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 80), r(rule, driver, needed) AS (VALUES ('active', 'click', 2), ('active', 'view', 2), ('active', 'purchase', 2), ('bought', 'purchase', NULL), ('bought', 'click', NULL)), z AS (SELECT rule, COUNT(*) AS k, MAX(needed) AS needed FROM r GROUP BY 1), h AS (SELECT user_id, rule, COUNT(*) AS n FROM a JOIN r ON driver = event_type GROUP BY 1, 2) SELECT user_id AS entity, h.rule, n AS n_active, k AS n_drivers, CAST(n AS DOUBLE) / k AS share FROM h JOIN z USING (rule) WHERE n >= COALESCE(needed, k)")
def rules_fire(spark, sf_dir):
    active = table(spark, sf_dir, "events").where("value > 80").select(F.col("user_id").alias("entity"), F.col("event_type").alias("driver"))
    rules = spark.createDataFrame([("active", "click", 2), ("active", "view", 2), ("active", "purchase", 2), ("bought", "purchase", None), ("bought", "click", None)], "rule string, driver string, needed int")
    return graph.fires(active, rules)


@query("SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season, CAST(CAST(o_orderdate AS DATE) - CASE isodow(o_orderdate) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS DATE) AS business_day, CAST(len(list_filter(range(1, 31), lambda i: isodow(CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)) < 6)) AS INTEGER) AS days_in_30, CASE WHEN last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH) + INTERVAL 12 DAY > CAST(o_orderdate AS DATE) THEN CAST(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH) + INTERVAL 12 DAY AS DATE) ELSE CAST(last_day(CAST(o_orderdate AS DATE)) + INTERVAL 12 DAY AS DATE) END AS next_release FROM orders")
def calendar_functions(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.season_label(day, 9).alias("season"), dates.previous_business_day(day).alias("business_day"), dates.business_days_between(day, F.date_add(day, 30)).alias("days_in_30"), dates.next_release(day, "month_end", 12).alias("next_release"))


@query("SELECT s_suppkey, p_partkey, p_retailprice FROM (SELECT s_suppkey, s_nationkey FROM supplier) JOIN (SELECT *, p_partkey % 25 AS k FROM part) ON k = s_nationkey QUALIFY SUM(p_size) OVER (PARTITION BY s_suppkey ORDER BY p_retailprice DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100")
def budget_prefix(spark, sf_dir):
    """The parts of a remainder are summed up once; suppliers of its nation share them."""
    parts = table(spark, sf_dir, "part").withColumn("k", F.pmod("p_partkey", F.lit(25)).cast("int"))
    chosen = budget.prefix(parts, ["k"], "p_size", 100, [F.col("p_retailprice").desc(), F.col("p_partkey")])
    suppliers = table(spark, sf_dir, "supplier")
    return suppliers.join(chosen, F.col("k") == F.col("s_nationkey")).select("s_suppkey", "p_partkey", "p_retailprice")


@query("SELECT doc_id, source, k AS turn FROM (SELECT doc_id, source, ROW_NUMBER() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 5")
def stratified_sample(spark, sf_dir):
    rows = budget.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, "turn")
    return rows.withColumn("turn", F.col("turn").cast("bigint"))


def flagship(spark, sf_dir):
    """Monthly order value of nations as trailing z scores with bands, the strangest first."""
    return trailing_z(spark, sf_dir).withColumn("band", conform.band(F.col("z"), [(1.0, "high"), (2.0, "extreme")], "normal")).orderBy(F.abs("z").desc_nulls_last(), "nation", "month").limit(50)
