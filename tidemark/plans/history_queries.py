"""Queries on releases, outcomes of events, admission, spans, filtered search, validation by groups and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as S
from ..operators import admission, conform, folds, graph, lexicon, outcomes, prices, retrieve, scores, vintages
from .base import CURVE, MONTHLY, curve, monthly, query, table

AS_OF = "2000-06-30"
HORIZONS = [30, 90, 180]

_TAPE = "tape AS (SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS day, ROUND(AVG(o_totalprice), 4) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 AND NOT (c_nationkey = 5 AND o_orderdate < DATE '1998-01-01') AND NOT (c_nationkey = 7 AND o_orderdate > DATE '1999-06-01') GROUP BY 1, 2)"
_FIRED = "fired AS (SELECT o_orderkey, c_nationkey AS k, CAST(o_orderdate AS DATE) AS event_date FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)"
_OUTCOMES = f"""{_TAPE}, {_FIRED}, known AS (SELECT * FROM tape WHERE day <= DATE '{AS_OF}' - 1), edges AS (SELECT k, MIN(day) AS lo, MAX(day) AS hi FROM known GROUP BY 1),
ev AS (SELECT f.*, h AS horizon_days, event_date + h AS close_date FROM fired f, (VALUES {", ".join(f"({h})" for h in HORIZONS)}) v(h) WHERE event_date <= DATE '{AS_OF}'),
an AS (SELECT o_orderkey, arg_min(day, day) AS anchor_date, arg_min(price, day) AS anchor_price FROM fired JOIN known USING (k) WHERE day BETWEEN event_date AND event_date + 5 GROUP BY 1),
en AS (SELECT o_orderkey, horizon_days, MAX(day) AS endpoint_date, arg_max(price, day) AS endpoint_price FROM ev JOIN known USING (k) WHERE day BETWEEN close_date - 5 AND close_date GROUP BY 1, 2),
st AS (SELECT ev.*, anchor_date, anchor_price, endpoint_date AS e_date, endpoint_price AS e_price, CASE WHEN lo IS NULL THEN 'declined_no_series' WHEN event_date < lo THEN 'declined_pre_coverage' WHEN close_date > LEAST(hi, DATE '{AS_OF}' - 6) THEN 'pending' WHEN anchor_date IS NULL THEN 'declined_no_anchor' WHEN endpoint_date IS NULL OR endpoint_date <= anchor_date THEN 'declined_no_endpoint' WHEN NOT anchor_price > 0 THEN 'declined_no_price' ELSE 'closed' END AS status FROM ev LEFT JOIN edges USING (k) LEFT JOIN an USING (o_orderkey) LEFT JOIN en USING (o_orderkey, horizon_days)),
told AS (SELECT o_orderkey, k, event_date, horizon_days, anchor_date, close_date, status, CASE WHEN status = 'closed' THEN e_date END AS endpoint_date, CASE WHEN status = 'closed' THEN 100 * (e_price / anchor_price - 1) END AS move FROM st)"""


def _told(spark, sf_dir):
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    covered = sold.where("k <> 3 AND NOT (k = 5 AND o_orderdate < DATE '1998-01-01') AND NOT (k = 7 AND o_orderdate > DATE '1999-06-01')")
    tape = covered.groupBy("k", day.alias("day")).agg(F.round(F.avg("o_totalprice"), 4).alias("price"))
    fired = sold.where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select("o_orderkey", "k", day.alias("event_date"))
    return outcomes.outcomes(fired, tape, ["k"], "event_date", "day", "price", HORIZONS, F.lit(AS_OF).cast("date"))


@query(f"WITH {_OUTCOMES} SELECT o_orderkey, k, event_date, CAST(horizon_days AS INTEGER) AS horizon_days, anchor_date, CAST(close_date AS DATE) AS close_date, endpoint_date, ROUND(move, 4) AS move_pct, status, COALESCE(endpoint_date, event_date) AS readable_date FROM told")
def forward_outcomes(spark, sf_dir):
    return _told(spark, sf_dir).select("o_orderkey", "k", "event_date", "horizon_days", "anchor_date", "close_date", "endpoint_date", F.round("move_pct", 4).alias("move_pct"), "status", "readable_date")


_WINDOWS = "RECURSIVE days AS (SELECT DISTINCT k, horizon_days, event_date AS d FROM told WHERE status = 'closed'), first AS (SELECT k, horizon_days, MIN(d) AS d FROM days GROUP BY 1, 2), walk(k, horizon_days, d, n) AS (SELECT k, horizon_days, d, 1 FROM first UNION ALL SELECT k, horizon_days, nx, n + 1 FROM (SELECT w.k, w.horizon_days, w.n, (SELECT MIN(x.d) FROM days x WHERE x.k = w.k AND x.horizon_days = w.horizon_days AND x.d >= w.d + w.horizon_days) AS nx FROM walk w) q WHERE nx IS NOT NULL)"


@query(
    f"WITH {_WINDOWS.replace('RECURSIVE ', 'RECURSIVE ' + _OUTCOMES + ', ', 1)}, i AS (SELECT k, horizon_days, MAX(n) AS n FROM walk GROUP BY 1, 2), c AS (SELECT k, horizon_days, COUNT(*) AS joined, COUNT(*) FILTER (WHERE status = 'closed') AS n_closed, COUNT(*) FILTER (WHERE status = 'pending') AS n_pending, COUNT(*) FILTER (WHERE status LIKE 'declined%') AS n_declined, quantile_cont(move, 0.1) AS p10, quantile_cont(move, 0.5) AS median, quantile_cont(move, 0.9) AS p90, AVG(CASE WHEN move IS NULL THEN NULL WHEN move > 0 THEN 1.0 ELSE 0.0 END) AS up FROM told GROUP BY 1, 2), s AS (SELECT c.*, COALESCE(n, 0) AS w, CASE WHEN n_closed = 0 AND n_pending > 0 THEN 'all_pending' WHEN n_closed = 0 THEN 'unmeasurable' WHEN n_closed < 5 THEN 'too_thin' WHEN COALESCE(n, 0) < 3 THEN 'overlap' WHEN n_pending > 0.5 * (n_closed + n_pending) THEN 'pending_heavy' END AS suppressed FROM c LEFT JOIN i USING (k, horizon_days)) SELECT k, CAST(horizon_days AS INTEGER) AS horizon_days, joined, n_closed, n_pending, n_declined, CAST(w AS INTEGER) AS n_independent, suppressed, CASE WHEN suppressed IS NULL THEN ROUND(p10, 4) END AS p10, CASE WHEN suppressed IS NULL THEN ROUND(median, 4) END AS median, CASE WHEN suppressed IS NULL THEN ROUND(p90, 4) END AS p90, CASE WHEN suppressed IS NULL THEN ROUND(up, 4) END AS share_up FROM s"
)
def outcome_distribution(spark, sf_dir):
    rows = outcomes.distribution(_told(spark, sf_dir), ["k"], "event_date")
    return rows.withColumns({c: F.round(c, 4) for c in ("p10", "median", "p90", "share_up")})


@query(f"WITH {_OUTCOMES} SELECT o_orderkey, CAST(horizon_days AS INTEGER) AS horizon_days, CASE WHEN status = 'closed' AND endpoint_date > DATE '1999-01-31' - 6 THEN 'pending' ELSE status END AS status, CASE WHEN endpoint_date <= DATE '1999-01-31' - 6 THEN ROUND(move, 4) END AS move_pct FROM told WHERE event_date <= DATE '1999-01-31'")
def outcomes_as_read_earlier(spark, sf_dir):
    day = F.lit("1999-01-31").cast("date")
    return outcomes.readable(_told(spark, sf_dir), day, written_at="event_date").select("o_orderkey", "horizon_days", "status", F.round("move_pct", 4).alias("move_pct"))


_RELEASED = "sold AS (SELECT n_regionkey AS region, year(o_orderdate) * 12 + month(o_orderdate) AS period, CAST(date_trunc('month', o_orderdate + INTERVAL (CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) MONTH) AS DATE) AS known_at, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), per AS (SELECT region, period, known_at, SUM(CAST(v AS DECIMAL(18, 2))) AS v FROM sold GROUP BY 1, 2, 3), rel AS (SELECT region, period, known_at, CAST(SUM(v) OVER (PARTITION BY region, period ORDER BY known_at) AS DOUBLE) AS value FROM per)"


def _released(spark, sf_dir):
    """Order value of regions and months as told month by month: orders are known so many months later as their priority says."""
    from pyspark.sql import Window as W

    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    late = F.add_months(F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int"))
    per = sold.groupBy("region", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("period"), F.trunc(late, "month").alias("known_at")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    so_far = W.partitionBy("region", "period").orderBy("known_at")
    return per.select("region", "period", "known_at", F.sum("v").over(so_far).cast("double").alias("value"))


@query(f"WITH {_RELEASED}, pts AS (SELECT DISTINCT a.region, a.period, b.known_at FROM (SELECT DISTINCT region, period FROM rel) a JOIN rel b ON a.region = b.region AND b.period BETWEEN a.period - 11 AND a.period), seen AS (SELECT p.region, p.period, p.known_at, r.period AS q, arg_max(r.value, r.known_at) AS v FROM pts p JOIN rel r ON r.region = p.region AND r.period BETWEEN p.period - 11 AND p.period AND r.known_at <= p.known_at GROUP BY 1, 2, 3, 4), z AS (SELECT region, period, known_at, MAX(CASE WHEN q = period THEN v END) AS value, COUNT(v) AS n, AVG(v) AS m, stddev_samp(v) AS s FROM seen GROUP BY 1, 2, 3) SELECT region, period, ROUND(value, 2) AS value, CAST(n AS INTEGER) AS n, CASE WHEN n >= 6 AND s > 1e-9 THEN ROUND((value - m) / s, 4) END AS z, known_at AS valid_from, LEAD(known_at) OVER (PARTITION BY region, period ORDER BY known_at) AS valid_to FROM z WHERE value IS NOT NULL")
def released_z(spark, sf_dir):
    rows = vintages.released_z(_released(spark, sf_dir), ["region"], "period", "known_at", "value", 12, 6)
    return rows.withColumns({"value": F.round("value", 2), "z": F.round("z", 4)})


@query(f"WITH {_RELEASED} SELECT region, period, arg_max(value, known_at) AS value FROM rel WHERE known_at <= DATE '1999-03-15' GROUP BY 1, 2")
def vintage_read_back(spark, sf_dir):
    known = vintages.validity(_released(spark, sf_dir), ["region", "period"], "known_at", "value")
    return vintages.as_of(known, F.lit("1999-03-15").cast("date")).select("region", "period", "value")


_FLAGS = "sold AS (SELECT n_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderstatus AS series, CAST(date_trunc('month', MAX(o_orderdate) OVER (PARTITION BY n_nationkey, year(o_orderdate), o_orderstatus)) AS DATE) AS known_at, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT nation, period, series, known_at, CAST(SUM(CAST(v AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM sold GROUP BY 1, 2, 3, 4)"


def _by_status(spark, sf_dir):
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = sold.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("period"), F.col("o_orderstatus").alias("series")).agg(F.trunc(F.to_date(F.max("o_orderdate")), "month").alias("known_at"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return vintages.same_vintage(rows, ["nation"], "period", "series", ["F", "O", "P"], "known_at", "value", F.lit("2001-12-31").cast("date"))


_SAME = f"{_FLAGS}, w AS (SELECT nation, period, MAX(CASE WHEN series = 'F' THEN value END) AS f, MAX(CASE WHEN series = 'O' THEN value END) AS o, MAX(CASE WHEN series = 'P' THEN value END) AS p, COUNT(DISTINCT known_at) AS k, MIN(known_at) AS told, COUNT(*) AS c FROM s GROUP BY 1, 2), t AS (SELECT nation, period, CASE WHEN k = 1 THEN 100 * f / (o + p) END AS ratio, CASE WHEN k = 1 THEN told END AS vintage, k <> 1 AS refused FROM w WHERE c = 3)"


@query(f"WITH {_SAME} SELECT nation, period, ROUND(ratio, 4) AS ratio, vintage, refused FROM t")
def same_vintage_ratio(spark, sf_dir):
    return _by_status(spark, sf_dir).select("nation", "period", F.round(100 * F.col("F") / (F.col("O") + F.col("P")), 4).alias("ratio"), "vintage", "refused")


@query(f"WITH {_SAME}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY nation ORDER BY period DESC) AS k FROM t), a AS (SELECT nation, COUNT(ratio) AS n, arg_max(period, period) FILTER (WHERE ratio IS NOT NULL) AS latest_period, arg_max(ratio, period) FILTER (WHERE ratio IS NOT NULL) AS latest, AVG(ratio) AS mean, COUNT(ratio) FILTER (WHERE k <= 4) * 1.0 / COUNT(*) FILTER (WHERE k <= 4) AS share, COUNT(*) FILTER (WHERE k <= 1 AND ratio IS NULL) AS holes FROM r GROUP BY 1), d AS (SELECT *, CASE WHEN n = 0 THEN 'no_history' WHEN share < 0.5 OR holes > 0 THEN 'gappy' END AS declined FROM a) SELECT d.nation, CASE WHEN declined IS NULL THEN latest_period END AS latest_period, CASE WHEN declined IS NULL THEN ROUND(latest, 4) END AS latest, CAST(n AS INTEGER) AS n, CASE WHEN declined IS NULL THEN ROUND(mean, 4) END AS mean, CASE WHEN declined IS NULL THEN ROUND((SELECT AVG(CASE WHEN t.ratio <= d.latest THEN 1.0 ELSE 0.0 END) FROM t WHERE t.nation = d.nation AND t.ratio IS NOT NULL AND t.period < d.latest_period), 4) END AS share_below, declined FROM d")
def ratio_standing(spark, sf_dir):
    ratio = _by_status(spark, sf_dir).withColumn("ratio", 100 * F.col("F") / (F.col("O") + F.col("P")))
    rows = vintages.standing(ratio, ["nation"], "period", "ratio", 4, 0.5, 1)
    return rows.withColumns({c: F.round(c, 4) for c in ("latest", "mean", "share_below")})


NAMES = [("stupid", "insult"), ("license", "licence"), ("public", "state"), ("public license", "licence"), ("copyright notice", "notice"), ("token", "token"), ("Créme", "cream")]
DECOYS = ["general public license"]
_FORMS = [*((f.lower().replace("é", "e"), f"'{n}'") for f, n in NAMES), *((d, "NULL") for d in DECOYS)]


@query(
    "WITH f(form, name) AS (VALUES " + ", ".join(f"('{a}', {b})" for a, b in _FORMS) + "), t AS (SELECT doc_id, ' ' || strip_accents(lower(text)) || ' ' AS t FROM documents), hit AS (SELECT doc_id, t, form, name, unnest(list_filter(range(2, CAST(length(t) AS BIGINT)), lambda i: substr(t, CAST(i AS INTEGER), CAST(length(form) AS INTEGER)) = form)) AS p FROM t, f WHERE contains(t, form)), ok AS (SELECT doc_id, p - 2 AS start, p - 2 + length(form) AS stop, name FROM hit WHERE NOT regexp_matches(substr(t, CAST(p - 1 AS INTEGER), 1), '[a-z0-9]') AND NOT regexp_matches(substr(t, CAST(p + length(form) AS INTEGER), 1), '[a-z0-9]')), longest AS (SELECT *, MAX(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok), free AS (SELECT * FROM longest WHERE before IS NULL OR start >= before) SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS \"end\", name FROM free WHERE name IS NOT NULL"
)
def dictionary_spans(spark, sf_dir):
    found = lexicon.find_spans(table(spark, sf_dir, "documents"), "doc_id", "text", lexicon.Lexicon(NAMES, DECOYS))
    return found.select("doc_id", "start", "end", "name")


@query()
def ordered_admission(spark, sf_dir):
    return admission.admit(table(spark, sf_dir, "documents"), "doc_id", "text", [])


_NEAR = "q AS (SELECT vec_id AS query_id, embedding AS e, label AS l FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id AND label = l AND vec_id <= query_id), t AS (SELECT query_id, vec_id, cosine, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM c)"


def _same_label_earlier(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("seen", F.col("vec_id"))
    return retrieve.cosine_top(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "embedding", same=["label"], not_later="seen")


@query(f"WITH {_NEAR} SELECT * FROM t WHERE rank <= 10")
def cosine_top_filtered(spark, sf_dir):
    """The nearest of the same label that were there before the query."""
    return _same_label_earlier(spark, sf_dir)


@query(f"WITH {_NEAR}, d AS (SELECT vec_id AS doc_id, CAST(ROW_NUMBER() OVER (ORDER BY MAX(cosine) DESC, vec_id) AS BIGINT) AS r FROM t WHERE rank <= 10 GROUP BY vec_id QUALIFY r <= 100), w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x IN ('license', 'public')) AS h FROM documents), s AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY len(list_distinct(h)) DESC, len(h) DESC, doc_id) AS r FROM w WHERE len(h) > 0 QUALIFY r <= 100), u AS (SELECT doc_id, r FROM d UNION ALL SELECT doc_id, r FROM s) SELECT doc_id, ROUND(SUM(1.0 / (60 + r)), 8) AS fused, COUNT(*) AS n_lists FROM u GROUP BY 1")
def dense_lexical_fusion(spark, sf_dir):
    """The list of the nearest vectors fused with that of the texts that hold the words."""
    from pyspark.sql import Window as W

    best = _same_label_earlier(spark, sf_dir).groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("cosine").alias("cosine")).orderBy(F.col("cosine").desc(), "doc_id").limit(100)
    dense = best.withColumn("rank", F.row_number().over(W.orderBy(F.col("cosine").desc(), "doc_id")))
    lexical = retrieve.lexical_top(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "public"], 100)
    return retrieve.fuse([dense, lexical], "doc_id").withColumn("fused", F.round("fused", 8))


_SNAPS = "snaps AS (SELECT o_orderkey AS id, c_mktsegment AS segment, c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderdate AS DATE) AS seen, o_totalprice AS predicted, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS weight FROM orders JOIN customer ON o_custkey = c_custkey)"


def _snaps(spark, sf_dir):
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    weight = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.substring("o_orderpriority", 1, 1).cast("double"))
    return sold.select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.to_date("o_orderdate").alias("seen"), F.col("o_totalprice").alias("predicted"), weight.alias("weight"))


@query(f"WITH {_SNAPS}, g AS (SELECT nation, year, arg_max(id, (seen, id)) AS id, MAX(seen) AS seen, arg_max(predicted, (seen, id)) AS latest, AVG(predicted) AS mean, CASE WHEN SUM(weight) > 0 THEN SUM(predicted * weight) / SUM(weight) ELSE AVG(predicted) END AS weighted FROM snaps GROUP BY 1, 2) SELECT nation, year, id, seen, ROUND(latest, 4) AS latest, ROUND(mean, 4) AS mean, ROUND(weighted, 4) AS weighted FROM g")
def collapsed_predictions(spark, sf_dir):
    rows = _snaps(spark, sf_dir).select("nation", "year", "seen", "id", "predicted", "weight")
    found = None
    for policy, name in (("latest", "latest"), ("mean", "mean"), ("weighted_mean", "weighted")):
        one = folds.collapse(rows, ["nation", "year"], "seen", "predicted", policy, "weight").select("nation", "year", "id", "seen", F.round("predicted", 4).alias(name))
        found = one if found is None else found.join(one.drop("id", "seen"), ["nation", "year"])
    return found


@query(f"WITH {_SNAPS}, g AS (SELECT nation, year, COUNT(*) AS n FROM snaps GROUP BY 1, 2), p AS (SELECT year AS fold, SUM(n) AS test_rows, COUNT(*) AS test_groups FROM g GROUP BY 1) SELECT fold, (SELECT COUNT(*) FROM p q WHERE q.fold < p.fold) AS train_periods, CAST((SELECT SUM(test_rows) FROM p q WHERE q.fold < p.fold) AS BIGINT) AS train_rows, CAST(test_rows AS BIGINT) AS test_rows, test_groups, CAST(0 AS BIGINT) AS straddling FROM p WHERE (SELECT COUNT(*) FROM p q WHERE q.fold < p.fold) >= 3")
def grouped_walk_forward(spark, sf_dir):
    return folds.grouped_walk_forward(_snaps(spark, sf_dir), ["nation", "year"], "year", 3).withColumn("straddling", F.col("straddling").cast("bigint"))


@query(f"WITH {_SNAPS} SELECT segment, COUNT(*) AS n, ROUND(SUM(predicted), 2) AS total, true AS moved FROM snaps GROUP BY 1")
def permuted_targets(spark, sf_dir):
    """A permutation within the segment keeps its values and moves them."""
    rows = folds.permuted(_snaps(spark, sf_dir), ["segment"], "predicted", "id", 1729, "dealt")
    kept = F.avg((F.col("dealt") == F.col("predicted")).cast("double")) < 0.05
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dealt"), 2).alias("total"), kept.alias("moved"))


@query(f"WITH {_SNAPS} SELECT COUNT(*) AS n_groups, true AS whole, true AS balanced FROM (SELECT DISTINCT nation, year FROM snaps)")
def grouped_folds(spark, sf_dir):
    """Each group lies in one fold, and no fold has over a quarter more rows than its share."""
    rows = folds.grouped_folds(_snaps(spark, sf_dir), ["nation", "year"], 5)
    per = rows.groupBy("nation", "year").agg(F.count_distinct("fold").alias("k"))
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 1.25 * F.sum("n") / 5).alias("balanced"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), (F.max("k") == 1).alias("whole")).join(F.broadcast(sizes))


_LEVELS = [("fine", ["nation", "segment"]), ("middle", ["nation"]), ("all", ["segment"])]


def _prior(columns: list[str]) -> str:
    return f"list(v) OVER (PARTITION BY {', '.join(columns)} ORDER BY seen RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query(
    f"WITH {_SNAPS}, s AS (SELECT nation, segment, date_trunc('month', seen) AS seen, SUM(CAST(predicted AS DECIMAL(18, 2))) AS v FROM snaps GROUP BY 1, 2, 3), d AS (SELECT nation, segment, CAST(seen AS DATE) AS seen, CAST(v AS DOUBLE) AS v FROM s), h AS (SELECT *, {', '.join(_prior(c) + f' AS h{k}' for k, (_, c) in enumerate(_LEVELS))} FROM d), l AS (SELECT *, CASE WHEN COALESCE(len(h0), 0) >= 12 THEN 'fine' WHEN COALESCE(len(h1), 0) >= 12 THEN 'middle' WHEN COALESCE(len(h2), 0) >= 12 THEN 'all' END AS level FROM h), p AS (SELECT *, CASE level WHEN 'fine' THEN h0 WHEN 'middle' THEN h1 WHEN 'all' THEN h2 END AS h FROM l), q AS (SELECT *, CASE WHEN len(h) >= 20 THEN list_aggregate(h, 'quantile_cont', 0.05) ELSE list_min(h) END AS lo, CASE WHEN len(h) >= 20 THEN list_aggregate(h, 'quantile_cont', 0.95) ELSE list_max(h) END AS hi FROM p), w AS (SELECT *, list_transform(h, lambda x: greatest(least(x, hi), lo)) AS c FROM q) SELECT nation, segment, seen, level, CAST(COALESCE(len(h), 0) AS INTEGER) AS n_prior, CASE WHEN list_stddev_pop(c) > 1e-12 THEN ROUND(greatest(least((v - list_avg(c)) / list_stddev_pop(c), 8.0), -8.0), 4) END AS z, CASE WHEN level IS NOT NULL THEN ROUND(len(list_filter(h, lambda x: x <= v)) * 1.0 / len(h), 6) END AS share_below FROM w"
)
def fallback_scores(spark, sf_dir):
    rows = _snaps(spark, sf_dir).groupBy("nation", "segment", F.trunc("seen", "month").alias("seen")).agg(F.sum(F.col("predicted").cast("decimal(18,2)")).cast("double").alias("v"))
    told = scores.fallback_z(rows, _LEVELS, "seen", "v", 12)
    return told.select("nation", "segment", "seen", "level", "n_prior", F.round("z", 4).alias("z"), F.round("share_below", 6).alias("share_below"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gross"]
_WIDE = "w AS (SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross FROM lineitem)"


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, ROUND(corr({a}, {b}), 5) AS correlation FROM w" for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]))
def all_correlations(spark, sf_dir):
    return scores.correlations(_wide(spark, sf_dir), _COLUMNS).withColumn("correlation", F.round("correlation", 5))


def _wide(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    net, gross = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return lines.select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"), "l_tax", net.alias("net"), gross.alias("gross"))


@query(f"WITH {_WIDE}, c AS (SELECT greatest(corr(l_extendedprice, net), corr(l_extendedprice, gross), corr(net, gross)) AS r FROM w) SELECT unnest(['gross', 'l_extendedprice', 'net']) AS component, 'gross' AS cluster, CAST(3 AS BIGINT) AS size, ROUND(r, 5) AS strongest FROM c")
def score_clusters(spark, sf_dir):
    found = scores.clusters(scores.correlations(_wide(spark, sf_dir), _COLUMNS), 0.95)
    return found.withColumn("strongest", F.round("strongest", 5))


@query(
    "WITH RECURSIVE i AS (SELECT p_brand, p_partkey, p_size, p_retailprice, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice / p_size DESC, p_partkey) AS k FROM part WHERE p_size <= 60), f(p_brand, k, p_partkey, spent, taken) AS (SELECT p_brand, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0.0::DOUBLE, false FROM i WHERE k = 1 UNION ALL SELECT i.p_brand, i.k, i.p_partkey, CASE WHEN spent + p_size <= 60 THEN spent + p_size ELSE spent END, spent + p_size <= 60 FROM f JOIN i ON i.p_brand = f.p_brand AND i.k = f.k + 1) SELECT p_brand, p_partkey, spent FROM f WHERE taken"
)
def budget_with_skips(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("budget", F.lit(60))
    return folds.greedy_budget(parts, ["p_brand"], "p_retailprice", "p_size", "budget", ["p_partkey"]).select("p_brand", "p_partkey", "spent")


@query(f"WITH {CURVE}, e AS (SELECT slug, trade_date, contract_month >= strftime(trade_date, '%Y-%m') AS able, CASE WHEN slug = 'Brand#11' THEN open_interest > 20 WHEN slug = 'Brand#12' THEN true ELSE false END AS has FROM curve) SELECT slug, trade_date, COUNT(*) FILTER (WHERE able) AS n_eligible, COUNT(*) FILTER (WHERE able AND NOT has) AS n_missing, COUNT(*) FILTER (WHERE able) > 0 AND COUNT(*) FILTER (WHERE able AND NOT has) = 0 AS answers FROM e GROUP BY 1, 2")
def front_answers(spark, sf_dir):
    rows = curve(spark, sf_dir).withColumn("open_interest", F.when(F.col("open_interest") > 20, F.col("open_interest")))
    return prices.front_inputs(rows, {"Brand#11": "open_interest", "Brand#12": None})


@query("WITH r AS (SELECT c_nationkey, (c_mktsegment IS NULL) AS a, c_mktsegment AS s, c_custkey AS k FROM customer) SELECT c_nationkey, COUNT(*) AS n_rows, true AS same, true AS differs FROM r GROUP BY 1")
def content_digests(spark, sf_dir):
    """A group's digest is the same in any order and on any partitioning, and another if one value is."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey")
    turned = rows.orderBy(F.col("c_custkey").desc())
    least = rows.groupBy("c_nationkey").agg(F.min("c_custkey").alias("least"))
    edited = rows.join(least, "c_nationkey").withColumn("c_mktsegment", F.when(F.col("c_custkey") == F.col("least"), F.lit("edited")).otherwise(F.col("c_mktsegment")))
    a, b, c = (conform.group_digest(x, ["c_nationkey"], ["c_mktsegment", "c_custkey"], n) for x, n in ((rows, "a"), (turned, "b"), (edited, "c")))
    return a.join(b.drop("n_rows"), "c_nationkey").join(c.drop("n_rows"), "c_nationkey").select("c_nationkey", "n_rows", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"))


_FLOW = "hop AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45 AND c_nationkey % 5 = s_nationkey % 5 AND abs(c_nationkey - s_nationkey) <= 5)"


def _flow(spark, sf_dir):
    lines, orders, customers, suppliers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    joined = lines.where("l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    near = joined.where("c_nationkey % 5 = s_nationkey % 5 AND abs(c_nationkey - s_nationkey) <= 5")
    return near.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst")).distinct()


@query(f"WITH RECURSIVE {_FLOW}, c(a, b) AS (SELECT src, dst FROM hop UNION SELECT a, dst FROM c JOIN hop ON src = b), s AS (SELECT x.a AS node, LEAST(x.a, MIN(x.b)) AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1, x.a) SELECT node, component FROM s")
def strong_components(spark, sf_dir):
    return graph.strong_components(_flow(spark, sf_dir))


@query(f"WITH RECURSIVE {_FLOW}, c(a, b) AS (SELECT src, dst FROM hop UNION SELECT a, dst FROM c JOIN hop ON src = b) SELECT src, dst FROM hop WHERE src <> dst AND NOT (dst < src AND EXISTS (SELECT 1 FROM c WHERE a = dst AND b = src))")
def edges_without_cycles(spark, sf_dir):
    return graph.without_back_edges(_flow(spark, sf_dir))


@query(f"WITH {MONTHLY}, d AS (SELECT nation, value, value - LAG(value) OVER (PARTITION BY nation ORDER BY month) AS d, month, n FROM monthly) SELECT nation, CAST(COUNT(*) FILTER (WHERE d > 0) AS INTEGER) AS ups, CAST(COUNT(*) FILTER (WHERE d < 0) AS INTEGER) AS downs, ROUND(arg_max(value, month) / arg_max(n, month), 4) AS ratio, ROUND(MAX(CASE WHEN month = DATE '1996-03-01' THEN value END) - MAX(CASE WHEN month = DATE '1995-03-01' THEN value END), 2) AS spread FROM d GROUP BY 1")
def revision_ratio_spread(spark, sf_dir):
    pairs = F.array_sort(F.collect_list(F.struct("month", F.col("value").alias("v"), F.col("n").cast("double").alias("n"))))
    rows = monthly(spark, sf_dir).groupBy("nation").agg(pairs.alias("p")).select("nation", F.transform("p", lambda x: x["v"]).alias("v"), F.transform("p", lambda x: x["n"]).alias("n"), F.transform("p", lambda x: F.date_format(x["month"], "yyyy-MM")).alias("labels"))
    v = F.col("v")
    told = S.compute("expiry_spread", v, F.col("labels"), "1995-03", "1996-03")
    return rows.select("nation", S.compute("revision_count", v, "up").alias("ups"), S.compute("revision_count", v, "down").alias("downs"), F.round(S.compute("ratio", v, F.col("n")), 4).alias("ratio"), F.round(told, 2).alias("spread"))
