"""Queries on statistics of files that merge, their gates, and audits of a matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, census, places
from .base import query, table

COUNTED = ["l_quantity", "early", "marked", "nothing", "shaky", "l_returnflag", "told"]
#: Least shares of values: column, floor, first and last month of a season.
FLOORS = [("l_quantity", 1.0, None, None), ("early", 0.4, None, None), ("early", 0.9, 11, 2), ("early", 0.8, 12, 12), ("marked", 0.5, None, None), ("nothing", 0.1, None, None), ("shaky", 0.9, 5, 9), ("shaky", 0.3, None, None), ("l_returnflag", 0.9, None, None), ("lost", 0.5, None, None)]

_LINES = "lines AS (SELECT month(l_shipdate) AS m, l_quantity, CASE WHEN month(l_shipdate) <= 6 THEN l_discount END AS early, -99.9 AS marked, CAST(NULL AS DOUBLE) AS nothing, CASE WHEN l_linestatus = 'F' THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS shaky, l_returnflag, DATE '2001-01-01' AS told FROM lineitem)"


def _one(column: str, number: bool, where: str = "TRUE") -> str:
    value = f"CASE WHEN isnan({column}) THEN NULL ELSE CAST({column} AS DOUBLE) END" if number else f"CAST({column} AS VARCHAR)"
    ends = "MIN(v) AS low, MAX(v) AS high, CAST(NULL AS VARCHAR) AS low_text, CAST(NULL AS VARCHAR) AS high_text" if number else "CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, MIN(v) AS low_text, MAX(v) AS high_text"
    return f"SELECT '{column}' AS \"column\", COUNT(DISTINCT m) AS n_parts, COUNT(*) AS n_rows, COUNT(v) AS n_values, COUNT(v) / COUNT(*) AS share, LEAST(COUNT(DISTINCT v), 2) AS distinct_at_least, {ends} FROM (SELECT m, {value} AS v FROM lines WHERE {where})"


def _census_sql(where: str = "TRUE") -> str:
    return " UNION ALL ".join(_one(c, c not in ("l_returnflag", "told"), where) for c in COUNTED)


_MERGED = f"{_LINES}, c AS ({_census_sql()})"


def _lines(spark, sf_dir):
    month = F.month("l_shipdate")
    nan = F.lit(float("nan"))
    lines = table(spark, sf_dir, "lineitem")
    made = {"early": F.when(month <= 6, F.col("l_discount")), "marked": F.lit(-99.9), "nothing": F.lit(None).cast("double"), "shaky": F.when(F.col("l_linestatus") == "F", nan).otherwise(F.col("l_tax")), "told": F.lit("2001-01-01").cast("date")}
    return lines.select(month.alias("m"), "l_quantity", "l_returnflag", *(x.alias(c) for c, x in made.items()))


def _states(spark, sf_dir):
    """Statistics of the months, as if those to August had been kept and the others came later."""
    lines = _lines(spark, sf_dir)
    return census.partials(lines.where("m <= 8"), ["m"], COUNTED).unionByName(census.partials(lines.where("m > 8"), ["m"], COUNTED))


def _floors(spark, month):
    return census.floors_at(spark.createDataFrame(FLOORS, "column string, floor double, first_month int, last_month int"), month)


@query(f"WITH {_MERGED} SELECT \"column\", n_parts, n_rows, n_values, share, low, high, low_text, high_text, CAST(distinct_at_least AS INTEGER) AS distinct_at_least, n_values = 0 AS all_missing, distinct_at_least = 1 AS constant, COALESCE(distinct_at_least = 1 AND low = -99.9, FALSE) AS saturated FROM c")
def merged_census(spark, sf_dir):
    return census.merged(_states(spark, sf_dir))


_FLOOR_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in FLOORS)


def _floor_sql(month: int) -> str:
    season = f"a IS NOT NULL AND (CASE WHEN a <= b THEN {month} BETWEEN a AND b ELSE {month} >= a OR {month} <= b END)"
    return f"f AS (SELECT \"column\", COALESCE(MAX(floor) FILTER (WHERE {season}), MAX(floor) FILTER (WHERE a IS NULL)) AS floor FROM (VALUES {_FLOOR_ROWS}) v(\"column\", floor, a, b) GROUP BY 1)"


@query(
    f"WITH {_MERGED}, {_floor_sql(1)}, j AS (SELECT f.\"column\", floor, c.n_rows, c.n_values, c.share, c.distinct_at_least AS d, c.low FROM f LEFT JOIN c ON c.\"column\" = f.\"column\") SELECT \"column\", 'absent' AS kind, NULL AS observed, floor AS threshold FROM j WHERE n_rows IS NULL UNION ALL SELECT \"column\", 'all_missing', share, floor FROM j WHERE n_values = 0 UNION ALL SELECT \"column\", 'below_floor', share, floor FROM j WHERE n_values > 0 AND share < floor UNION ALL SELECT \"column\", CASE WHEN low = -99.9 THEN 'saturated' ELSE 'constant' END, share, floor FROM j WHERE d = 1 UNION ALL SELECT \"column\", 'single_vintage', NULL, NULL FROM c WHERE \"column\" = 'told' AND distinct_at_least = 1"
)
def census_gate(spark, sf_dir):
    return census.gate(census.merged(_states(spark, sf_dir)), _floors(spark, 1), "told")


@query(f"WITH {_MERGED}, s AS ({_census_sql('m <= 3')}), {_floor_sql(1)} SELECT \"column\", s.share AS sample_share, c.share AS full_share, floor FROM s JOIN c USING (\"column\") JOIN f USING (\"column\") WHERE (s.share < floor) <> (c.share < floor)")
def sample_diverges(spark, sf_dir):
    states = _states(spark, sf_dir)
    return census.diverging(census.merged(states.where("m <= 3")), census.merged(states), _floors(spark, 1))


_SHOTS = "shots AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS target, c_nationkey AS nation, year(o_orderdate) AS y, o_orderdate AS seen_at, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 250000 END AS label, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS ready, c_mktsegment AS origin, quarter(o_orderdate) AS stage FROM orders JOIN customer ON o_custkey = c_custkey)"


def _shots(spark, sf_dir):
    """Orders as snapshots of the outcomes of nations and years, with targets, labels, values and states of which some are null."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = F.col("o_orderstatus") != "P"
    made = {"target": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")), "nation": F.col("c_nationkey"), "y": F.year("o_orderdate"), "seen_at": F.col("o_orderdate"), "label": F.when(told, F.col("o_totalprice") > 250000), "value": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")), "ready": F.when(told, F.col("o_orderstatus") == "F"), "origin": F.col("c_mktsegment"), "stage": F.quarter("o_orderdate")}
    return joined.select(*(x.alias(c) for c, x in made.items()))


@query(
    f"""WITH {_SHOTS}, g AS (SELECT target, nation, y, label, value, ready, origin, COUNT(*) OVER (PARTITION BY target, nation, y) AS n, ROW_NUMBER() OVER (PARTITION BY target, nation, y ORDER BY (label IS NOT NULL) DESC, seen_at DESC, label DESC NULLS LAST, value DESC NULLS LAST, COALESCE(ready, FALSE) DESC, origin DESC) AS k FROM shots), o AS (SELECT * FROM g WHERE k = 1),
r AS (SELECT target, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE ready) AS n_trainable, COUNT(*) FILTER (WHERE label) AS n_event_rows, AVG(CAST(label AS INTEGER)) AS event_row_share FROM shots GROUP BY 1),
p AS (SELECT target, COUNT(*) AS n_groups, COUNT(*) FILTER (WHERE ready) AS n_trainable_groups, MEDIAN(n) AS median_snapshots, AVG(value) FILTER (WHERE ready) AS mean, STDDEV_POP(value) FILTER (WHERE ready) AS deviation, MIN(value) FILTER (WHERE ready) AS low, MAX(value) FILTER (WHERE ready) AS high, COUNT(*) FILTER (WHERE label) AS n_event_groups, AVG(CAST(label AS INTEGER)) AS event_group_share FROM o GROUP BY 1),
lo AS (SELECT target, MIN(s) AS least_origin_share FROM (SELECT target, origin, AVG(CAST(label AS INTEGER)) AS s FROM o GROUP BY 1, 2) GROUP BY 1), ls AS (SELECT target, MIN(s) AS least_stage_share FROM (SELECT target, stage, AVG(CAST(label AS INTEGER)) AS s FROM shots GROUP BY 1, 2) GROUP BY 1)
SELECT r.*, p.* EXCLUDE (target), least_origin_share, least_stage_share FROM r JOIN p ON r.target IS NOT DISTINCT FROM p.target JOIN lo ON r.target IS NOT DISTINCT FROM lo.target JOIN ls ON r.target IS NOT DISTINCT FROM ls.target"""
)
def event_balance(spark, sf_dir):
    return audits.event_balance(_shots(spark, sf_dir), "target", ["nation", "y"], "seen_at", "label", "value", "ready", "origin", "stage")


_SEEN = ["value", "rare", "flat", "never", "scarce"]


@query(
    f"""WITH {_SHOTS}, w AS (SELECT origin, stage, COALESCE(ready, FALSE) AS ready, value, CASE WHEN value > 450000 THEN value END AS rare, 1.0 AS flat, CAST(NULL AS DOUBLE) AS never, CASE WHEN value > 200000 THEN value END AS scarce FROM shots),
u AS ({" UNION ALL ".join(f"SELECT origin, stage, ready, '{c}' AS feature, {c} AS v FROM w" for c in _SEEN)}),
f AS (SELECT feature, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE ready) AS n_trainable, COUNT(v) / COUNT(*) AS share, COUNT(v) FILTER (WHERE ready) / COUNT(*) FILTER (WHERE ready) AS trainable_share, COUNT(DISTINCT v) AS n_distinct FROM u GROUP BY 1),
a AS (SELECT feature, MIN(s) AS least_stage FROM (SELECT feature, stage, COUNT(v) / COUNT(*) AS s FROM u GROUP BY 1, 2) GROUP BY 1), b AS (SELECT feature, MIN(s) AS least_origin FROM (SELECT feature, origin, COUNT(v) / COUNT(*) AS s FROM u GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT feature, MAX(n) / SUM(n) AS mode_share FROM (SELECT feature, v, COUNT(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT f.*, least_stage, least_origin, mode_share, CASE WHEN share = 0 THEN 'all_missing' WHEN share < 0.2 THEN 'ultra_sparse' WHEN n_distinct <= 1 THEN 'constant' WHEN share < 0.6 THEN 'sparse' WHEN share < 0.9 THEN 'usable' ELSE 'dense' END AS bucket FROM f JOIN a USING (feature) JOIN b USING (feature) LEFT JOIN m USING (feature)
UNION ALL SELECT 'gone', COUNT(*), COUNT(*) FILTER (WHERE ready), 0, 0, 0, NULL, NULL, NULL, 'missing' FROM w"""
)
def feature_coverage(spark, sf_dir):
    shots = _shots(spark, sf_dir).withColumns({"rare": F.expr("CASE WHEN value > 450000 THEN value END"), "flat": F.lit(1.0), "never": F.lit(None).cast("double"), "scarce": F.expr("CASE WHEN value > 200000 THEN value END")})
    return audits.coverage(shots, [*_SEEN, "gone"], "ready", ["stage", "origin"])


@query("WITH j AS (SELECT l_shipdate, o_orderdate + INTERVAL 30 DAY AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_shipdate > d) AS late FROM j) SELECT 'known_later' AS issue, NULL AS feature, late AS n_rows FROM n WHERE late > 0 UNION ALL SELECT issue, feature, n FROM n, (VALUES ('target_like', 'target_price'), ('same_period', 'crop_area'), ('blocked', 'l_tax'), ('blocked', 'crop_area')) v(issue, feature)")
def leak_audit(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("as_of", F.expr("o_orderdate + INTERVAL 30 DAY"))
    rules = audits.Names(target="^(target_|label_)", same_period="^crop_", lagged="_(lag|prior)[0-9]*$")
    blocked = spark.createDataFrame([("l_tax",), ("crop_area",), ("crop_area",), ("unused",)], "feature string")
    return audits.leaks(joined, ["l_quantity", "l_tax", "target_price", "crop_area", "crop_area_lag1"], rules, "l_shipdate", "as_of", blocked)


_LEAVES = "leaves AS (SELECT source, doc_id AS leaf, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE '' END || COALESCE(text, '') AS t, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), whole AS (SELECT source, string_agg(t, chr(10) || chr(10) ORDER BY leaf) AS w FROM leaves GROUP BY 1), ends AS (SELECT source, leaf, SUM(length(t) + 2) OVER (PARTITION BY source ORDER BY leaf) AS hi, length(t) + 2 AS n FROM leaves)"


@query(
    f"WITH {_LEAVES}, lead AS (SELECT source, length(w) - length(regexp_replace(w, '^\\s+', '')) AS lead, length(w) AS total FROM whole), asked AS (SELECT doc_id, source, doc_id * 997 AS seen_at FROM documents) SELECT doc_id, asked.source, seen_at, leaf FROM asked LEFT JOIN lead ON asked.source = lead.source LEFT JOIN ends ON ends.source = asked.source AND seen_at + lead >= hi - n AND seen_at + lead < LEAST(hi, total)"
)
def page_of_offset(spark, sf_dir):
    """Sources as documents whose pages are the table's texts; one offset asked for each row."""
    docs = table(spark, sf_dir, "documents")
    blank = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise("")
    leaves = docs.select("source", F.col("doc_id").alias("leaf"), F.concat(blank, F.coalesce("text", F.lit(""))).alias("text"))
    asked = docs.select("doc_id", "source", (F.col("doc_id") * 997).alias("seen_at"))
    return places.page_at(asked, places.page_spans(leaves, "source", "leaf", "text"), "source", "seen_at", "leaf")
