"""Registration of queries, and the series that they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import nan_to_null

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with the SQL that gives the same rows (None: SQL can't say it; a test does)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value of each nation and month: nation, month, n, value."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("nation", F.trunc("o_orderdate", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))


MONTHLY = "monthly AS (SELECT n_name AS nation, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped revenue of each day: day, revenue, quantity. It is summed in decimals, so that no order of the sum can tip a half cent."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")), 2).cast("double").alias("revenue"), F.sum("l_quantity").alias("quantity"))


DAILY = "daily AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(ROUND(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))), 2) AS DOUBLE) AS revenue, SUM(l_quantity) AS quantity FROM lineitem GROUP BY 1)"


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price curve: slug (a part's brand), trade_date (order day), contract_month (shipping month), open_interest, settle."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    grouped = joined.groupBy(F.col("p_brand").alias("slug"), F.to_date("o_orderdate").alias("trade_date"), F.date_format("l_shipdate", "yyyy-MM").alias("contract_month"))
    return grouped.agg(F.sum("l_quantity").alias("open_interest"), F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 9).alias("settle"))


CURVE = "curve AS (SELECT p_brand AS slug, CAST(o_orderdate AS DATE) AS trade_date, strftime(l_shipdate, '%Y-%m') AS contract_month, SUM(l_quantity) AS open_interest, ROUND(SUM(l_extendedprice) / SUM(l_quantity), 9) AS settle FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"
