"""Price curves by delivery month: fronts, curves, spreads, margins, volatility."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def front_contract(curve: DataFrame, metric: str, slug: str = "slug", at: str = "trade_date", month: str = "contract_month") -> DataFrame:
    """For each slug and date the delivery month of the largest metric: months before the date's are out, a null metric never wins, ties go to the nearest month."""
    rows = curve.where(F.col(metric).isNotNull() & (F.col(month) >= F.date_format(at, "yyyy-MM")))
    w = W.partitionBy(slug, at).orderBy(F.col(metric).desc(), month)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def front_inputs(curve: DataFrame, metrics: dict[str, str | None], slug: str = "slug", at: str = "trade_date", month: str = "contract_month") -> DataFrame:
    """``slug``, ``trade_date``, ``n_eligible``, ``n_missing`` and ``answers``: whether every delivery month of the date that could be the front has the metric by which the slug's front is chosen. A front picked from some of them would go to whichever happens to have a number.

    ``metrics`` gives each slug's metric column (None: its front needs none). A slug that isn't there, or has a column that ``curve`` lacks, never answers; blank texts and values that aren't numbers are missing. Dates without an eligible month don't answer.
    """
    has = F.lit(False)
    for name, metric in metrics.items():
        if metric is None:
            held = F.lit(True)
        elif metric not in curve.columns:
            held = F.lit(False)
        else:
            number = F.col(metric).try_cast("double")
            held = number.isNotNull() & ~F.isnan(number)
        has = F.when(F.col(slug) == name, held).otherwise(has)
    eligible = F.coalesce(F.col(month) >= F.date_format(at, "yyyy-MM"), F.lit(False))
    told = curve.groupBy(slug, at).agg(F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & ~has).alias("n_missing"))
    return told.withColumn("answers", (F.col("n_eligible") > 0) & (F.col("n_missing") == 0))


def curve_as_of(curve: DataFrame, as_of, slug: str = "slug", at: str = "trade_date", month: str = "contract_month") -> DataFrame:
    """The newest session of each delivery month known at ``as_of``."""
    w = W.partitionBy(slug, month).orderBy(F.col(at).desc())
    return curve.where(F.col(at) <= as_of).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def spread(fronts: DataFrame, legs: list[tuple[str, float]], out: str, slug: str = "slug", at: str = "trade_date", month: str = "contract_month", price: str = "settle") -> DataFrame:
    """The weighted sum of the legs' fronts on dates that have all of them, and whether any leg's delivery month changed since the date before."""
    joined = None
    for k, (name, weight) in enumerate(legs):
        leg = fronts.where(F.col(slug) == name).select(at, (F.col(price) * weight).alias(f"__p{k}"), F.col(month).alias(f"__m{k}"))
        joined = leg if joined is None else joined.join(leg, at)
    w = W.partitionBy(F.year(at)).orderBy(at)  # a year's dates at most meet in a task
    rolled = F.lit(False)
    for k in range(len(legs)):
        rolled = rolled | (F.col(f"__m{k}") != F.lag(f"__m{k}").over(w))
    total = sum((F.col(f"__p{k}") for k in range(1, len(legs))), F.col("__p0"))
    return joined.select(at, total.alias(out), F.coalesce(rolled, F.lit(False)).alias("rolled"))


def volatility_momentum(series: DataFrame, keys: list[str], at: str, price: str, rows: int, least: int, back: int, baseline: int, quantile: float = 0.75) -> DataFrame:
    """Log returns, their deviation over ``rows`` scaled to a year, the change over ``back`` rows and whether the deviation is above its ``quantile`` of the ``baseline`` rows (no baseline: not)."""
    order = W.partitionBy(*keys).orderBy(at)
    w, base = order.rowsBetween(1 - rows, 0), order.rowsBetween(1 - baseline, 0)
    before = F.lag(price).over(order)
    df = series.withColumn("log_return", F.when((F.col(price) > 0) & (before > 0), F.ln(F.col(price) / before)))
    df = df.withColumn("volatility", F.when(F.count("log_return").over(w) >= least, F.stddev_samp("log_return").over(w) * math.sqrt(252)))
    df = df.withColumn("momentum", F.try_divide(F.col(price), F.lag(price, back).over(order)) - 1)
    return df.withColumn("high_volatility", F.coalesce(F.col("volatility") > F.percentile("volatility", quantile).over(base), F.lit(False)).cast("int"))
