"""Metric requests compiled to a DataFrame: what to read, what was known, how to sum up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pit


@dataclass(frozen=True)
class TableCard:
    """How a table is to be read: its period, the grain of one fact, and how knowledge is dated: ``data_date`` (period + lag), ``vintage`` (a release column), ``year_month`` (month end + lag) or ``none``."""

    metrics: tuple[str, ...]
    scopes: tuple[str, ...]
    period: str
    knowledge: str
    grain: tuple[str, ...] = ()
    known_at: str | None = None
    tiebreak: tuple[str, ...] = ()
    lag_days: int = 0
    annual: bool = False
    expiry: str | None = None


@dataclass(frozen=True)
class MetricQuery:
    """``agg``: latest, series, sum, mean or curve. A scope of None is not asked for; one that names nothing gives no rows, never the total."""

    metric: str
    agg: str
    as_of: str
    scopes: tuple[tuple[str, tuple], ...] = ()
    start: str | None = None
    end: str | None = None
    limit: int = 0


def compile_query(df: DataFrame, card: TableCard, query: MetricQuery) -> DataFrame:
    """The rows that answer ``query``: filters first, so that they reach the scan, then what was known, then the summary.

    latest: the newest period's row; series: the newest ``limit`` (0: all), oldest first; sum and mean: ``value`` and ``n_rows``; curve: the newest row of each expiry. A metric or scope that the card lacks, or a window within a year of an annual table, is refused.
    """
    if query.metric not in card.metrics:
        raise ValueError(f"no metric {query.metric}")
    if card.annual and query.start and query.end and query.start[:4] == query.end[:4] and (query.start[5:], query.end[5:]) != ("01-01", "12-31"):
        raise ValueError("an annual table has no months")
    rows = df
    for name, wanted in query.scopes:
        if name not in card.scopes:
            raise ValueError(f"no scope {name}")
        rows = rows.where(F.col(name).isin(*wanted)) if wanted else rows.where(F.lit(False))
    if query.start:
        rows = rows.where(F.col(card.period) >= F.lit(query.start).cast("date"))
    if query.end:
        rows = rows.where(F.col(card.period) <= F.lit(query.end).cast("date"))
    as_of = F.lit(query.as_of).cast("date")
    if card.knowledge == "data_date":
        rows = rows.where(pit.known_by_date(card.period, card.lag_days, as_of))
    elif card.knowledge == "vintage":
        rows = pit.latest_vintage(rows, list(card.grain), card.known_at, as_of, list(card.tiebreak))
    elif card.knowledge == "year_month":
        rows = rows.where(pit.known_by_month("year", "month", card.lag_days, as_of))
    value = rows.withColumn("value", F.col(query.metric))
    if query.agg in ("sum", "mean"):
        return value.agg((F.sum if query.agg == "sum" else F.avg)("value").alias("value"), F.count("value").alias("n_rows"))
    if query.agg == "curve":
        return pit.latest_vintage(value, [card.expiry], card.period, None, list(card.tiebreak)).select(card.expiry, card.period, "value")
    shown = value.select(card.period, *card.scopes, "value")
    newest = [F.col(card.period).desc_nulls_last(), *card.scopes]
    if query.agg == "latest":
        return shown.orderBy(*newest).limit(1)
    if query.agg == "series":
        return (shown.orderBy(*newest).limit(query.limit) if query.limit else shown).orderBy(card.period, *card.scopes)
    raise ValueError(query.agg)
