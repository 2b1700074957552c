"""What came after events: moves of a series over several horizons, as far as they are known at a date, and how far they may be summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pit import asof_join
from .windows import independent_windows

#: States of a row, besides "declined_" and a reason.
CLOSED, PENDING = "closed", "pending"
#: Why a row has no move and never will: no tape of the key, an event before its first day, no session near the event or the horizon's end, no positive price to start from.
REASONS = ("no_series", "pre_coverage", "no_anchor", "no_endpoint", "no_price")


def tape_edges(tape: DataFrame, keys: list[str], tape_at: str, as_of: Column, lag_days: int) -> DataFrame:
    """``keys`` with the first and last day of each series that is known at ``as_of``, days being published ``lag_days`` later."""
    return tape.where(F.col(tape_at) <= F.date_sub(as_of, lag_days)).groupBy(*keys).agg(F.min(tape_at).alias("first_day"), F.max(tape_at).alias("last_day"))


def outcomes(events: DataFrame, tape: DataFrame, keys: list[str], event_at: str, tape_at: str, price: str, horizons: list[int], as_of: Column, lag_days: int = 1, settle_days: int = 5, anchor_within: int = 5, end_within: int = 5) -> DataFrame:
    """A row for each event up to ``as_of`` and each of ``horizons`` (days): ``horizon_days``, ``anchor_date`` and ``anchor_price`` (the first session from the event's day on), ``close_date`` (that day and the horizon), ``endpoint_date`` and ``endpoint_price`` (the last session up to it), ``move_pct``, ``status`` and ``readable_date`` (from when on the row tells what it tells).

    A horizon closes when its end is at or before the series' edge: the earlier of its last known day and of ``as_of`` less ``lag_days`` and ``settle_days``. Until then the row is pending and gives no endpoint and no move, whatever the tape holds. Other rows without a move are declined, with a reason of REASONS, the first that holds. Sessions count only within ``anchor_within`` days after the event and ``end_within`` days before the horizon's end, and the endpoint is later than the anchor. No event is dropped but those after ``as_of`` or without a day; repeated events keep their number; null prices are no sessions; of several prices of a day the largest counts. All horizons share one as-of join; no pair of an event and a session is made.
    """
    known = tape.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double")) & (F.col(tape_at) <= F.date_sub(as_of, lag_days))).select(*keys, F.to_date(tape_at).alias("__day"), F.col(price).alias("__price"))
    edges = known.groupBy(*keys).agg(F.min("__day").alias("__first"), F.max("__day").alias("__last"))
    rows = events.where(F.to_date(event_at) <= as_of).withColumn("__event", F.to_date(event_at))
    start = asof_join(rows, known.withColumn("__price_at", F.col("__day")), keys, "__event", "__price_at", ["__day", "__price"], forward=True, within=F.make_dt_interval(F.lit(anchor_within))).drop("__price_at")
    start = start.withColumnsRenamed({"__day": "anchor_date", "__price": "anchor_price"}).withColumn("horizon_days", F.explode(F.array(*map(F.lit, horizons)))).withColumn("close_date", F.date_add("__event", F.col("horizon_days")))
    end = asof_join(start, known.withColumn("__price_at", F.col("__day")), keys, "close_date", "__price_at", ["__day", "__price"], within=F.make_dt_interval(F.lit(end_within))).drop("__price_at")
    end = end.withColumnsRenamed({"__day": "endpoint_date", "__price": "endpoint_price"}).join(edges, keys, "left")
    edge = F.least("__last", F.date_sub(as_of, lag_days + settle_days))
    declined = lambda reason: F.lit(f"declined_{reason}")
    status = (
        F.when(F.col("__first").isNull(), declined("no_series"))
        .when(F.col("__event") < F.col("__first"), declined("pre_coverage"))
        .when(F.col("close_date") > edge, PENDING)
        .when(F.col("anchor_date").isNull(), declined("no_anchor"))
        .when(F.col("endpoint_date").isNull() | (F.col("endpoint_date") <= F.col("anchor_date")), declined("no_endpoint"))
        .when(~(F.col("anchor_price") > 0), declined("no_price"))
        .otherwise(CLOSED)
    )
    told = end.withColumn("status", status)
    closed = F.col("status") == CLOSED
    told = told.withColumns({"endpoint_date": F.when(closed, F.col("endpoint_date")), "endpoint_price": F.when(closed, F.col("endpoint_price"))})
    told = told.withColumns({"move_pct": F.when(closed, 100 * (F.col("endpoint_price") / F.col("anchor_price") - 1)), "readable_date": F.coalesce("endpoint_date", "__event")})
    return told.select(*events.columns, "horizon_days", "anchor_date", "anchor_price", "close_date", "endpoint_date", "endpoint_price", "move_pct", "status", "readable_date")


def readable(told: DataFrame, as_of: Column, lag_days: int = 1, settle_days: int = 5, written_at: str | None = None) -> DataFrame:
    """Rows of an outcome table, perhaps built later, as a reader at ``as_of`` may see them: a horizon that had not closed by then is pending and gives no move; rows of a ledger written after ``as_of`` (``written_at``) don't exist yet, nor do rows whose own date is later."""
    rows = told.where(F.col("readable_date").isNotNull() & (F.coalesce(F.col(written_at) <= as_of, F.lit(False)) if written_at else F.lit(True)))
    late = (F.col("status") == CLOSED) & (F.col("endpoint_date") > F.date_sub(as_of, lag_days + settle_days))
    hidden = {c: F.when(~F.coalesce(late, F.lit(False)), F.col(c)) for c in ("endpoint_date", "endpoint_price", "move_pct")}
    return rows.withColumns({"status": F.when(late, F.lit(PENDING)).otherwise(F.col("status"))} | hidden)


def distribution(told: DataFrame, keys: list[str], event_at: str, least_closed: int = 5, least_windows: int = 3, most_pending: float = 0.5) -> DataFrame:
    """For each of ``keys`` and horizon: counts of rows (``joined``, ``n_closed``, ``n_pending``, ``n_declined``), ``n_independent`` (windows of the horizon that closed events fill without overlap), ``suppressed`` and, where that is null, the deciles ``p10`` and ``p90``, ``median`` and ``share_up`` of the moves.

    Suppressed, the first that holds: "all_pending", "unmeasurable" (nothing closed, something declined), "too_thin" (under ``least_closed``), "overlap" (under ``least_windows``), "pending_heavy" (more than ``most_pending`` of what is or may be measured). Quantiles are interpolated.
    """
    by = [*keys, "horizon_days"]
    closed, pending = F.col("status") == CLOSED, F.col("status") == PENDING
    shape = [F.percentile("move_pct", q).alias(f"__{name}") for name, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))]
    counted = told.groupBy(*by).agg(F.count(F.lit(1)).alias("joined"), F.count_if(closed).alias("n_closed"), F.count_if(pending).alias("n_pending"), F.count_if(~closed & ~pending).alias("n_declined"), *shape, F.avg((F.col("move_pct") > 0).cast("double")).alias("__share_up"))
    windows = independent_windows(told.where(closed), by, event_at, F.col("horizon_days"), "n_independent")
    rows = counted.join(windows, by, "left").withColumn("n_independent", F.coalesce("n_independent", F.lit(0)))
    measured = F.col("n_closed") + F.col("n_pending")
    suppressed = (
        F.when((F.col("n_closed") == 0) & (F.col("n_pending") > 0), "all_pending")
        .when(F.col("n_closed") == 0, "unmeasurable")
        .when(F.col("n_closed") < least_closed, "too_thin")
        .when(F.col("n_independent") < least_windows, "overlap")
        .when(F.col("n_pending") > most_pending * measured, "pending_heavy")
    )
    rows = rows.withColumn("suppressed", suppressed)
    shown = [F.when(F.col("suppressed").isNull(), F.col(f"__{c}")).alias(c) for c in ("p10", "median", "p90", "share_up")]
    return rows.select(*by, "joined", "n_closed", "n_pending", "n_declined", "n_independent", "suppressed", *shown)
