"""What was known when: as-of joins, vintages and publication guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], strict: bool = False, forward: bool = False, within: Column | None = None, prefix: str = "", span_days: int | None = 90) -> DataFrame:
    """``left`` with ``values`` and ``right_at`` of the nearest row of ``right`` of the same keys that isn't later (``forward``: isn't earlier); ``strict`` refuses equal times.

    Both sides are laid into one series of each key and span of ``span_days`` days, and the last right row is carried on; what a span takes over from those before it comes from one row a key and span. So the rows of one key, however many, share no task, and no pair of rows is ever formed. Times that are neither dates nor timestamps, or a null ``span_days``, make one series a key. ``within`` is an interval: matches further away give nulls. Of right rows with one time the largest values win. Left rows keep their number; a null time or key matches nothing. Names that both sides would give need a ``prefix``: without it ValueError is raised.
    """
    if clash := {prefix + c for c in (right_at, *values)} & set(left.columns):
        raise ValueError(f"columns {sorted(clash)} are in both sides: give a prefix")
    found = F.struct(F.col(right_at).alias("at"), *(F.col(v) for v in values))
    probe = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("__right"))
    build = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("__at"), F.lit(None).cast(probe.schema["__left"].dataType).alias("__left"), found.alias("__right"))
    laid = probe.unionByName(build)
    spans = span_days is not None and all(isinstance(side.schema["__at"].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for side in (probe, build))
    by = keys
    if spans:
        laid = laid.withColumn("__span", F.floor(F.datediff("__at", F.lit("1970-01-01").cast("date")) / span_days))
        by = [*keys, "__span"]
    # at equal times right rows come first if they may match, else last
    side = F.when(F.col("__left").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    time = F.col("__at").desc_nulls_first() if forward else F.col("__at").asc_nulls_first()
    order = W.partitionBy(*by).orderBy(time, side, F.col("__right")).rowsBetween(W.unboundedPreceding, 0)
    usable = F.col("__left.`" + left_at + "`").isNotNull()
    for k in keys:
        usable = usable & F.col(f"__left.`{k}`").isNotNull()
    hits = laid.withColumn("__hit", F.last("__right", True).over(order)).where(F.col("__left").isNotNull())
    if spans:
        at = F.col("__right.at")
        nearest = F.max_by("__right", F.when(at.isNotNull(), F.struct(-F.unix_micros(at.cast("timestamp")), "__right"))) if forward else F.max("__right")
        ends = laid.groupBy(*by).agg(nearest.alias("__end"))
        earlier = W.partitionBy(*keys).orderBy(F.col("__span").desc() if forward else F.col("__span").asc()).rowsBetween(W.unboundedPreceding, -1)
        hits = hits.join(ends.select(*by, F.last("__end", True).over(earlier).alias("__carried")), by, "left").withColumn("__hit", F.coalesce("__hit", "__carried"))
    hits = hits.withColumn("__hit", F.when(usable, F.col("__hit")))
    if within is not None:
        late = (F.col("__hit.at") > F.col("__at") + within) if forward else (F.col("__hit.at") < F.col("__at") - within)
        hits = hits.withColumn("__hit", F.when(~late, F.col("__hit")))
    return hits.select("__left.*", F.col("__hit.at").alias(prefix + right_at), *(F.col(f"__hit.`{v}`").alias(prefix + v) for v in values))


def latest_vintage(df: DataFrame, grain: list[str], known_at: str, as_of: Column | None = None, tiebreak: list[str] | None = None) -> DataFrame:
    """The newest row of each grain that was known at ``as_of`` (None: at any time), ties by ``tiebreak`` descending."""
    rows = df if as_of is None else df.where(F.col(known_at) <= as_of)
    order = [F.col(c).desc_nulls_last() for c in [known_at, *(tiebreak or [])]]
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*grain).orderBy(*order))).where("__n = 1").drop("__n")


def latest_value(df: DataFrame, grain: list[str], known_at: str, values: list[str], as_of: Column | None = None) -> DataFrame:
    """For each grain the values of its newest row, summed up in each task before they meet: for grains with very many rows."""
    rows = df if as_of is None else df.where(F.col(known_at) <= as_of)
    best = F.max(F.struct(known_at, *values)).alias("__best")
    return rows.groupBy(*grain).agg(best).select(*grain, "__best.*")


def known_by_date(at: str, lag_days: int, as_of: Column) -> Column:
    """A row dated ``at`` is published ``lag_days`` later."""
    return F.col(at) <= F.date_sub(as_of, lag_days)


def known_by_month(year: str, month: str, lag_days: int, as_of: Column) -> Column:
    """A month is published ``lag_days`` after its end. The bound on the year lets partitions be left out."""
    end = F.last_day(F.make_date(F.col(year), F.col(month), F.lit(1)))
    return (F.col(year) <= F.year(as_of)) & (F.date_add(end, lag_days) <= as_of)


def prior_periods(df: DataFrame, spine: DataFrame, keys: list[str], period: str, known_at: str, cutoff: str, offset: int = 0) -> DataFrame:
    """Rows of ``df`` for each row of ``spine``: those of the keys and of period + offset, known at the row's ``cutoff``."""
    target = spine.withColumn("__p", F.col(period) + offset)
    source = df.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed(period, "__period")
    on = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__p") == F.col("__period"), F.col(known_at) <= F.col(cutoff)]
    return target.join(source, on, "left").drop("__p", "__period", *(f"__{k}" for k in keys))


def revision(df: DataFrame, grain: list[str], known_at: str, value: str, out: str) -> DataFrame:
    """Change of ``value`` against the release before that had one."""
    before = F.last(value, True).over(W.partitionBy(*grain).orderBy(known_at).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn(out, F.col(value) - before)


def differences(full: DataFrame, truncated: DataFrame) -> DataFrame:
    """Rows of either build that the other lacks, with ``side``: empty if truncating inputs changed nothing that was already known."""
    truncated = truncated.select(*full.columns)
    return full.exceptAll(truncated).withColumn("side", F.lit("full")).unionByName(truncated.exceptAll(full).withColumn("side", F.lit("truncated")))
