"""Strictly prior and rolling statistics, trends, streaks and runs over an ordered series of each key.

Frames count rows, not periods: a missing period shortens the span and a null value still takes its place. Statistics need ``least`` values that aren't null; where they have fewer, or no spread, the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _over(keys: list[str], order: list[str], first: int | None, last: int):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding if first is None else first, last)


def z_score(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int | None, least: int, current: bool = False, population: bool = False) -> DataFrame:
    """Distance of ``value`` from the mean of the ``rows`` before it (None: all), in standard deviations of these; ``current`` counts the row itself as the last of them."""
    w = _over(keys, order, None if rows is None else (1 - rows if current else -rows), 0 if current else -1)
    spread = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    enough = (F.count(value).over(w) >= least) & (spread > 0)
    return df.withColumn(out, F.when(enough, (F.col(value) - F.avg(value).over(w)) / spread))


def trend_deviation(df: DataFrame, keys: list[str], order: list[str], x: str, value: str, out: str, least: int, near_zero: float = 1e-9) -> DataFrame:
    """(value - trend) / |trend|, the trend a straight line over ``x`` through all rows before, with at least two distinct ``x``."""
    w = _over(keys, order, None, -1)
    line = F.regr_slope(value, x).over(w) * F.col(x) + F.regr_intercept(value, x).over(w)
    known = F.when(F.col(value).isNotNull(), F.col(x))
    enough = (F.count(value).over(w) >= least) & (F.max(known).over(w) > F.min(known).over(w))
    return df.withColumn("__line", F.when(enough, line)).withColumn(out, F.when(F.abs("__line") > near_zero, (F.col(value) - F.col("__line")) / F.abs("__line"))).drop("__line")


def prior_share_below(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int, least: int) -> DataFrame:
    """Share of the ``rows`` values before that are at most ``value``."""
    w = _over(keys, order, -rows, -1)
    prior = F.collect_list(value).over(w)
    n = F.count(value).over(w)
    return df.withColumn(out, F.when((n >= least) & F.col(value).isNotNull(), F.size(F.filter(prior, lambda p: p <= F.col(value))) / n))


def prior_quantile(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows: int, least: int, q: float) -> DataFrame:
    """The interpolated ``q`` quantile of the ``rows`` values before."""
    w = _over(keys, order, -rows, -1)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, F.percentile(value, q).over(w)))


def rolling_correlation(df: DataFrame, keys: list[str], order: list[str], a: str, b: str, out: str, rows: int, least: int) -> DataFrame:
    """Pearson correlation of two columns over the last ``rows`` rows, the current included."""
    w = _over(keys, order, 1 - rows, 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    ratio = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return df.withColumn(out, F.when(F.count(x).over(w) >= least, ratio))


def change(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, back: int = 1, share: bool = False) -> DataFrame:
    """``value`` less that of ``back`` rows before, or that difference over the magnitude of the earlier value."""
    before = F.lag(value, back).over(W.partitionBy(*keys).orderBy(*order))
    moved = F.col(value) - before
    return df.withColumn(out, F.try_divide(moved, F.abs(before)) if share else moved)


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running sum; nulls count as nothing."""
    return df.withColumn(out, F.sum(value).over(_over(keys, order, None, 0)))


def streak(df: DataFrame, keys: list[str], order: list[str], delta: str, out: str, mode: str) -> DataFrame:
    """Length of the run of equal signs of ``delta`` that ends at each row.

    zero_ends: signed; zero or null ends a run and gives 0. skip_zero: signed; zeros and nulls are passed over and repeat the run before them. reset: unsigned count of rows since the last zero or null, which itself gives 0.
    """
    if mode not in ("zero_ends", "skip_zero", "reset"):
        raise ValueError(mode)
    w = W.partitionBy(*keys).orderBy(*order)
    sign = F.coalesce(F.signum(delta), F.lit(0.0)).cast("int")
    rows = df.withColumn("__s", sign)
    if mode == "reset":
        rows = rows.withColumn("__g", F.sum((F.col("__s") == 0).cast("int")).over(w))
        inner = W.partitionBy(*keys, "__g").orderBy(*order)
        return rows.withColumn(out, F.sum((F.col("__s") != 0).cast("int")).over(inner).cast("int")).drop("__s", "__g")
    if mode == "skip_zero":
        before = F.last(F.when(F.col("__s") != 0, F.col("__s")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("__new", ((F.col("__s") != 0) & (F.col("__s") != F.coalesce(before, F.lit(0)))).cast("int"))
        counted = (F.col("__s") != 0).cast("int")
    else:
        rows = rows.withColumn("__new", (F.col("__s") != F.coalesce(F.lag("__s").over(w), F.lit(9))).cast("int"))
        counted = F.lit(1)
    rows = rows.withColumn("__g", F.sum("__new").over(w))
    inner = W.partitionBy(*keys, "__g").orderBy(*order)
    first = F.first(F.when(F.col("__s") != 0, F.col("__s")), True).over(inner.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    length = F.sum(counted).over(inner)
    return rows.withColumn(out, (length * F.coalesce(first, F.lit(0))).cast("int")).drop("__s", "__new", "__g")


def longest_run(df: DataFrame, keys: list[str], order: list[str], holds: Column, out: str) -> DataFrame:
    """For each key, the greatest number of rows in a row for which ``holds`` is true."""
    w = W.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, F.coalesce(holds, F.lit(False)).alias("__h")).withColumn("__g", F.sum((~F.col("__h")).cast("int")).over(w))
    return rows.groupBy(*keys, "__g").agg(F.sum(F.col("__h").cast("int")).alias("__n")).groupBy(*keys).agg(F.max("__n").cast("int").alias(out))


def episodes(df: DataFrame, keys: list[str], at: str, gap_days: int) -> DataFrame:
    """Runs of dates with at most ``gap_days`` between neighbours: first and last date and number of events. Null dates are left out."""
    w = W.partitionBy(*keys).orderBy(at)
    rows = df.where(F.col(at).isNotNull()).withColumn("__d", F.to_date(at))
    rows = rows.withColumn("__new", F.coalesce((F.datediff("__d", F.lag("__d").over(w)) > gap_days).cast("int"), F.lit(1)))
    rows = rows.withColumn("episode", F.sum("__new").over(w).cast("int"))
    return rows.groupBy(*keys, "episode").agg(F.min("__d").alias("first_date"), F.max("__d").alias("last_date"), F.count(F.lit(1)).alias("n_events"))


def independent_windows(df: DataFrame, keys: list[str], at: str, horizon_days: int | Column, out: str) -> DataFrame:
    """For each key, how many windows of ``horizon_days`` (a number, or one of the keys) that do not overlap fit, taken greedily from the first date on. The dates of one key are distinct days, so their list is bounded by the calendar."""
    days = F.array_sort(F.collect_set(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date"))))
    start = F.struct(F.lit(-(10**8)).alias("until"), F.lit(0).alias("n"))
    fold = F.aggregate("__days", start, lambda s, d: F.when(d >= s["until"], F.struct((d + horizon_days).alias("until"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    return df.where(F.col(at).isNotNull()).groupBy(*keys).agg(days.alias("__days")).withColumn(out, fold).drop("__days")


def prior_seasons(df: DataFrame, keys: list[str], season: str, slot: str, value: str, seasons: int, least: int) -> DataFrame:
    """Against the same slot of the up to ``seasons`` seasons before: change from their mean as a share, and z score with the sample deviation."""
    w = W.partitionBy(*keys, slot).orderBy(season).rangeBetween(-seasons, -1)
    mean, spread, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    ok = n >= least
    return df.withColumns({"slot_change": F.when(ok, F.try_divide(F.col(value) - mean, F.abs(mean))), "slot_z": F.when(ok & (spread > 0), (F.col(value) - mean) / spread)})


def decayed_peak(df: DataFrame, events: DataFrame, keys: list[str], at: str, event_at: str, severity: str, half_life_days: float, out: str, least: float = 0.0, own_day: bool = False, short: str | None = None, look_back_days: float | None = None) -> DataFrame:
    """For each row, the largest severity of the key's events before its day (``own_day``: up to it), halved every ``half_life_days``; null if there is none. Events of less than ``least`` take no part.

    ``short`` names a flag for rows less than ``look_back_days`` (two half-lives) after the key's first event of any severity, which may lack earlier ones; it is null where the key has no earlier event.

    A severity halved until a day is 2 ** (log2(severity) + event's day / half-life - day / half-life), so one running maximum of the first two gives all. Repeated rows keep their number; severities that aren't positive numbers and rows or events without a day take no part.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    rows = df.select(*keys, F.struct(*df.columns).alias("__row"), day(at).alias("__d"))
    counts = (F.col(severity) > 0) & (F.col(severity) >= least) & ~F.isnan(F.col(severity).cast("double"))
    marks = events.select(*keys, day(event_at).alias("__d"), F.when(counts, F.log2(severity) + day(event_at) / half_life_days).alias("__u"), day(event_at).alias("__first")).where("__d is not null")
    before = W.partitionBy(*keys).orderBy("__d").rangeBetween(W.unboundedPreceding, 0 if own_day else -1)
    laid = rows.unionByName(marks, allowMissingColumns=True).withColumn(out, F.pow(F.lit(2.0), F.max("__u").over(before) - F.col("__d") / half_life_days))
    if short:
        laid = laid.withColumn(short, F.col("__d") - F.min("__first").over(before) < (2 * half_life_days if look_back_days is None else look_back_days))
    return laid.where("__row is not null").select("__row.*", out, *([short] if short else []))
